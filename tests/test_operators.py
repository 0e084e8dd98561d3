"""Ordered, spatial and retrieval operators against brute force, with hot groups."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regspark.functions import geometry as G
from regspark.operators import chat, ordered
from regspark.operators import parcels as P
from regspark.operators import retrieve as V
from regspark.operators import spatial as SP
from regspark.operators import state as ST
from regspark.operators.segscan import scan
from regspark.providers import HashingEmbedding, WordOverlapScore, add_embeddings, score_column


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    keys = [1 if rng.random() < 0.5 else rng.randrange(40) for _ in range(3000)]
    rows = [(k, i, rng.randrange(5), rng.choice([None, f"h{i}"])) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "k int, pos long, v int, h string").repartition(8), rows


def by_key(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(r[0], []).append(r)
    return groups


def test_blocked_windows_equal_plain_windows(skewed):
    df, rows = skewed
    carried = {r["pos"]: r["h"] for r in ordered.carry_last(df, ["k"], "pos", ["h"], width=64).collect()}
    sums = {r["pos"]: r["s"] for r in ordered.running_sum(df, ["k"], "pos", F.col("v"), "s", width=64).collect()}
    nxt = {r["pos"]: r["n"] for r in ordered.neighbour(df, ["k"], "pos", {"v": "n"}, 1, width=64).collect()}
    prev = {r["pos"]: r["n"] for r in ordered.neighbour(df, ["k"], "pos", {"v": "n"}, -1, width=64).collect()}
    before = {r["pos"]: r["b"] for r in ordered.preceding(df, ["k"], "pos", F.col("v"), 6, "b", width=64).collect()}
    for group in by_key(rows).values():
        last, total = None, 0
        for i, (_, pos, v, h) in enumerate(group):
            total += v
            assert carried[pos] == last and sums[pos] == total
            assert nxt[pos] == (group[i + 1][2] if i + 1 < len(group) else None)
            assert prev[pos] == (group[i - 1][2] if i else None)
            assert before[pos] == [g[2] for g in group[max(0, i - 6):i]]
            last = h if h is not None else last


@pytest.mark.parametrize("ranges", [1, 40])
def test_scan_equals_plain_loops(spark, skewed, ranges):
    """Sums, runs and tails over range borders: a hot key over many ranges, ranges of few rows, sparse positions, null keys and values."""
    _, rows = skewed
    rows = [(None if k == 7 else k, pos * 1_000_000_007, v, h) for k, pos, v, h in rows]
    df = spark.createDataFrame(rows, "k int, pos long, v int, h string").repartition(5)
    value = F.when(F.col("v") != 2, F.col("v") > 0)  # null, true or false
    with_runs = scan(df, ["k"], "pos", {"t": (F.struct("h", "v"), 3)}, {"s": F.when(F.col("v") < 4, F.col("v"))}, ("r", value), ranges)
    plain = scan(df, ["k"], "pos", {"t": (F.col("h"), 6)}, {"s": F.lit(1)}, ranges=ranges)
    got, numbered = [{r["pos"]: r for r in d.collect()} for d in (with_runs, plain)]
    assert len(got) == len(numbered) == len(rows)
    for group in by_key(rows).values():
        total, run, since = 0, 0, 0
        for i, (_, pos, v, h) in enumerate(group):
            known = [None if g[2] == 2 else g[2] > 0 for g in group[max(i - 1, 0):i + 1]]
            if i and None not in known and known[0] != known[1]:
                run, since = run + 1, i
            total += v if v < 4 else 0
            assert (got[pos]["r"], got[pos]["s"]) == (run, total)
            assert [tuple(x) for x in got[pos]["t"]] == [(g[3], g[2]) for g in group[max(since, i - 3):i]]
            assert numbered[pos]["s"] == i + 1 and numbered[pos]["t"] == [g[3] for g in group[max(0, i - 6):i]]


def test_scan_of_nothing_and_clashing_names(spark):
    empty = spark.createDataFrame([], "k int, pos long, v int")
    out = scan(empty, ["k"], "pos", {"t": (F.col("v"), 2)}, {"s": F.col("v")}, ("r", F.col("v")))
    assert out.columns == ["k", "pos", "v", "s", "r", "t"] and out.count() == 0
    with pytest.raises(ValueError):
        scan(empty, ["k"], "pos", sums={"v": F.col("v")})


def test_scan_evaluates_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(1000).selectExpr("id % 3 k", "id pos").mapInArrow(count, "k long, pos long")
    assert scan(df, ["k"], "pos", {"t": (F.col("pos"), 2)}, {"s": F.lit(1)}).count() == 1000
    assert seen.value == 1000


def test_first_last_and_top(skewed):
    df, rows = skewed
    groups = by_key(rows)
    assert {r["k"]: r["pos"] for r in ordered.first_by(df, ["k"], ["pos"]).collect()} == {k: g[0][1] for k, g in groups.items()}
    assert {r["k"]: r["pos"] for r in ordered.last_by(df, ["k"], ["pos"]).collect()} == {k: g[-1][1] for k, g in groups.items()}
    top = ordered.top_per_key(df, ["k"], [F.desc("pos")], 3)
    assert top.count() == sum(min(3, len(g)) for g in groups.values())
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------ geometry


HOLED = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (3.0, 1.0), (1.0, 1.0)]]
RIGHT = [[(4.0, 0.0), (8.0, 0.0), (8.0, 4.0), (4.0, 4.0), (4.0, 0.0)]]
RINGS = "zone_id int, rings array<array<struct<lon:double,lat:double>>>"


def test_points_in_polygons_with_hole_and_shared_edge(spark):
    zones = spark.createDataFrame([(1, HOLED), (2, RIGHT), (3, None)], RINGS)
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 4.0, 1.0), (4, 9.0, 9.0)], "point_id int, lon double, lat double")
    got = {r["point_id"]: r["zone_id"] for r in SP.point_in_polygon(pts, zones, "point_id", "zone_id", cell=0.7).collect()}
    assert got == {1: 1, 3: 2}
    near = {r["point_id"]: r["zone_id"] for r in SP.nearest_polygon(pts, zones, "point_id", "zone_id", cell=0.1).collect()}
    assert near == {1: 1, 2: 1, 3: 1, 4: 2}  # on a shared edge both are at distance 0, the smaller id wins


def brute_distance(rings, lon, lat):
    k = G.METRES_PER_DEGREE
    kx, best = k * math.cos(math.radians(lat)), math.inf
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            px, py, dx, dy = (ax - lon) * kx, (ay - lat) * k, (bx - ax) * kx, (by - ay) * k
            t = max(0.0, min(1.0, -(px * dx + py * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            best = min(best, math.hypot(px + t * dx, py + t * dy))
    return best


def test_nearest_polygon_equals_brute_force_with_a_crowded_cell(spark):
    rng = random.Random(5)
    zones = []
    for i in range(60):
        x, y = (-8.7 + rng.random() * 0.002, 42.2 + rng.random() * 0.002) if i % 3 == 0 else (-8.8 + rng.random() * 0.3, 42.1 + rng.random() * 0.3)
        zones.append((i, [[(x, y), (x + 3e-4, y), (x + 1e-4, y + 4e-4), (x, y)]]))
    pts = [(i, -8.9 + rng.random() * 0.6, 42.0 + rng.random() * 0.6) for i in range(80)]
    got = {r["point_id"]: (r["zone_id"], r["metres"]) for r in SP.nearest_polygon(
        spark.createDataFrame(pts, "point_id int, lon double, lat double"), spark.createDataFrame(zones, RINGS), "point_id", "zone_id", cell=0.005).collect()}
    within = {r["point_id"]: r["metres"] for r in SP.polygons_within(
        spark.createDataFrame(pts, "point_id int, lon double, lat double"), spark.createDataFrame(zones, RINGS), "point_id", "zone_id", 3000.0).collect()}
    assert len(got) == len(pts)
    for pid, lon, lat in pts:
        want = min((round(brute_distance(r, lon, lat), 3), z) for z, r in zones)
        assert got[pid][1] == pytest.approx(want[0], abs=0.002)
        assert (pid in within) == (want[0] <= 3000.0)


def test_nearest_polygon_far_away_compares_few_pairs(spark):
    """Points far from all polygons: the answers of brute force, with exact geometry for a small part of the pairs; copies and empty shapes."""
    rng = random.Random(8)
    zones = []
    for i in range(300):
        x, y = rng.choice([(-8.7, 42.2), (3.0, 40.0), (-60.0, -30.0)])
        x, y = x + rng.random() * 0.5, y + rng.random() * 0.5
        zones.append((i, [[(x, y), (x + 3e-4, y), (x + 1e-4, y + 4e-4), (x, y)]]))
    zones += [(1000 + i, zones[7][1]) for i in range(50)] + [(2000, []), (2001, None), (2002, [[(0.0, 0.0)]])]
    pts = [(i, rng.uniform(-170, 170), rng.uniform(-80, 80)) for i in range(40)] + [(90, None, 1.0)]
    shapes, points = spark.createDataFrame(zones, RINGS), spark.createDataFrame(pts, "point_id int, lon double, lat double")
    got = {r["point_id"]: (r["metres"], r["zone_id"]) for r in SP.nearest_polygon(points, shapes, "point_id", "zone_id").collect()}
    turned = [(z, [[(x + t, y) for x, y in ring] for ring in r]) for z, r in zones[:300] for t in (0, 360, -360)]
    for pid, lon, lat in pts[:-1]:
        want = min((round(brute_distance(r, lon, lat), 3), z) for z, r in turned)
        assert got[pid][0] == pytest.approx(want[0], abs=0.002) and got[pid][1] == want[1]
    assert got.keys() == {p[0] for p in pts[:-1]}
    assert SP.nearest_polygon(points, shapes.filter("zone_id >= 2000"), "point_id", "zone_id").count() == 0
    places = points.filter("lon is not null")
    pairs = SP.pyramid_pairs(places, shapes.filter("zone_id < 2000"), "point_id", "zone_id", 0.01)
    assert 40 <= pairs.count() < 0.05 * 40 * 300  # all others are ruled out by bounds; the 51 copies are one shape
    assert "Cartesian" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_one_huge_polygon_stays_a_few_cells(spark):
    big = [[(-180.0, -80.0), (180.0, -80.0), (180.0, 80.0), (-180.0, 80.0), (-180.0, -80.0)]]
    small = [[(0.0, 0.0), (0.001, 0.0), (0.001, 0.001), (0.0, 0.001), (0.0, 0.0)]]
    zones = spark.createDataFrame([(5, big), (2, small)], RINGS)
    assert SP._cells(zones, 0.001, 0).count() < 60
    pts = spark.createDataFrame([(1, 0.0005, 0.0005), (2, 50.0, 50.0)], "point_id int, lon double, lat double")
    got = {r["point_id"]: r["zone_id"] for r in SP.point_in_polygon(pts, zones, "point_id", "zone_id", cell=0.001).collect()}
    assert got == {1: 2, 2: 5}


def test_round_trip_and_ellipsoid(spark):
    pts = spark.createDataFrame([(1, 42.2358, -8.7267), (2, 42.16, -8.62)], "i int, lat double, lon double")
    assert {r["grade"] for r in SP.round_trip(pts).collect()} == {"excellent"}
    d = pts.select(G.ellipsoidal("lat", "lon", F.lit(42.24), F.lit(-8.72)).alias("e"),
                   G.haversine(F.col("lat"), F.col("lon"), F.lit(42.24), F.lit(-8.72)).alias("h")).collect()
    assert all(abs(r["e"] - r["h"]) / r["e"] < 0.005 for r in d)


# ------------------------------------------------------------------ retrieval


def unit_rows(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_search_and_fusion_equal_numpy(spark):
    rng = np.random.default_rng(1)
    chunks = [(f"c{i:03d}", *[rng.normal(size=8).tolist() for _ in range(3)]) for i in range(300)]
    queries = [(q, rng.normal(size=8).tolist()) for q in range(7)]
    c = spark.createDataFrame(chunks, "chunk_id string, v_text array<double>, v_summary array<double>, v_questions array<double>").repartition(5)
    q = spark.createDataFrame(queries, "query_id int, vector array<double>")
    want = {}
    for qid, vec in queries:
        for view in (1, 2, 3):
            sims = np.round(unit_rows(np.array([row[view] for row in chunks])) @ unit_rows(np.array([vec]))[0], 9)
            top = sorted((-s, chunks[i][0]) for i, s in enumerate(sims) if s >= 0.3)[:20]
            for rank, (_, cid) in enumerate(top, 1):
                want[(qid, cid)] = want.get((qid, cid), 0.0) + 1 / (60 + rank)
    for limit in (V.QUERY_BYTES, 8 * 8 * 2):  # one shared query block, and tiles
        hits = V.similarity_hits(q, c, max_query_bytes=limit)
        got = {(r["query_id"], r["chunk_id"]): r["rrf_score"] for r in V.rank_fusion(hits).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_fusion_ignores_list_order(spark):
    h = spark.createDataFrame([(1, "text", "a", 1), (1, "summary", "a", 2), (1, "text", "b", 2), (1, "summary", "b", 1)],
                              "query_id int, view string, chunk_id string, rank int")
    r = V.ranked(V.rank_fusion(h), "rrf_score", 5).orderBy("rank").collect()
    assert [x["chunk_id"] for x in r] == ["a", "b"] and r[0]["rrf_score"] == r[1]["rrf_score"]


def test_score_floor_only_with_a_reranker(spark):
    f = spark.createDataFrame([(1, "a", 0.049, "altura máxima", "cab\n\nla altura"), (1, "b", 0.03, "altura máxima", "cab\n\nnada")],
                              "query_id int, chunk_id string, rrf_score double, query string, text_with_header string")
    assert V.rerank(f, 5, min_score=0.05).count() == 2
    scored = V.rerank(f, 5, score_column(WordOverlapScore()), min_score=0.05).collect()
    assert [r["chunk_id"] for r in scored] == ["a"]


def test_payload_filters(spark):
    df = spark.createDataFrame([("cte-si", "U1", True), ("cte-xx", "U1", False), ("nhv", "U2", True)], "source string, ordinance_code string, defines_uses boolean")
    assert df.filter(V.payload_filter({"source_prefix": "cte"})).count() == 2
    assert df.filter(V.payload_filter({"source_prefix": "cte"}, compat=True)).count() == 1
    assert df.filter(V.payload_filter({"ordinance_code": "U1.2"})).count() == 2
    assert df.filter(V.must_should({"ordinance_code": "U1"}, ["defines_uses"])).count() == 1


def test_embeddings_have_unit_length(spark):
    df = spark.createDataFrame([("altura máxima",), ("",), (None,)], "t string")
    norms = [round(float(np.linalg.norm(r["v"])), 5) for r in add_embeddings(df, {"v": "t"}, HashingEmbedding(32)).collect()]
    assert norms == [1.0, 0.0, 0.0]


# ------------------------------------------------------------------ state, chats, units


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "chunk_id string, v int")
    new = spark.createDataFrame([("b", 2), ("b", 3), ("c", 1)], "chunk_id string, v int")
    once = ST.upsert(old, new, "chunk_id", ["v"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, ST.upsert(once, new, "chunk_id", ["v"]).collect())) == [("a", 1), ("b", 3), ("c", 1)]


def test_sessions_restart_the_history(spark):
    m = spark.createDataFrame([(1, t, "user", f"m{t}", "A" if t < 3 else "B") for t in range(6)], "conv_id int, turn int, role string, text string, rc string")
    h = {r["turn"]: [x["text"] for x in r["history"]] for r in chat.session_history(m).collect()}
    assert h == {0: [], 1: ["m0"], 2: ["m0", "m1"], 3: [], 4: ["m3"], 5: ["m3", "m4"]}


def test_unit_shapes(spark):
    rows = [("b", 0, "r1", "VIVIENDA", 50.0, "1", "", "A"), ("b", 1, "r1", "ELEMENTOS COMUNES", 5.0, "", "", ""), ("b", 2, "r1", "COMUN", 4.0, "", "", ""),
            ("b", 3, "r1", "VIVIENDA", 10.0, "2", "03", "B"), ("b", 4, None, "ALMACEN", 3.0, "", "", "")]
    u = spark.createDataFrame(rows, "building string, pos int, ref string, use string, area double, stair string, floor string, door string")
    c = {r["ref"]: r for r in P.consolidate_units(P.pair_common_areas(u)).collect()}
    assert (c["r1"]["area"], c["r1"]["common_area"], c["r1"]["stair"], c["r1"]["floor"]) == (60.0, 5.0, "1", "03") and "SIN_REF" in c
    req = spark.createDataFrame([(1, "b", "", "3", ""), (2, "b", "9", "", "")], "req_id int, building string, stair string, floor string, door string")
    got = P.filter_units(req, u).groupBy("req_id").count().collect()
    assert {r["req_id"]: r["count"] for r in got} == {1: 1, 2: 5}


def test_queries_and_chunks_without_a_vector_have_no_hits(spark):
    from regspark.operators import retrieve as V

    chunks = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None)], "chunk_id string, v array<double>")
    for rows in ([(1, None), (2, [1.0, 0.0]), (3, None)], [(1, [0.0, 2.0]), (2, None), (3, [3.0, 0.0])]):
        queries = spark.createDataFrame(rows, "query_id int, vector array<double>")
        want = {(q, "a" if v[0] else "b") for q, v in rows if v}
        for most in (V.QUERY_BYTES, 16):
            hits = V.similarity_hits(queries, chunks, 1, None, {"text": "v"}, max_query_bytes=most)
            assert {(r.query_id, r.chunk_id) for r in hits.collect()} == want
    mixed = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id int, vector array<double>")
    with pytest.raises(Exception, match="vectors of 3 and of 2"):
        V.similarity_hits(mixed, chunks, 1, None, {"text": "v"}).collect()


def test_plans_are_built_without_jobs(spark, sf):
    """Building a query runs no job but documented checkpoints."""
    from regspark.plans import catalog

    catalog.load_all()
    tracker = spark.sparkContext.statusTracker()
    for name in ("t01_plain_articles", "t05_markdown_articles", "t16_text_with_header", "r02_j07_wikilinks", "w02_session_history", "j15_cadastral_layers"):
        spark.sparkContext.setJobGroup(name, name)
        catalog.QUERIES[name](spark, sf)
        assert len(tracker.getJobIdsForGroup(name)) <= 8, (name, len(tracker.getJobIdsForGroup(name)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def box(lon, lat, half=0.0001):
    return [[(lon - half, lat - half), (lon + half, lat - half), (lon + half, lat + half), (lon - half, lat + half), (lon - half, lat - half)]]


def test_polygons_near_the_poles_and_across_the_date_line(spark):
    zones = spark.createDataFrame([(1, box(0.0, 86.0)), (2, box(-179.9999, 10.0)), (3, box(170.0, 10.0)), (4, box(20.0, -88.5))], RINGS)
    near_pole = 0.0001 + 45 / (111_320 * 0.0697565)
    points = spark.createDataFrame([(1, near_pole, 86.0), (2, 179.9997, 10.0), (3, 100.0, 0.0), (4, 20.0 + 0.0001 + 40 / (111_320 * 0.026177), -88.5)], "point_id int, lon double, lat double")
    got = {r.point_id: (r.zone_id, r.metres) for r in SP.polygons_within(points, zones, "point_id", "zone_id", 50.0).collect()}
    assert {p: z for p, (z, _) in got.items()} == {1: 1, 2: 2, 4: 4} and all(m <= 50 for _, m in got.values())
    nearest = {r.point_id: (r.zone_id, r.metres) for r in SP.nearest_polygon(points, zones, "point_id", "zone_id").collect()}
    assert nearest[2][0] == 2 and nearest[2][1] < 60 and nearest[3][0] == 3


@pytest.mark.parametrize("name", ["g06_nearby_parcel", "g09_resolution_chain"])
def test_no_side_of_the_cell_join_is_broadcast(spark, sf, name):
    """Sizes are guessed before cells are exploded, so a broadcast would send millions of cells through the driver."""
    from regspark.plans import catalog, derive

    catalog.load_all()
    met = SP.lookup_parcel(derive.shared(spark, sf, "points"), derive.parcels(spark, sf), "point_id")
    assert "BroadcastExchange" not in met._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in catalog.QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", ["g06_nearby_parcel", "g09_resolution_chain"])
def test_look_up_hits_are_not_broadcast_while_it_runs(spark, sf, name):
    """Adaptive execution turns a join into a broadcast one as long as its hits fit under the threshold; they grow with the points."""
    from regspark.plans import catalog

    catalog.load_all()
    df = catalog.QUERIES[name](spark, sf)
    df.collect()
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_shared_steps_of_an_expression_are_computed_once(spark):
    """A lambda computes what it refers to again for each element, so a step that several refer to stands in the plan once."""
    from regspark.functions import features as FE

    def plan(column):
        return spark.range(1).select(F.concat(F.lit("Rúa "), F.col("id")).alias("a"), "id").select(column.alias("x"))._jdf.queryExecution().analyzed().toString()

    assert plan(FE.address_variants("a")).count("regexp_replace(") == 1
    point = F.struct(F.sin("id").alias("lon"), F.lit(1.0).alias("lat"))
    assert plan(G.parts(F.array(F.array(point, point, point, point)))).count("SIN(") == 4
    rows = spark.createDataFrame([("Rúa do Príncipe 12",), ("Urzáiz",), ("",), (None,), ("  rúa  7 ",)], "a string").select(FE.address_variants("a").alias("v")).collect()
    assert all(r.v is None or len({x.lower() for x in r.v}) == len(r.v) for r in rows) and rows[3].v == [] and rows[2].v[0] != ""


def test_a_table_in_one_file_is_spread_before_heavy_rows(spark):
    from regspark.plans import derive

    assert all(derive.shared(spark, "/root/testdata/sf0.001", n).rdd.getNumPartitions() >= 8 for n in ("addresses", "parcel_boxes"))


def test_ranges_of_a_scan_grow_with_the_rows(spark, monkeypatch):
    from regspark.operators import segscan

    monkeypatch.setattr(segscan, "RANGE_ROWS", 50)
    out = scan(spark.range(2000).select(F.lit(1).alias("k"), "id"), ["k"], "id", sums={"s": F.lit(1)})
    per_range = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(per_range) <= 200 and sorted(r.s for r in out.collect()) == list(range(1, 2001))
