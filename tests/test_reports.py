"""Shared words and partial states against plain recomputation."""

import random

from pyspark.sql import functions as F

from regspark.operators import partials, streets


def test_pairs_that_share_tokens(spark):
    rnd = random.Random(2)
    word = lambda: rnd.choice(["rua", "gran", "via"] * 6 + list("abcdefghijklmnop"))
    rows = lambda n: [(i, [word() for _ in range(rnd.randint(0, 6))] if i % 17 else None) for i in range(n)]
    a, b = rows(150), rows(90)
    frame = lambda r: spark.createDataFrame(r, "id int, tokens array<string>")
    for least in (1, 2, 3):
        want = sorted((i, j, len(set(x or []) & set(y or []))) for i, x in a for j, y in b if len(set(x or []) & set(y or [])) >= least)
        assert sorted(map(tuple, streets.sharing(frame(a), frame(b), least).collect())) == want
    assert streets.sharing(frame([]), frame(b)).collect() == []


def test_pairs_are_counted_in_tiles(spark, monkeypatch):
    """No row is made for a pair that only meets at a frequent word; sets lie in several tiles, ids come twice, sets are long."""
    rnd = random.Random(5)
    words = ["the", "of", "and"] + [f"w{i}" for i in range(400)]
    own = lambda i: None if i % 31 == 0 else [*words[:i % 4], *(rnd.choice(words) for _ in range(i % 5)), None] if i % 50 else [*words, words[i % 403]]
    a, b = ([(i % (n - 9) if i % 23 else None, own(i)) for i in range(n)] for n in (260, 170))
    frame = lambda r: spark.createDataFrame(r, "id long, tokens array<string>")
    held = lambda rows: {k: {w for i, x in rows for w in x or [] if i == k and w is not None} for k, _ in rows}
    want = {(i, j, len(x & y)) for i, x in held(a).items() for j, y in held(b).items() if len(x & y) >= 2}
    for tile in (1 << 16, 40):
        monkeypatch.setattr(streets, "TILE", tile, raising=False)
        got = streets.sharing(frame(a), frame(b).withColumn("id", F.col("id").cast("string")))
        rows = [(r.id_a, None if r.id_b is None else int(r.id_b), r.common) for r in got.collect()]
        assert len(rows) == len(want) and set(rows) == want
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_same_streets_are_those_that_are_not_different(spark):
    from regspark.functions import text as C

    names = ["Rua Gran Via 12, Vigo", "GRAN VIA 3 Es:1", "Avenida de Castrelos 4", "Camiño de Castrelos", "", None, "Praza Gran Via Alta"]
    d = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = {(r.id_a, r.id_b) for r in streets.same_streets(d, d).collect()}
    pairs = d.toDF("i", "x").crossJoin(d.toDF("j", "y"))
    common = F.size(F.array_intersect(streets.tokens("x"), streets.tokens("y")))
    want = {(r.i, r.j) for r in pairs.filter(~C.different_streets("x", "y") & (common >= 2)).collect()}
    assert got == want and (0, 1) in got and (2, 0) not in got


def test_shapes_of_several_parts(spark):
    from regspark.functions import geometry as G

    ring = lambda x0, y0, x1, y1, turn=False: [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)][:: -1 if turn else 1]
    outer, hole, island, other = ring(0.0, 0.0, 4.0, 4.0), ring(1.0, 1.0, 3.0, 3.0), ring(1.5, 1.5, 2.5, 2.5, True), ring(10.0, 0.0, 12.0, 1.0, True)
    rows = [(1, [outer]), (2, [hole, other, outer, island]), (3, None), (4, [outer, hole]), (5, [ring(1.0, 1.0, 1.0, 1.0)])]
    d = spark.createDataFrame(rows, "id int, rings array<array<struct<lon:double,lat:double>>>").withColumn("s", G.parts("rings"))
    got = {r.id: r for r in d.select("id", "s", G.parts_centroid("s").alias("c"), G.parts_area("s").alias("a"), *[G.parts_contain(F.col("s"), F.lit(x), F.lit(y)).alias(k) for k, x, y in (("edge", 0.5, 0.5), ("hole", 1.2, 1.2), ("island", 2.0, 2.0), ("far", 11.0, 0.5))]).collect()}
    plain = lambda s: [[[tuple(p) for p in r] for r in part] for part in s]
    assert plain(got[1].s) == [[outer]] and plain(got[2].s) == [[other], [outer, hole], [island]] and got[3].s is None and plain(got[4].s) == [[outer, hole]]
    assert (got[1].c.lon, got[1].c.lat) == (2.0, 2.0)
    area = 16 - 4 + 1 + 2
    assert abs(got[2].c.lon - (13 * 2 + 2 * 11) / area) < 1e-12 and abs(got[2].c.lat - (13 * 2 + 2 * 0.5) / area) < 1e-12
    assert (got[5].c.lon, got[5].c.lat, got[5].a) == (1.0, 1.0, 0.0)
    assert [(got[i].edge, got[i].hole, got[i].island, got[i].far) for i in (1, 2, 4)] == [(True, True, True, False), (True, False, True, True), (True, False, False, False)]
    assert abs(got[4].a / (12 * G.METRES_PER_DEGREE ** 2) - 1) < 0.01


def test_sketches_merge_within_their_error(spark, tmp_path):
    rows = spark.range(60_000).select(F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"), F.sha2((F.col("id") % 20_000).cast("string"), 256).alias("hash"))
    for k in range(4):
        partials.add_distinct(rows.filter(f"pmod(hash(hash), 4) = {k} or pmod(hash(hash), 4) = {(k + 1) % 4}"), "source", "hash", str(tmp_path), f"{k}")
    exact = {r.source: (r.n, r.different) for r in partials.merged_distinct(spark, str(tmp_path), "source", "hash").collect()}
    assert exact == {r.source: (2 * r.n, r.d) for r in rows.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("hash").alias("d")).collect()}
    near = {r.source: (r.n, r.different) for r in partials.merged_distinct(spark, str(tmp_path), "source", "hash", approximate=True).collect()}
    assert all(near[s][0] == n and abs(near[s][1] / d - 1) < 0.05 for s, (n, d) in exact.items())
