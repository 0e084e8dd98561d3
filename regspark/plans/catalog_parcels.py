"""Spatial, parcel and building-unit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from regspark.functions import fixed as X
from regspark.functions import geometry as G
from regspark.operators import parcels as P
from regspark.operators import spatial as SP
from regspark.plans import derive as D
from regspark.plans.catalog import register

R, MPD = repr(X.EARTH_RADIUS) + "::DOUBLE", repr(G.METRES_PER_DEGREE) + "::DOUBLE"
MERC_X = f"(radians(lon) * {R})"
MERC_Y = f"(ln(tan(pi() / 4 + radians(lat) / 2e0)) * {R})"


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = (f"sin(radians({lat2} - {lat1}) / 2e0) * sin(radians({lat2} - {lat1}) / 2e0) + cos(radians({lat1})) * cos(radians({lat2})) "
         f"* sin(radians({lon2} - {lon1}) / 2e0) * sin(radians({lon2} - {lon1}) / 2e0)")
    return f"({2 * X.MEAN_EARTH_RADIUS!r}::DOUBLE * asin(least(sqrt({h}), 1e0)))"


def inside(lon: str = "lon", lat: str = "lat", x1: str = "x1", y1: str = "y1") -> str:
    return f"({lon} >= x0 AND {lon} < {x1} AND {lat} >= y0 AND {lat} < {y1})"


def box_metres(lon: str = "lon", lat: str = "lat") -> str:
    """Distance from an outside point to a box, in the local plane of the point."""
    dx, dy = f"greatest(x0 - {lon}, 0e0, {lon} - x1)", f"greatest(y0 - {lat}, 0e0, {lat} - y1)"
    kx = f"(cos(radians({lat})) * {MPD})"
    return f"round(sqrt(({dx} * {kx}) * ({dx} * {kx}) + ({dy} * {MPD}) * ({dy} * {MPD})), 3)"


def _points(spark, sf):
    return D.shared(spark, sf, "points")


@register("g01_web_mercator", f"""{D.with_shared('points')}, m AS (SELECT point_id, {MERC_X} AS x, {MERC_Y} AS y FROM points)
SELECT point_id, round(x, 3) AS x, round(y, 3) AS y, round(degrees(x / {R}), 7) AS lon, round(degrees(2e0 * atan(exp(y / {R})) - pi() / 2), 7) AS lat FROM m""")
def _(spark, sf):
    m = _points(spark, sf).select("point_id", G.mercator_x("lon").alias("x"), G.mercator_y("lat").alias("y"))
    return m.select("point_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"),
                    F.round(G.lon_of("x"), 7).alias("lon"), F.round(G.lat_of("y"), 7).alias("lat"))


@register("g02_haversine_distance", f"""{D.with_shared('points')} SELECT point_id, round({haversine_sql('lat', 'lon', '42.2e0', '-8.7e0')}, 3) AS metres FROM points""")
def _(spark, sf):
    d = G.haversine(F.col("lat"), F.col("lon"), F.lit(42.2), F.lit(-8.7))
    return _points(spark, sf).select("point_id", F.round(d, 3).alias("metres"))


@register("g02_ellipsoidal_distance")
def _(spark, sf):
    d = G.ellipsoidal("lat", "lon", F.lit(42.2), F.lit(-8.7))
    return _points(spark, sf).select("point_id", F.round(d, 3).alias("metres"))


IN_AREA = " AND ".join(f"lat BETWEEN {a!r}::DOUBLE AND {b!r}::DOUBLE AND lon BETWEEN {c!r}::DOUBLE AND {d!r}::DOUBLE" for a, b, c, d in X.SERVICE_BOXES)


@register("g03_x03_service_area", f"{D.with_shared('points')} SELECT point_id, {IN_AREA} AS in_area FROM points")
def _(spark, sf):
    return _points(spark, sf).select("point_id", G.in_service_area("lat", "lon").alias("in_area"))


PZ = D.with_shared("points", "zone_boxes")


@register("g04_j09_point_in_zone", f"{PZ} SELECT point_id, min(zone_id) AS zone_id FROM points JOIN zone_boxes ON {inside()} GROUP BY point_id")
def _(spark, sf):
    return SP.point_in_polygon(_points(spark, sf), D.zones(spark, sf), "point_id", "zone_id")


CENTRES = """ctr AS (SELECT parcel_ref, x0 + (((x1 - x0) + (x1 - x0)) * w + (x1 - x0) * w) / ((w + w) * 3e0) AS lon,
  y0 + ((y1 - y0) * w + ((y1 - y0) + (y1 - y0)) * w) / ((w + w) * 3e0) AS lat FROM (SELECT *, (x1 - x0) * (y1 - y0) AS w FROM parcel_boxes))"""
ZONED = f"""{D.with_shared('parcel_boxes', 'zone_boxes')}, {CENTRES},
hit AS (SELECT parcel_ref, min(zone_id) AS zone_id FROM ctr JOIN zone_boxes ON {inside()} GROUP BY parcel_ref),
far AS (SELECT parcel_ref, zone_id, {box_metres()} AS metres FROM ctr, zone_boxes WHERE parcel_ref NOT IN (SELECT parcel_ref FROM hit)
  QUALIFY row_number() OVER (PARTITION BY parcel_ref ORDER BY metres, zone_id) = 1),
zoned AS (SELECT parcel_ref, zone_id, 'centroide' AS method, 0e0 AS metres FROM hit UNION ALL SELECT parcel_ref, zone_id, 'proximidad', metres FROM far)"""


@register("g04_zone_of_parcels", f"{ZONED} SELECT * FROM zoned")
def _(spark, sf):
    return SP.zone_of_parcels(D.parcels(spark, sf), D.zones(spark, sf))


@register("g05_parcel_centroids", f"{D.with_shared('parcel_boxes')}, {CENTRES} SELECT parcel_ref, round(lon, 9) AS lon, round(lat, 9) AS lat FROM ctr")
def _(spark, sf):
    c = D.parcels(spark, sf).select("parcel_ref", G.centroid("rings").alias("c"))
    return c.select("parcel_ref", F.round("c.lon", 9).alias("lon"), F.round("c.lat", 9).alias("lat"))


MULTI = f"""{D.with_shared('parcel_boxes')}, m AS (SELECT parcel_ref, x0, y0, x1, y1, x1 - x0 AS w, y1 - y0 AS h FROM parcel_boxes)"""


@register("g05_s09_multi_part_centroids", f"""{MULTI} SELECT parcel_ref, 3 AS parts, 4 AS rings, round((w * h * (x0 + w / 2) - w * h / 4 * (x0 + w / 2) + w * h / 100 * (x0 + w / 2) + w * h * (x0 + w * 3 / 2 + 1e-3)) / (w * h * 1.76e0), 9) AS lon,
round(y0 + h / 2, 9) AS lat FROM m""")
def _(spark, sf):
    """A box with a hole, an island in the hole and a second box beside it, in any order of rings."""
    p = D.shared(spark, sf, "parcel_boxes").withColumns({"w": F.col("x1") - F.col("x0"), "h": F.col("y1") - F.col("y0")})
    at = lambda c, size, k: F.col(c) + F.col(size) * k
    square = lambda a, b, shift=0.0: G.box(at("x0", "w", a) + shift, at("y0", "h", a), at("x0", "w", b) + shift, at("y0", "h", b))[0]
    beside = G.box(at("x0", "w", 1.0) + 1e-3, F.col("y0"), at("x0", "w", 2.0) + 1e-3, F.col("y1"))[0]
    shape = p.select("parcel_ref", G.parts(F.array(square(0.25, 0.75), square(0.0, 1.0), beside, square(0.45, 0.55))).alias("s"))
    c = shape.select("parcel_ref", F.size("s").alias("parts"), F.aggregate("s", F.lit(0), lambda a, x: a + F.size(x)).alias("rings"), G.parts_centroid("s").alias("c"))
    return c.select("parcel_ref", "parts", "rings", F.round("c.lon", 9).alias("lon"), F.round("c.lat", 9).alias("lat"))


LOOKUP = f"""exact AS (SELECT point_id, min(parcel_ref) AS parcel_ref FROM points JOIN parcel_boxes ON {inside()} GROUP BY point_id),
near AS (SELECT point_id, parcel_ref, {box_metres()} AS metres FROM points, parcel_boxes WHERE point_id NOT IN (SELECT point_id FROM exact) AND metres <= 50
  QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY metres, parcel_ref) = 1),
looked AS (SELECT point_id, parcel_ref, 0e0 AS metres, false AS by_proximity FROM exact UNION ALL SELECT point_id, parcel_ref, metres, true FROM near)"""


@register("g06_nearby_parcel", f"{D.with_shared('points', 'parcel_boxes')}, {LOOKUP} SELECT * FROM looked")
def _(spark, sf):
    return SP.lookup_parcel(_points(spark, sf), D.parcels(spark, sf), "point_id")


def quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


@register("g07_j16_class_then_ordinance", f"""{PZ}, cl AS (SELECT point_id, lon, lat, min(zone_id) AS class_id FROM points JOIN zone_boxes ON {inside()} GROUP BY ALL)
SELECT point_id, class_id, land_class, CASE WHEN land_class IN ({quoted(X.URBAN_CLASSES)}) AND lat < y0 + 8e-3 THEN ordinance
  WHEN land_class IN ({quoted(X.RUSTIC_CLASSES)}) AND lon < x0 + 9e-3 THEN 'R' || ordinance END AS ordinance FROM cl JOIN zone_boxes ON class_id = zone_id""")
def _(spark, sf):
    z = D.zones(spark, sf)
    urban = z.select(F.col("zone_id").alias("ord_id"), "ordinance", G.box(z.x0, z.y0, z.x1, z.y0 + F.lit(8e-3)).alias("rings"))
    rustic = z.select(F.col("zone_id").alias("ord_id"), F.concat(F.lit("R"), "ordinance").alias("ordinance"),
                      G.box(z.x0, z.y0, z.x0 + F.lit(9e-3), z.y1).alias("rings"))
    classes = z.select(F.col("zone_id").alias("class_id"), "land_class", "rings")
    return SP.land_class_zone(_points(spark, sf), classes, urban, rustic, "point_id")


def _features(spark, sf):
    """Zone boxes as features in Web Mercator, some without geometry or ordinance."""
    z = D.zones(spark, sf)
    rings = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(G.mercator_x(p["lon"]), G.mercator_y(p["lat"]))))
    return z.select(F.col("zone_id").alias("pos"), F.when(F.col("zone_id") % 6 != 1, F.col("ordinance")).alias("ordinance"),
                    F.when(F.col("zone_id") % 5 != 0, F.concat(F.lit("Zona "), F.col("zone_id"))).alias("name"),
                    F.when(F.col("zone_id") % 7 != 5, rings).alias("rings"), F.col("land_class").alias("class"),
                    F.when(F.col("zone_id") % 3 != 0, F.concat(F.lit("Clase "), "land_class")).alias("class_desc"),
                    F.when(F.col("zone_id") % 4 != 0, F.concat(F.lit("C"), F.col("zone_id"))).alias("cod"))


@register("g08_w04_zone_rows", f"""{D.with_shared('zone_boxes')}, f AS (SELECT *, CASE WHEN zone_id % 6 <> 1 THEN ordinance ELSE 'DESCONOCIDO' END AS o FROM zone_boxes WHERE zone_id % 7 <> 5)
SELECT zone_id AS pos, o || '-' || lpad(CAST(row_number() OVER (PARTITION BY o ORDER BY zone_id) AS VARCHAR), 4, '0') AS code, o AS ordinance,
CASE WHEN zone_id % 5 <> 0 THEN 'Zona ' || CAST(zone_id AS VARCHAR) ELSE '' END AS name, round(x0, 7) AS lon, round(y1, 7) AS lat FROM f""")
def _(spark, sf):
    z = SP.zone_rows(_features(spark, sf))
    corner = F.col("rings")[0][2]
    return z.select("pos", "code", "ordinance", "name", F.round(F.col("rings")[0][0]["lon"], 7).alias("lon"), F.round(corner["lat"], 7).alias("lat"))


@register("g08_class_rows", f"""{D.with_shared('zone_boxes')} SELECT CASE WHEN zone_id % 4 <> 0 THEN 'C' || CAST(zone_id AS VARCHAR) ELSE land_class END AS code,
CASE WHEN zone_id % 3 <> 0 THEN 'Clase ' || land_class ELSE '' END AS name, CASE WHEN zone_id % 3 <> 0 THEN 'Clase ' || land_class ELSE land_class END AS land_class,
round(x1, 7) AS lon FROM zone_boxes WHERE zone_id % 7 <> 5""")
def _(spark, sf):
    return SP.class_rows(_features(spark, sf)).select("code", "name", "land_class", F.round(F.col("rings")[0][1]["lon"], 7).alias("lon"))


BY_ADDRESS = "SELECT c_custkey AS input_id, c_nationkey AS parcel_ref FROM {customer} WHERE c_custkey % 2 = 0"


@register("g09_resolution_chain", f"""{D.with_shared('points', 'parcel_boxes')}, {LOOKUP}
SELECT c_custkey AS input_id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 1 ELSE coalesce(l.parcel_ref, a.parcel_ref) END AS parcel_ref,
CASE WHEN c_custkey % 3 = 0 THEN 'ref' WHEN l.parcel_ref IS NOT NULL THEN 'coordinates' WHEN a.parcel_ref IS NOT NULL THEN 'address' ELSE 'none' END AS method
FROM customer LEFT JOIN looked l ON point_id = c_custkey LEFT JOIN ({BY_ADDRESS.format(customer='customer')}) a ON a.input_id = c_custkey""")
def _(spark, sf):
    c = D.table(spark, sf, "customer")
    by_ref = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("input_id"), (F.col("c_custkey") + 1).alias("parcel_ref"))
    by_point = SP.lookup_parcel(_points(spark, sf), D.parcels(spark, sf), "point_id").select(F.col("point_id").alias("input_id"), "parcel_ref")
    by_address = spark.sql(BY_ADDRESS, customer=c).select("input_id", F.col("parcel_ref").cast("long").alias("parcel_ref"))
    return P.resolve(c.select(F.col("c_custkey").alias("input_id")), by_ref, by_point, by_address)


UNITS = D.with_shared("units")
USE = '"use"'


def _units(spark, sf):
    return D.shared(spark, sf, "units")


@register("g10_j10_address_record", f"""{UNITS}, u AS (SELECT *, CAST(floor(building / 10) AS BIGINT) AS address_id FROM units),
us AS (SELECT address_id, {USE}, count(*) AS n FROM u GROUP BY ALL), ul AS (SELECT address_id, string_agg({USE} || '=' || CAST(n AS VARCHAR), ';' ORDER BY {USE}) AS uses FROM us GROUP BY ALL)
SELECT address_id, count(*) AS units, sum(area) AS area, any_value(uses) AS uses, count(DISTINCT ref) AS refs, min(ref) AS first_ref FROM u JOIN ul USING (address_id) GROUP BY address_id""")
def _(spark, sf):
    u = _units(spark, sf)
    refs = u.select(F.floor(F.col("building") / 10).cast("long").alias("address_id"), "ref").distinct()
    return P.combined_record(refs.select("address_id").distinct(), refs, u.select("ref", "pos", "use", "area"))


@register("g11_zone_precedence", f"""{PZ}, pt AS (SELECT point_id, min(zone_id) AS zone_id FROM points JOIN zone_boxes ON {inside()} GROUP BY point_id),
b AS (SELECT c_custkey AS point_id, CASE c_custkey % 3 WHEN 0 THEN 'U' || CAST(c_custkey % 9 AS VARCHAR) WHEN 1 THEN '' END AS oref, ordinance AS opt, land_class AS npt
  FROM customer LEFT JOIN pt ON point_id = c_custkey LEFT JOIN zone_boxes USING (zone_id))
SELECT point_id, CASE WHEN coalesce(oref, '') <> '' THEN oref ELSE coalesce(opt, 'N/A') END AS ordinance, CASE WHEN coalesce(oref, '') <> '' THEN 'Zona ' || oref ELSE coalesce(npt, '') END AS zone_name,
CASE WHEN coalesce(oref, '') <> '' THEN 'ref' WHEN opt IS NOT NULL THEN 'coordinates' ELSE 'none' END AS zone_origin FROM b""")
def _(spark, sf):
    z = D.zones(spark, sf)
    pt = SP.point_in_polygon(_points(spark, sf), z, "point_id", "zone_id").join(
        z.select("zone_id", F.col("ordinance").alias("ord_by_point"), F.col("land_class").alias("name_by_point")), "zone_id")
    key = F.col("c_custkey")
    c = D.table(spark, sf, "customer").select(key.alias("point_id"), F.when(key % 3 == 0, F.concat(F.lit("U"), key % 9)).when(
        key % 3 == 1, "").alias("ord_by_ref")).withColumn("name_by_ref", F.concat(F.lit("Zona "), "ord_by_ref"))
    return P.zone_precedence(c.join(pt, "point_id", "left")).select("point_id", "ordinance", "zone_name", "zone_origin")


NORM = "CASE WHEN regexp_matches(upper(trim({0})), '^[0-9]+$') THEN coalesce(nullif(ltrim(upper(trim({0})), '0'), ''), '0') ELSE upper(trim({0})) END"
REQ = """SELECT o_orderkey AS req_id, o_orderkey AS building, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '0' || CAST(o_orderkey % 2 + 1 AS {S}) END AS stair,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CAST(o_orderkey % 4 AS {S}) END AS floor, CASE o_orderkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'b' ELSE '' END AS door FROM {orders}"""
MATCH = " AND ".join(f"(r.{c} = '' OR {NORM.format('u.' + c)} = {NORM.format('r.' + c)})" for c in ("stair", "floor", "door"))


@register("g12_unit_filter", f"""{UNITS}, req AS ({REQ.format(S='VARCHAR', orders='orders')}), j AS (SELECT req_id, building, pos, ref, {MATCH} AS matched FROM req r JOIN units u USING (building))
SELECT req_id, building, pos, ref, matched FROM (SELECT *, bool_or(matched) OVER (PARTITION BY req_id) AS any_hit FROM j) WHERE matched OR NOT any_hit""")
def _(spark, sf):
    req = spark.sql(REQ.replace("{S}", "STRING"), orders=D.table(spark, sf, "orders"))
    return P.filter_units(req, _units(spark, sf)).select("req_id", "building", "pos", "ref", "matched")


@register("g13_parcel_metrics", """WITH b AS (SELECT l_partkey, sum(l_quantity) AS built, max(l_linenumber) AS floors, sum(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS ground, count(DISTINCT l_suppkey) AS streets FROM lineitem GROUP BY ALL)
SELECT p_partkey AS parcel_ref, round(coalesce(built, 0) / (p_size * 1e2 + 37e0), 4) AS built_ratio, round(coalesce(ground, 0) / (p_size * 1e2 + 37e0), 4) AS coverage, coalesce(floors, 0) AS floors,
coalesce(streets, 0) >= 2 AS through_parcel FROM part LEFT JOIN b ON l_partkey = p_partkey""")
def _(spark, sf):
    li = D.table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "parcel_ref")
    parcels = D.table(spark, sf, "part").select(F.col("p_partkey").alias("parcel_ref"), (F.col("p_size") * F.lit(100.0) + F.lit(37.0)).alias("area"))
    units = li.select("parcel_ref", F.col("l_quantity").alias("area"), F.col("l_linenumber").alias("floor_no"))
    return P.parcel_metrics(parcels, units, units.filter("floor_no = 1"), li.select("parcel_ref", F.col("l_suppkey").alias("via")))


@register("g14_round_trip", f"""{D.with_shared('points')} SELECT point_id, round({MERC_X}, 3) AS x, round({MERC_Y}, 3) AS y, 'excellent' AS grade FROM points""")
def _(spark, sf):
    return SP.round_trip(_points(spark, sf)).select("point_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "grade")


# ------------------------------------------------------------------ building units


COMMON = f"contains({USE}, 'COMUN')"
PAIRED = f"""{UNITS}, nx AS (SELECT *, lead({USE}) OVER w AS nu, lead(area) OVER w AS na FROM units WINDOW w AS (PARTITION BY building ORDER BY pos)),
paired AS (SELECT *, CASE WHEN contains(coalesce(nu, ''), 'COMUN') THEN na ELSE 0e0 END AS common_area FROM nx WHERE NOT {COMMON})"""
FIRST = ", ".join(f"coalesce(first(CASE WHEN {c} <> '' THEN {c} END ORDER BY CASE WHEN {c} <> '' THEN pos END NULLS LAST), '') AS {c}" for c in ("stair", "floor", "door"))
CONSOLIDATED = f"""{PAIRED}, cons AS (SELECT building, ref, first({USE} ORDER BY pos) AS {USE}, sum(area) AS area, sum(common_area) AS common_area, {FIRST} FROM paired GROUP BY building, ref)"""


@register("w03_common_area_pairs", f"{PAIRED} SELECT building, pos, ref, {USE}, area, common_area FROM paired")
def _(spark, sf):
    return P.pair_common_areas(_units(spark, sf)).select("building", "pos", "ref", "use", "area", "common_area")


@register("a10_units_by_use", f"{UNITS} SELECT building, {USE}, count(*) AS units, sum(area) AS area FROM units GROUP BY ALL")
def _(spark, sf):
    return P.use_summary(_units(spark, sf))


@register("a10_use_totals", f"""{UNITS}, s AS (SELECT building, {USE}, count(*) AS n, sum(area) AS a FROM units GROUP BY ALL)
SELECT building, sum(n)::BIGINT AS units, sum(a) AS area, string_agg({USE} || ':' || CAST(n AS VARCHAR), ',' ORDER BY {USE}) AS by_use FROM s GROUP BY building""")
def _(spark, sf):
    m = P.use_map(_units(spark, sf))
    listed = F.array_sort(F.transform(F.map_entries("by_use"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["units"].cast("string"))))
    return m.select("building", "units", "area", F.array_join(listed, ",").alias("by_use"))


@register("a11_consolidated_units", f"{CONSOLIDATED} SELECT building, ref, {USE}, area, common_area, stair, floor, door FROM cons")
def _(spark, sf):
    return P.consolidate_units(P.pair_common_areas(_units(spark, sf)))


@register("a12_unit_table", f"""{CONSOLIDATED} SELECT building, ref, area, common_area, area + common_area AS total FROM cons UNION ALL
SELECT building, 'TOTAL', sum(area), sum(common_area), sum(area + common_area) FROM cons GROUP BY building""")
def _(spark, sf):
    t = P.unit_table(P.consolidate_units(P.pair_common_areas(_units(spark, sf))))
    return t.select("building", F.coalesce("ref", F.lit("TOTAL")).alias("ref"), "area", "common_area", "total")


@register("w06_stair_floor_order", f"{UNITS} SELECT building, pos, nullif(stair, '') AS stair, nullif(floor, '') AS floor FROM units ORDER BY stair NULLS FIRST, floor NULLS FIRST")
def _(spark, sf):
    u = _units(spark, sf).select("building", "pos", F.nullif("stair", F.lit("")).alias("stair"), F.nullif("floor", F.lit("")).alias("floor"))
    return P.by_stair_floor(u)


@register("x01_w08_own_and_additional_units", f"""{UNITS}, b AS (SELECT ref, pos, area, 0 AS o FROM units WHERE pos % 2 = 1 UNION ALL SELECT ref, pos, area, 1 FROM units WHERE pos % 2 = 0)
SELECT ref, pos, area FROM b QUALIFY row_number() OVER (PARTITION BY ref ORDER BY o DESC, pos DESC) = 1""")
def _(spark, sf):
    u = _units(spark, sf).select("ref", "pos", "area")
    return P.all_known_units(u.filter("pos % 2 = 1"), u.filter("pos % 2 = 0"))


@register("j15_cadastral_layers", """SELECT l_orderkey AS building_id, l_linenumber, p_partkey AS refcat, p_brand AS masa, b.area AS block_area, n_name AS street_name
FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN (SELECT CASE WHEN p_size > 10 THEN p_brand ELSE 'small' END AS masa, CAST(sum(p_size) AS BIGINT) AS area FROM part GROUP BY 1) b ON b.masa = p_brand
LEFT JOIN nation ON n_nationkey = p_partkey % 30""")
def _(spark, sf):
    part = D.table(spark, sf, "part")
    layers = part.select(F.col("p_partkey").alias("refcat"), F.col("p_brand").alias("masa"), (F.col("p_partkey") % 30).alias("via"))
    buildings = D.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("refcat"), F.col("l_orderkey").alias("building_id"), "l_linenumber")
    blocks = part.groupBy(F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise("small").alias("masa")).agg(F.sum("p_size").alias("block_area"))
    streets = D.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("via"), F.col("n_name").alias("street_name"))
    return P.cadastral_layers(layers, buildings, blocks, streets).drop("via")
