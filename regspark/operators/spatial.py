"""Spatial joins on grid cells: equal cell first, exact geometry after.

Polygons repeat once per cell they cover, in a cell size that fits them; points have one cell per size in use.
A crowded cell is split by Spark's adaptive skew join, so one city block with a third of all points does not become one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regspark.functions import fixed as X
from regspark.functions import geometry as G
from regspark.operators.ordered import row_numbers
from regspark.session import cut_lineage


MAX_LEVEL = 20  # at cell 0.001 degrees a level-20 cell is wider than the globe
CELL = ["_lv", "_cx", "_cy"]


def _with_level(polygons: DataFrame, cell: float) -> DataFrame:
    """Bounding box and grid level: cells double per level until a polygon spans about four of them per axis."""
    box = G.bbox("rings")
    p = polygons.filter(F.col("rings").isNotNull()).withColumn("_box", F.struct(*[c.alias(n) for n, c in box.items()]))
    extent = F.greatest(F.col("_box.xmax") - F.col("_box.xmin"), F.col("_box.ymax") - F.col("_box.ymin"))
    level = F.ceil(F.log2(F.greatest(extent / F.lit(4 * cell), F.lit(1.0))))
    return p.withColumn("_lv", F.least(level, F.lit(MAX_LEVEL)).cast("int"))


def _cells(polygons: DataFrame, cell: float, margin: int, pad_lon: Column | None = None) -> DataFrame:
    """One row per (polygon, covered cell of its level); a large polygon gets large cells, never many small ones."""
    p, size = _with_level(polygons, cell), F.lit(cell) * F.pow(F.lit(2.0), F.col("_lv"))
    p = _wrapped(p, margin * size if pad_lon is None else F.greatest(margin * size, pad_lon))

    def span(lo: str, hi: str, pad):
        return F.sequence(F.floor((F.col("_box")[lo] - pad) / size).cast("long") - margin, F.floor((F.col("_box")[hi] + pad) / size).cast("long") + margin)

    wide = F.lit(0.0) if pad_lon is None else pad_lon
    return p.withColumn("_cx", F.explode(span("xmin", "xmax", wide))).withColumn("_cy", F.explode(span("ymin", "ymax", F.lit(0.0))))


def _wrapped(p: DataFrame, reach: Column) -> DataFrame:
    """Polygons within ``reach`` degrees of longitude 180 also stand on the other side of it."""
    box, none = F.col("_box"), F.array().cast("array<double>")
    turns = F.concat(F.array(F.lit(0.0)), F.when(box["xmin"] - reach < -180, F.array(F.lit(360.0))).otherwise(none),
                     F.when(box["xmax"] + reach > 180, F.array(F.lit(-360.0))).otherwise(none))
    q, by = p.withColumn("_turn", F.explode(turns)), F.col("_turn")
    shifted = F.struct((box["xmin"] + by).alias("xmin"), (box["xmax"] + by).alias("xmax"), box["ymin"].alias("ymin"), box["ymax"].alias("ymax"))
    return q.withColumn("_box", shifted)


def _turned(p: DataFrame) -> DataFrame:
    """Rings moved by ``_turn`` degrees of longitude, as their box is."""
    by = F.col("_turn")
    moved = F.transform("rings", lambda r: F.transform(r, lambda x: F.struct((x["lon"] + by).alias("lon"), x["lat"].alias("lat"))))
    return p.withColumn("rings", F.when(by == 0, F.col("rings")).otherwise(moved)).drop("_turn")


def _pointed(points: DataFrame, cell: float, levels: list[int]) -> DataFrame:
    """One row per point and grid level in use (mostly one)."""
    def at(level: int):
        size = cell * 2.0**level
        return F.struct(F.lit(level).alias("_lv"), F.floor(F.col("lon") / F.lit(size)).cast("long").alias("_cx"),
                        F.floor(F.col("lat") / F.lit(size)).cast("long").alias("_cy"))

    return points.select("*", F.inline(F.array(*[at(n) for n in levels])))


def _candidates(points: DataFrame, polygons: DataFrame, poly_id: str, cell: float, margin: int, pad_lon: Column | None = None) -> DataFrame:
    """Point-polygon pairs that share a cell; the list of levels has at most 21 values. Only boxes are copied to the cells, the
    rings join the pairs that callers leave after a test of the box. Sizes are guessed before cells are exploded and rings are
    built, so both joins are merges: no side goes whole through the driver."""
    levels = sorted(r["_lv"] for r in _with_level(polygons, cell).select("_lv").distinct().collect()) or [0]
    boxes = _cells(polygons, cell, margin, pad_lon).select(poly_id, "_box", "_turn", *CELL)
    met = _pointed(points, cell, levels).join(boxes.hint("merge"), CELL)
    return _turned(met.join(polygons.select(poly_id, "rings").hint("merge"), poly_id))


def _near_box(pad_lon=0.0, pad_lat=0.0):
    """Cheap test before exact geometry: the point lies in the padded bounding box."""
    b, lon, lat = F.col("_box"), F.col("lon"), F.col("lat")
    return (lon >= b["xmin"] - pad_lon) & (lon <= b["xmax"] + pad_lon) & (lat >= b["ymin"] - pad_lat) & (lat <= b["ymax"] + pad_lat)


def point_in_polygon(points: DataFrame, polygons: DataFrame, point_id: str, poly_id: str, cell: float = 0.01) -> DataFrame:
    """The polygon of each point (smallest id when several). Points outside every polygon are left out.

    ``points``: point_id, lon, lat. ``polygons``: poly_id, rings. Returns point_id, poly_id.
    """
    j = _candidates(points.select(point_id, "lon", "lat"), polygons.select(poly_id, "rings"), poly_id, cell, 0)
    inside = j.filter(_near_box() & G.contains_point(F.col("rings"), F.col("lon"), F.col("lat")))
    return inside.groupBy(point_id).agg(F.min(poly_id).alias(poly_id))


def polygons_within(points: DataFrame, polygons: DataFrame, point_id: str, poly_id: str, metres: float) -> DataFrame:
    """The nearest polygon within ``metres`` of each point (0 inside), ties to the smaller id.

    One ring of cells around a polygon, wider in longitude towards the poles, holds every point in reach.
    """
    cell = metres / G.METRES_PER_DEGREE / 0.17
    north = F.greatest(F.abs(F.col("_box.ymin")), F.abs(F.col("_box.ymax"))) + 1.001 * metres / G.METRES_PER_DEGREE
    pad_lon = F.least(F.lit(180.0), 1.001 * metres / G.METRES_PER_DEGREE / F.cos(F.radians(F.least(north, F.lit(89.9999)))))
    j = _candidates(points.select(point_id, "lon", "lat"), polygons.select(poly_id, "rings"), poly_id, cell, 1, pad_lon)
    d = F.when(G.contains_point(F.col("rings"), F.col("lon"), F.col("lat")), F.lit(0.0)) \
        .otherwise(G.distance_to_rings(F.col("rings"), F.col("lon"), F.col("lat")))
    reach = 1.001 * metres / G.METRES_PER_DEGREE
    near = j.filter(_near_box(reach / F.cos(F.radians(F.least(F.abs("lat"), F.lit(89.9999)))), reach))
    near = near.select(point_id, poly_id, F.round(d, 3).alias("metres")).filter(F.col("metres") <= metres)
    best = near.groupBy(point_id).agg(F.min(F.struct("metres", poly_id)).alias("b"))
    return best.select(point_id, f"b.{poly_id}", "b.metres")


def nearest_polygon(points: DataFrame, polygons: DataFrame, point_id: str, poly_id: str, cell: float = 0.01,
                    growth: int = 8) -> DataFrame:
    """The nearest polygon of every point, at any distance, ties to the smaller id. Returns point_id, poly_id, metres.

    Points with an answer in the ring of cells around them that no polygon outside can beat are done; the others go down a
    pyramid of occupied cells (``nearest_by_pyramid``). Polygons without an edge and points without a place have no answer.
    """
    kx = G.METRES_PER_DEGREE * F.cos(F.radians(F.least(F.abs("lat"), F.lit(89.0))))
    shapes = polygons.select(poly_id, "rings").filter(F.exists("rings", lambda r: F.size(r) > 1))
    rest = points.select(point_id, "lon", "lat")
    best = _candidates(rest, shapes, poly_id, cell, 1).select(point_id, F.struct(_metres().alias("metres"), F.col(poly_id)).alias("b")) \
        .groupBy(point_id).agg(F.min("b").alias("b"))
    near = cut_lineage(rest.join(best, point_id, "left").withColumn("sure", F.coalesce(F.col("b.metres") <= kx * cell, F.lit(False))))
    found = near.filter("sure").select(point_id, f"b.{poly_id}", "b.metres")
    rest = near.filter("not sure").select(point_id, "lon", "lat")
    return found if rest.isEmpty() else found.unionByName(nearest_by_pyramid(rest, shapes, point_id, poly_id, cell, growth))


def _metres() -> Column:
    inside = G.contains_point(F.col("rings"), F.col("lon"), F.col("lat"))
    return F.round(F.when(inside, F.lit(0.0)).otherwise(G.distance_to_rings(F.col("rings"), F.col("lon"), F.col("lat"))), 3)


def nearest_by_pyramid(points: DataFrame, polygons: DataFrame, point_id: str, poly_id: str, cell: float, growth: int = 8) -> DataFrame:
    """The nearest polygon at any distance, by exact geometry on ``pyramid_pairs``."""
    pairs = pyramid_pairs(points, polygons, point_id, poly_id, cell, growth)
    best = pairs.select(point_id, F.struct(_metres().alias("metres"), F.col(poly_id)).alias("b")).groupBy(point_id).agg(F.min("b").alias("b"))
    return best.select(point_id, f"b.{poly_id}", "b.metres")


def pyramid_pairs(points: DataFrame, polygons: DataFrame, point_id: str, poly_id: str, cell: float, growth: int = 8) -> DataFrame:
    """Each point with the polygons that may be its nearest, best bounds first. Polygons have at least one edge.

    Each polygon stands in one cell of each level, that of the middle of its box; a cell knows the box around what it holds. A point
    starts with the few cells of a level wider than the globe. At each level the farthest corner of the best box bounds the answer, boxes
    that begin beyond it go, and the others give way to their cells of the next finer level, at last to the boxes of polygons. Equal
    shapes are one, under their smallest id.
    """
    own = polygons.groupBy("rings").agg(F.min(poly_id).alias(poly_id))
    box = F.struct(*[c.alias(n) for n, c in G.bbox("rings").items()])
    size, levels = cell / growth, 0
    while size * growth**levels < 360:
        levels += 1
    own = own.withColumn("_box", box)
    own = cut_lineage(own.withColumns({"_cx": F.floor((F.col("_box.xmin") + F.col("_box.xmax")) / (2 * size)).cast("long"),
                                       "_cy": F.floor((F.col("_box.ymin") + F.col("_box.ymax")) / (2 * size)).cast("long")}))
    at = lambda n: F.struct(F.lit(n).alias("_lv"), *[F.floor(F.col(c) / F.lit(float(growth**n))).cast("long").alias(c) for c in ("_cx", "_cy")])
    cells = cut_lineage(own.select("_box", F.inline(F.array(*[at(n) for n in range(levels + 1)]))).groupBy(*CELL).agg(F.struct(
        *[f(F.col("_box")[c]).alias(c) for c, f in (("xmin", F.min), ("xmax", F.max), ("ymin", F.min), ("ymax", F.max))]).alias("_box")))

    # a point is also seen from the other side of longitude 180
    seen = points.select(point_id, "lat", F.explode(F.array(*[F.col("lon") + turn for turn in (0.0, 360.0, -360.0)])).alias("lon"))
    front = _in_bounds(seen.withColumn("_lv", F.lit(levels)).join(F.broadcast(cells.filter(F.col("_lv") == levels)), "_lv"), point_id)
    for n in reversed(range(levels)):
        parent = [F.floor(F.col(c) / F.lit(growth)).cast("long").alias(c) for c in ("_cx", "_cy")]
        finer = cells.filter(F.col("_lv") == n).select(*parent, F.struct("_cx", "_cy", "_box").alias("_c"))
        front = front.select(point_id, "lon", "lat", "_cx", "_cy").join(finer, ["_cx", "_cy"])
        front = _in_bounds(front.select(point_id, "lon", "lat", "_c.*"), point_id)
    last = front.select(point_id, "lon", "lat", "_cx", "_cy").join(own.select(poly_id, "_box", "_cx", "_cy"), ["_cx", "_cy"])
    return _in_bounds(last, point_id).select(point_id, "lon", "lat", poly_id).join(own.select(poly_id, "rings"), poly_id)


def _in_bounds(front: DataFrame, point_id: str) -> DataFrame:
    """Rows of which the box may hold the nearest polygon of the point; two millimetres more, as distances are rounded."""
    b, lon, lat, none = F.col("_box"), F.col("lon"), F.col("lat"), F.lit(0.0)
    kx, ky = F.cos(F.radians(lat)) * F.lit(G.METRES_PER_DEGREE), F.lit(G.METRES_PER_DEGREE)
    least = F.hypot(F.greatest(b["xmin"] - lon, lon - b["xmax"], none) * kx, F.greatest(b["ymin"] - lat, lat - b["ymax"], none) * ky)
    most = F.hypot(F.greatest(F.abs(b["xmin"] - lon), F.abs(b["xmax"] - lon)) * kx, F.greatest(F.abs(b["ymin"] - lat), F.abs(b["ymax"] - lat)) * ky)
    bound = F.min(most).over(Window.partitionBy(point_id))
    return front.withColumns({"_least": least, "_bound": bound}).filter(F.col("_least") <= F.col("_bound") + 0.002).drop("_least", "_bound")


def zone_of_parcels(parcels: DataFrame, zones: DataFrame, parcel_id: str = "parcel_ref", zone_id: str = "zone_id",
                    cell: float = 0.01) -> DataFrame:
    """Zone holding the parcel centroid ('centroide'), else the nearest zone ('proximidad')."""
    c = parcels.select(parcel_id, G.centroid("rings").alias("c")).select(parcel_id, "c.lon", "c.lat")
    inside = cut_lineage(point_in_polygon(c, zones, parcel_id, zone_id, cell))  # read again by the anti join and the union
    near = nearest_polygon(c.join(inside.select(parcel_id), parcel_id, "left_anti"), zones, parcel_id, zone_id, cell)
    return inside.select(parcel_id, zone_id, F.lit("centroide").alias("method"), F.lit(0.0).alias("metres")).unionByName(
        near.select(parcel_id, zone_id, F.lit("proximidad").alias("method"), "metres"))


def lookup_parcel(points: DataFrame, parcels: DataFrame, point_id: str, parcel_id: str = "parcel_ref",
                  metres: float = X.NEARBY_METRES) -> DataFrame:
    """Parcel under each point; misses get the nearest parcel within reach, with distance and flag. The hits, which grow with
    the points, are computed once and joined by merge, so they do not go through the driver."""
    exact = cut_lineage(point_in_polygon(points, parcels, point_id, parcel_id, 0.001))  # read again by the anti join and the union
    missed = points.join(exact.select(point_id).hint("merge"), point_id, "left_anti")
    near = polygons_within(missed, parcels, point_id, parcel_id, metres)
    return exact.select(point_id, parcel_id, F.lit(0.0).alias("metres"), F.lit(False).alias("by_proximity")).unionByName(
        near.select(point_id, parcel_id, "metres", F.lit(True).alias("by_proximity")))


def land_class_zone(points: DataFrame, classes: DataFrame, urban: DataFrame, rustic: DataFrame, point_id: str,
                    cell: float = 0.01) -> DataFrame:
    """Land class of each point, then the ordinance of the urban or the rustic layer by class.

    Layers: class_id/land_class/rings and ord_id/ordinance/rings. Points outside every class are left out.
    """
    base = point_in_polygon(points, classes, point_id, "class_id", cell).join(classes.drop("rings"), ["class_id"])
    placed = points.join(base, point_id)

    def layer(kinds: list[str], polygons: DataFrame) -> DataFrame:
        hit = point_in_polygon(placed.filter(F.col("land_class").isin(kinds)).select(point_id, "lon", "lat"), polygons,
                               point_id, "ord_id", cell)
        return hit.join(polygons.drop("rings"), ["ord_id"]).select(point_id, "ordinance")

    ords = layer(X.URBAN_CLASSES, urban).unionByName(layer(X.RUSTIC_CLASSES, rustic))
    return base.join(ords, point_id, "left")


def zone_rows(features: DataFrame) -> DataFrame:
    """Zone rows of urban features (pos, ordinance, name, rings in Web Mercator); no geometry, no zone.

    Codes count per ordinance in feature order: ``U1.1-0001``.
    """
    f = features.filter(F.col("rings").isNotNull()).withColumn("ordinance", F.coalesce("ordinance", F.lit("DESCONOCIDO")))
    n = row_numbers(f, ["ordinance"], "pos", "_n")
    digits = F.col("_n").cast("string")
    padded = F.when(F.length(digits) >= 4, digits).otherwise(F.lpad(digits, 4, "0"))
    none = F.lit(None).cast("double")
    return n.select("pos", F.concat("ordinance", F.lit("-"), padded).alias("code"), "ordinance",
                    F.coalesce("name", F.lit("")).alias("name"), F.lit("Suelo Urbano").alias("land_class"),
                    G.rings_to_wgs84("rings").alias("rings"), none.alias("max_height"), none.alias("buildability"),
                    none.alias("max_occupation"))


def class_rows(features: DataFrame) -> DataFrame:
    """Zone rows of land-classification features (class, class_desc, cod, rings in Web Mercator)."""
    f = features.filter(F.col("rings").isNotNull())
    return f.select(F.coalesce("cod", "class", F.lit("DESCONOCIDO")).alias("code"), F.lit(None).cast("string").alias("ordinance"),
                    F.coalesce("class_desc", F.lit("")).alias("name"), F.coalesce("class_desc", "class", F.lit("")).alias("land_class"),
                    G.rings_to_wgs84("rings").alias("rings"))


def round_trip(points: DataFrame) -> DataFrame:
    """Projection there and back with the error in metres and its grade."""
    lat2, lon2 = G.lat_of(G.mercator_y("lat")), G.lon_of(G.mercator_x("lon"))
    err = G.haversine(F.col("lat"), F.col("lon"), lat2, lon2)
    return points.withColumns({"x": G.mercator_x("lon"), "y": G.mercator_y("lat")}).withColumn("error_m", err).withColumn(
        "grade", F.when(F.col("error_m") < 0.001, "excellent").when(F.col("error_m") < 1, "acceptable").otherwise("bad"))
