"""Geometry as Column expressions: projection, distance, areas and polygons as ring arrays.

A polygon is ``array<array<struct<lon double, lat double>>>`` with closed rings (first point = last point).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark.functions import fixed as X
from regspark.functions.text import _col, let

DEG = math.pi / 180.0
METRES_PER_DEGREE = X.MEAN_EARTH_RADIUS * DEG


def mercator_x(lon: Column | str) -> Column:
    """G1: Web Mercator easting in metres."""
    return F.radians(_col(lon)) * F.lit(X.EARTH_RADIUS)


def mercator_y(lat: Column | str) -> Column:
    """G1: Web Mercator northing in metres."""
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(_col(lat)) / F.lit(2.0))) * F.lit(X.EARTH_RADIUS)


def lon_of(x: Column | str) -> Column:
    return F.degrees(_col(x) / F.lit(X.EARTH_RADIUS))


def lat_of(y: Column | str) -> Column:
    return F.degrees(F.lit(2.0) * F.atan(F.exp(_col(y) / F.lit(X.EARTH_RADIUS))) - F.lit(math.pi / 2))


def rings_to_wgs84(rings: Column | str) -> Column:
    """G1: ``array<array<array<double>>>`` of x,y pairs to lon/lat rings."""
    return F.transform(_col(rings), lambda r: F.transform(r, lambda p: F.struct(
        lon_of(p[0]).alias("lon"), lat_of(p[1]).alias("lat"))))


def multipolygon_json(rings: Column | str) -> Column:
    """G1: GeoJSON MultiPolygon text, longitude first."""
    coords = F.transform(_col(rings), lambda r: F.transform(r, lambda p: F.array(p["lon"], p["lat"])))
    return F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(coords).alias("coordinates")))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres on the mean sphere."""
    dlat, dlon = F.radians(lat2 - lat1) / 2.0, F.radians(lon2 - lon1) / 2.0
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2.0 * X.MEAN_EARTH_RADIUS) * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


@F.pandas_udf(T.DoubleType())
def ellipsoidal(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """Distance in metres on the WGS84 ellipsoid (Vincenty inverse, vectorised over the batch)."""
    a, f = 6378137.0, 1 / 298.257223563
    b = (1 - f) * a
    p1, p2, dl = np.radians(lat1.to_numpy()), np.radians(lat2.to_numpy()), np.radians((lon2 - lon1).to_numpy())
    u1, u2 = np.arctan((1 - f) * np.tan(p1)), np.arctan((1 - f) * np.tan(p2))
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = dl.copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(100):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
            cs = su1 * su2 + cu1 * cu2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0.0, cu1 * cu2 * sl / np.where(ss == 0, 1, ss))
            c2a = 1 - sa**2
            c2m = np.where(c2a == 0, 0.0, cs - 2 * su1 * su2 / np.where(c2a == 0, 1, c2a))
            c = f / 16 * c2a * (4 + f * (4 - 3 * c2a))
            new = dl + (1 - c) * f * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
            done = np.nanmax(np.abs(new - lam), initial=0.0) < 1e-12
            lam = new
            if done:
                break
        usq = c2a * (a**2 - b**2) / b**2
        big_a = 1 + usq / 16384 * (4096 + usq * (-768 + usq * (320 - 175 * usq)))
        big_b = usq / 1024 * (256 + usq * (-128 + usq * (74 - 47 * usq)))
        ds = big_b * ss * (c2m + big_b / 4 * (cs * (2 * c2m**2 - 1) - big_b / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
    return pd.Series(b * big_a * (sigma - ds))


def in_service_area(lat: Column | str, lon: Column | str) -> Column:
    """Inside both service boxes."""
    lat, lon = _col(lat), _col(lon)
    out = F.lit(True)
    for lat0, lat1, lon0, lon1 in X.SERVICE_BOXES:
        out &= lat.between(F.lit(lat0), F.lit(lat1)) & lon.between(F.lit(lon0), F.lit(lon1))
    return out


def bbox(rings: Column | str) -> dict[str, Column]:
    pts = F.flatten(_col(rings))
    return {"xmin": F.array_min(F.transform(pts, lambda p: p["lon"])), "xmax": F.array_max(F.transform(pts, lambda p: p["lon"])),
            "ymin": F.array_min(F.transform(pts, lambda p: p["lat"])), "ymax": F.array_max(F.transform(pts, lambda p: p["lat"]))}


def _edges(ring: Column, f) -> Column:
    n = F.size(ring)
    return F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), f)


def contains_point(rings: Column, lon: Column, lat: Column) -> Column:
    """Even-odd ray casting over all rings (holes included); half-open, so adjacent polygons never both match."""
    def crossing(p: Column, q: Column) -> Column:
        spans = (p["lat"] > lat) != (q["lat"] > lat)
        at = p["lon"] + (lat - p["lat"]) / F.nullif(q["lat"] - p["lat"], F.lit(0.0)) * (q["lon"] - p["lon"])
        return F.when(spans & (lon < at), 1).otherwise(0)

    count = F.aggregate(F.flatten(F.transform(rings, lambda r: _edges(r, crossing))), F.lit(0), lambda a, x: a + x)
    return count % 2 == 1


def distance_to_rings(rings: Column, lon: Column, lat: Column) -> Column:
    """Metres from a point to the nearest polygon edge, in the local plane of the point.

    Every step is its own transform, so no term is computed twice per edge.
    """
    kx, ky = F.cos(F.radians(lat)) * F.lit(METRES_PER_DEGREE), F.lit(METRES_PER_DEGREE)

    def local(p: Column, q: Column) -> Column:
        return F.struct(((p["lon"] - lon) * kx).alias("x"), ((p["lat"] - lat) * ky).alias("y"),
                        ((q["lon"] - p["lon"]) * kx).alias("dx"), ((q["lat"] - p["lat"]) * ky).alias("dy"))

    def foot(e: Column) -> Column:
        t = -(e["x"] * e["dx"] + e["y"] * e["dy"]) / F.nullif(e["dx"] * e["dx"] + e["dy"] * e["dy"], F.lit(0.0))
        return F.struct(e.alias("e"), F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), F.lit(0.0)).alias("t"))

    def gap(f: Column) -> Column:
        return F.hypot(f["e"]["x"] + f["t"] * f["e"]["dx"], f["e"]["y"] + f["t"] * f["e"]["dy"])

    edges = F.flatten(F.transform(rings, lambda r: _edges(r, local)))
    return F.array_min(F.transform(F.transform(edges, foot), gap))


def centroid(rings: Column | str) -> Column:
    """``struct<lon, lat>`` of the outer ring (shoelace, relative to its first point)."""
    ring = _col(rings)[0]
    x0, y0 = ring[0]["lon"], ring[0]["lat"]

    def part(p: Column, q: Column) -> Column:
        px, py, qx, qy = p["lon"] - x0, p["lat"] - y0, q["lon"] - x0, q["lat"] - y0
        w = px * qy - qx * py
        return F.struct(w.alias("w"), ((px + qx) * w).alias("x"), ((py + qy) * w).alias("y"))

    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    total = F.aggregate(_edges(ring, part), zero, lambda a, e: F.struct(
        (a["w"] + e["w"]).alias("w"), (a["x"] + e["x"]).alias("x"), (a["y"] + e["y"]).alias("y")))
    area3 = F.nullif(total["w"] * 3.0, F.lit(0.0))
    return F.struct((x0 + F.coalesce(total["x"] / area3, F.lit(0.0))).alias("lon"),
                    (y0 + F.coalesce(total["y"] / area3, F.lit(0.0))).alias("lat"))


def ring_area(rings: Column | str) -> Column:
    """Square metres of the outer ring in its local plane."""
    ring = _col(rings)[0]
    x0, y0 = ring[0]["lon"], ring[0]["lat"]
    twice = F.aggregate(_edges(ring, lambda p, q: (p["lon"] - x0) * (q["lat"] - y0) - (q["lon"] - x0) * (p["lat"] - y0)),
                        F.lit(0.0), lambda a, e: a + e)
    return F.abs(twice) / 2.0 * F.lit(METRES_PER_DEGREE) * F.lit(METRES_PER_DEGREE) * F.cos(F.radians(y0))


def _depths(rings: Column) -> Column:
    """How many other rings hold the first point of each ring: even for an outer ring, odd for a hole."""
    def depth(ring: Column, i: Column) -> Column:
        inside = F.transform(rings, lambda other, j: F.when((j != i) & contains_point(F.array(other), ring[0]["lon"], ring[0]["lat"]), 1).otherwise(0))
        return F.aggregate(inside, F.lit(0), lambda a, x: a + x)

    return F.transform(rings, depth)


def parts(rings: Column | str) -> Column:
    """The polygons of a shape as ``array<array<ring>>``: each outer ring with its holes behind it, in order of the outer rings.

    A shape of one ring is a shape of one part. Rings are told apart by what holds them, not by their direction; rings of a shape must not
    cross. An island in a hole is a part of its own. Null stays null.
    """
    def grouped(marked: Column) -> Column:
        own = lambda o: F.filter(marked, lambda h: (h["depth"] == o["depth"] + 1) & contains_point(F.array(o["ring"]), h["ring"][0]["lon"], h["ring"][0]["lat"]))
        return F.transform(F.filter(marked, lambda o: o["depth"] % 2 == 0), lambda o: F.concat(F.array(o["ring"]), F.transform(own(o), lambda h: h["ring"])))

    # the rings are computed once, as is what each ring is compared with
    return let(_col(rings), lambda rings: let(F.zip_with(rings, _depths(rings), lambda r, k: F.struct(r.alias("ring"), k.alias("depth"))), grouped))


def _moments(ring: Column) -> Column:
    """``struct<a, x, y>``: unsigned area of a ring in square degrees, and its centroid (its first point if the area is zero)."""
    x0, y0 = ring[0]["lon"], ring[0]["lat"]

    def part(p: Column, q: Column) -> Column:
        px, py, qx, qy = p["lon"] - x0, p["lat"] - y0, q["lon"] - x0, q["lat"] - y0
        w = px * qy - qx * py
        return F.struct(w.alias("w"), ((px + qx) * w).alias("x"), ((py + qy) * w).alias("y"))

    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    total = F.aggregate(_edges(ring, part), zero, lambda a, e: F.struct((a["w"] + e["w"]).alias("w"), (a["x"] + e["x"]).alias("x"), (a["y"] + e["y"]).alias("y")))
    return let(total, lambda t: F.struct((F.abs(t["w"]) / 2).alias("a"), (x0 + F.coalesce(t["x"] / F.nullif(t["w"] * 3.0, F.lit(0.0)), F.lit(0.0))).alias("x"),
                                           (y0 + F.coalesce(t["y"] / F.nullif(t["w"] * 3.0, F.lit(0.0)), F.lit(0.0))).alias("y")))


def parts_centroid(shape: Column | str) -> Column:
    """``struct<lon, lat>`` of all parts (``array<array<ring>>``) without their holes; of the first outer ring where the area is zero."""
    weighed = F.flatten(F.transform(_col(shape), lambda p: F.transform(p, lambda r, i: let(_moments(r), lambda m: F.struct(F.when(i == 0, m["a"]).otherwise(-m["a"]).alias("a"), m["x"].alias("x"), m["y"].alias("y"))))))

    def mean(w: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        total = F.aggregate(w, zero, lambda s, m: F.struct((s["a"] + m["a"]).alias("a"), (s["x"] + m["a"] * m["x"]).alias("x"), (s["y"] + m["a"] * m["y"]).alias("y")))
        return let(total, lambda t: F.struct(F.coalesce(t["x"] / F.nullif(t["a"], F.lit(0.0)), w[0]["x"]).alias("lon"), F.coalesce(t["y"] / F.nullif(t["a"], F.lit(0.0)), w[0]["y"]).alias("lat")))

    return let(weighed, mean)


def parts_area(shape: Column | str) -> Column:
    """Square metres of all parts (``array<array<ring>>``) without their holes, each ring in its local plane."""
    signed = F.flatten(F.transform(_col(shape), lambda p: F.transform(p, lambda r, i: F.when(i == 0, ring_area(F.array(r))).otherwise(-ring_area(F.array(r))))))
    return F.aggregate(signed, F.lit(0.0), lambda a, x: a + x)


def parts_contain(shape: Column, lon: Column, lat: Column) -> Column:
    """Whether a point lies in some part and in none of its holes."""
    return F.exists(shape, lambda p: contains_point(p, lon, lat))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Closed rectangle as rings."""
    def pt(x: Column, y: Column) -> Column:
        return F.struct(x.alias("lon"), y.alias("lat"))

    return F.array(F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1), pt(x0, y0)))
