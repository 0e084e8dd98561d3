"""Cadastre service answers (JSON and XML) to flat rows.

Fields that come as an object or as a list are read through VARIANT paths, so both shapes give the same row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.functions import text as C


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _one(v: Column, path: str) -> Column:
    """The value at a path, or its first element when it is a list."""
    return F.coalesce(_get(v, f"{path}[0]", "variant"), F.when(_get(v, path, "array<variant>").isNull(), _get(v, path, "variant")))


def _many(v: Column, path: str) -> Column:
    """A list at a path; a single object becomes a list of one."""
    single = _get(v, path, "variant")
    return F.coalesce(_get(v, path, "array<variant>"), F.when(single.isNotNull(), F.array(single)))


def _failed(v: Column) -> Column:
    """The answer carries an error list."""
    return _get(v, "$.lerr[0]", "variant").isNotNull()


def _property(df: DataFrame) -> DataFrame:
    v = F.try_parse_json("raw")
    d = df.withColumn("_v", F.coalesce(_get(v, "$.consulta_dnprcResult", "variant"), _get(v, "$.consulta_dnprc", "variant")))
    d = d.filter(F.col("_v").isNotNull() & ~_failed(F.col("_v"))).withColumn("_b", _one(F.col("_v"), "$.bico"))
    return d.filter(F.col("_b").isNotNull()).withColumn("ref", C.clean_reference("ref"))


def property_rows(df: DataFrame) -> DataFrame:
    """One flat row per property answer. ``df``: ref, raw."""
    d = _property(df).withColumn("_i", _one(F.col("_b"), "$.bi"))
    b, i = F.col("_b"), F.col("_i")
    street = "$.dt.locs.lous.lourb"
    ground = F.coalesce(_get(b, "$.finca.dff.ss"), _get(b, "$.finca.dff.ssf.ss"))
    return d.select(
        "ref", C.land_kind(F.coalesce(_get(i, "$.idbi.cn"), F.lit(""))).alias("land_kind"), _get(i, "$.ldt").alias("address"),
        _get(i, "$.dt.np").alias("province"), _get(i, "$.dt.nm").alias("town"), _get(i, street + ".dp").alias("postcode"),
        _get(i, street + ".dir.tv").alias("street_type"), _get(i, street + ".dir.nv").alias("street_name"),
        _get(i, street + ".dir.pnp").alias("house_number"), _get(i, "$.debi.luso").alias("use"),
        C.decimal_comma(_get(i, "$.debi.sfc")).alias("built_area"), _get(i, "$.debi.ant").alias("built_year"),
        C.decimal_comma(_get(i, "$.debi.cpt")).alias("share"), _get(b, "$.finca.ltp").alias("parcel_kind"),
        _get(b, "$.finca.ldt").alias("parcel_address"), C.decimal_comma(ground).alias("ground_area"),
        _get(b, "$.finca.infgraf.igraf").alias("map_url"))


def property_units(df: DataFrame) -> DataFrame:
    """One row per building unit of a property answer."""
    d = _property(df)
    units = F.coalesce(_many(F.col("_b"), "$.lcons.cons"), _get(F.col("_b"), "$.lcons", "array<variant>"))
    u = d.select("ref", F.posexplode(units).alias("pos", "u"))
    inner = "$.dt.lourb.loint"
    return u.select("ref", "pos", _get(F.col("u"), "$.lcd").alias("use"), _get(F.col("u"), "$.dvcons.dtip").alias("kind"),
                    C.decimal_comma(_get(F.col("u"), "$.dfcons.stl")).alias("area"), _get(F.col("u"), inner + ".es").alias("stair"),
                    _get(F.col("u"), inner + ".pt").alias("floor"), _get(F.col("u"), inner + ".pu").alias("door"))


def coordinate_parcels(df: DataFrame) -> DataFrame:
    """Parcel reference and address of a coordinate answer; errors give no row."""
    d = df.withColumn("_v", _get(F.try_parse_json("raw"), "$.Consulta_RCCOORResult", "variant"))
    d = d.filter(F.col("_v").isNotNull() & ~_failed(F.col("_v"))).withColumn("_c", _one(F.col("_v"), "$.coordenadas.coord"))
    pc1, pc2 = _get(F.col("_c"), "$.pc.pc1"), _get(F.col("_c"), "$.pc.pc2")
    rest = [c for c in df.columns if c != "raw"]
    return d.filter((F.coalesce(pc1, F.lit("")) != "") & (F.coalesce(pc2, F.lit("")) != "")).select(
        *rest, F.concat(pc1, pc2).alias("parcel_ref"), F.coalesce(_get(F.col("_c"), "$.ldt"), F.lit("")).alias("address"))


def nearby_parcels(df: DataFrame) -> DataFrame:
    """Nearest parcel of a distance answer, with the distance."""
    d = df.withColumn("_v", _get(F.try_parse_json("raw"), "$.Consulta_RCCOOR_DistanciaResult", "variant"))
    d = d.filter(F.col("_v").isNotNull() & ~_failed(F.col("_v")))
    d = d.withColumn("_d", _one(F.col("_v"), "$.coordenadas_distancias.coordd")).withColumn("_p", _one(F.col("_d"), "$.lpcd"))
    pc1, pc2 = _get(F.col("_p"), "$.pc.pc1"), _get(F.col("_p"), "$.pc.pc2")
    rest = [c for c in df.columns if c != "raw"]
    return d.filter((F.coalesce(pc1, F.lit("")) != "") & (F.coalesce(pc2, F.lit("")) != "")).select(
        *rest, F.concat(pc1, pc2).alias("parcel_ref"), _get(F.col("_p"), "$.ldt").alias("address"),
        _get(F.col("_p"), "$.dis").try_cast("double").alias("metres"))


def address_references(df: DataFrame) -> DataFrame:
    """Property references of an address answer, list or single."""
    v = F.try_parse_json("raw")
    keys = ("$.consulta_dnplocResult", "$.consulta_dnpResult", "$.consulta_dnp")
    d = df.withColumn("_v", F.coalesce(*[_get(v, k, "variant") for k in keys])).filter(F.col("_v").isNotNull())
    listed = F.transform(_many(F.col("_v"), "$.lrcdnp.rcdnp"), lambda x: _get(x, "$.rc", "variant"))
    single = F.array(_get(_one(F.col("_v"), "$.bico"), "$.bi.idbi.rc", "variant"))
    rest = [c for c in df.columns if c != "raw"]
    r = d.select(*rest, F.posexplode(F.coalesce(listed, single)).alias("pos", "rc"))
    parts = [F.coalesce(_get(F.col("rc"), "$." + p), F.lit("")) for p in ("pc1", "pc2", "car", "cc1", "cc2")]
    return r.select(*rest, "pos", F.concat(*parts).alias("ref")).filter("ref <> ''")


def street_rows(df: DataFrame) -> DataFrame:
    """Type, name and code of each street of a (namespaced) search answer; an error answer gives none."""
    def inner(c: Column, tag: str) -> Column:
        return F.regexp_extract(c, rf"(?s)<(?:\w+:)?{tag}(?:\s[^>]*)?>([^<]*)</", 1)

    rest = [c for c in df.columns if c != "raw"]
    ok = df.filter(~F.col("raw").rlike(r"<(?:\w+:)?err[\s>]"))
    s = ok.select(*rest, F.posexplode(C.matches(F.col("raw"), r"(?s)<(?:\w+:)?calle(?:\s[^>]*)?>.*?</(?:\w+:)?calle>")).alias("pos", "x"))
    s = s.withColumn("d", F.regexp_extract("x", r"(?s)<(?:\w+:)?dir(?:\s[^>]*)?>(.*?)</(?:\w+:)?dir>", 1)).filter("d <> ''")
    return s.select(*rest, "pos", inner(F.col("d"), "tv").alias("street_type"), inner(F.col("d"), "nv").alias("street_name"),
                    inner(F.col("d"), "cv").alias("street_code"))
