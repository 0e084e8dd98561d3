"""Building units, parcels, addresses and their resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.functions import features as FE
from regspark.functions import text as C
from regspark.operators.ordered import last_by, neighbour


def is_common(use: Column | str) -> Column:
    u = F.upper(F.coalesce(C._col(use), F.lit("")))
    return u.contains("COMUN") | u.contains("COMÚN")


def pair_common_areas(units: DataFrame) -> DataFrame:
    """Every unit with the area of the next row when that row is a common element; common rows go.

    ``units``: building, pos, ref, use, area, stair, floor, door.
    """
    n = neighbour(units, ["building"], "pos", {"use": "_next_use", "area": "_next_area"})
    n = n.withColumn("common_area", F.when(is_common("_next_use"), F.coalesce("_next_area", F.lit(0.0))).otherwise(F.lit(0.0)))
    return n.filter(~is_common("use")).drop("_next_use", "_next_area")


def consolidate_units(paired: DataFrame) -> DataFrame:
    """One row per reference: summed areas, first non-empty stair, floor and door, use of the first row."""
    first = {c: F.coalesce(F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("pos"))), F.lit("")).alias(c)
             for c in ("stair", "floor", "door")}
    return paired.groupBy("building", F.coalesce("ref", F.lit("SIN_REF")).alias("ref")).agg(
        F.min_by("use", "pos").alias("use"), F.sum(F.coalesce("area", F.lit(0.0))).alias("area"),
        F.sum("common_area").alias("common_area"), *first.values())


def unit_table(units: DataFrame) -> DataFrame:
    """Total per unit plus one grand-total row per building (ref NULL), by grouping sets in one pass.

    ``units`` has one row a reference (``consolidate_units``).
    """
    by_unit = ["building", "ref", "stair", "floor", "door", "use"]
    rows = units.withColumn("total", F.col("area") + F.col("common_area"))
    sums = [F.sum(c).alias(c) for c in ("area", "common_area", "total")]
    return rows.groupingSets([by_unit, ["building"]], *by_unit).agg(*sums).select(*by_unit, "area", "common_area", "total")


def by_stair_floor(units: DataFrame) -> DataFrame:
    """Display order, NULLs first."""
    return units.orderBy(F.asc_nulls_first("stair"), F.asc_nulls_first("floor"))


def use_summary(units: DataFrame, key: str = "building") -> DataFrame:
    """A10: count and area per use."""
    return units.groupBy(key, F.coalesce("use", F.lit("OTRO")).alias("use")).agg(
        F.count("*").alias("units"), F.sum(F.coalesce("area", F.lit(0.0))).alias("area"))


def use_map(units: DataFrame, key: str = "building") -> DataFrame:
    """A10: unit count, total area and a map use -> (units, area); built from the per-use partial sums."""
    s = use_summary(units, key)
    return s.groupBy(key).agg(
        F.sum("units").alias("units"), F.sum("area").alias("area"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("use", F.struct("units", "area").alias("v"))))).alias("by_use"))


def filter_units(requests: DataFrame, units: DataFrame) -> DataFrame:
    """Units of each request that match the given stair, floor and door; all units when none matches.

    ``requests``: req_id, building, stair, floor, door ('' or NULL: any).
    """
    r = requests.select("req_id", "building", *[F.col(c).alias("_" + c) for c in ("stair", "floor", "door")])
    hit = F.lit(True)
    for c in ("stair", "floor", "door"):
        hit &= (F.coalesce("_" + c, F.lit("")) == "") | (C.unit_code(c) == C.unit_code("_" + c))
    j = units.join(r, ["building"]).withColumn("matched", hit).drop("_stair", "_floor", "_door")
    found = j.groupBy("req_id").agg(F.bool_or("matched").alias("_any"))
    return j.join(found, "req_id").filter("matched or not coalesce(_any, false)").select(*j.columns)


def all_known_units(own: DataFrame, additional: DataFrame) -> DataFrame:
    """Own and additional units, the last one per reference."""
    both = own.withColumn("_o", F.lit(0)).unionByName(additional.withColumn("_o", F.lit(1)))
    return last_by(both, ["ref"], ["_o", "pos"]).drop("_o")


def address_units(addresses: DataFrame, property_refs: DataFrame, units: DataFrame) -> DataFrame:
    """Units of every property reference at an address, tagged with the reference.

    ``addresses``: address_id. ``property_refs``: address_id, ref. ``units``: ref, pos, use, area.
    """
    refs = property_refs.join(addresses.select("address_id"), ["address_id"])
    return units.join(refs, ["ref"])


def combined_record(addresses: DataFrame, property_refs: DataFrame, units: DataFrame) -> DataFrame:
    """One record per address: units, built area, references and the use summary as text.

    Sums are taken per (address, use) and per (address, ref) before the final step, so no group holds unit rows.
    """
    u = address_units(addresses, property_refs, units)
    uses = u.groupBy("address_id", F.coalesce("use", F.lit("OTRO")).alias("use")).agg(F.count("*").alias("n"), F.sum("area").alias("a"))
    summary = uses.groupBy("address_id").agg(
        F.sum("n").alias("units"), F.sum("a").alias("area"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("use", "n"))), lambda s: F.concat(
            s["use"], F.lit("="), s["n"].cast("string"))), ";").alias("uses"))
    refs = u.groupBy("address_id").agg(F.count_distinct("ref").alias("refs"), F.min("ref").alias("first_ref"))
    return summary.join(refs, "address_id")


def resolve(inputs: DataFrame, by_ref: DataFrame, by_point: DataFrame, by_address: DataFrame) -> DataFrame:
    """Parcel of each input by reference, else coordinates, else address, with the method used.

    Candidate tables: input_id, parcel_ref. The best candidate is a partial aggregate, not a window. It is joined by merge: there are
    about as many as inputs, too many for the driver.
    """
    cands = None
    for priority, (method, df) in enumerate((("ref", by_ref), ("coordinates", by_point), ("address", by_address))):
        part = df.select("input_id", F.struct(F.lit(priority).alias("p"), F.col("parcel_ref"), F.lit(method).alias("method")).alias("c"))
        cands = part if cands is None else cands.unionByName(part)
    best = cands.groupBy("input_id").agg(F.min("c").alias("c"))
    return inputs.join(best.hint("merge"), "input_id", "left").select(*inputs.columns, "c.parcel_ref", F.coalesce("c.method", F.lit("none")).alias("method"))


def street_candidates(addresses: DataFrame, streets: DataFrame) -> DataFrame:
    """F7 + J15: registered street per address: the first of the type codes to try that exists.

    ``addresses``: address_id, address. ``streets``: via, street_type, street_name.
    """
    typed = addresses.select("address_id", FE.street_type("address").alias("s"))
    tries = typed.select("address_id", F.col("s.name").alias("name"), F.posexplode("s.types").alias("priority", "street_type")) \
        .filter(F.col("name").isNotNull()) \
        .withColumn("street_name", C.cadastre_upper(C.drop_street_article("name"))).drop("name")
    j = tries.join(streets, ["street_type", "street_name"])
    return j.groupBy("address_id").agg(F.min_by(F.struct("via", "street_type", "street_name"), F.struct("priority", "via")).alias("v")) \
        .select("address_id", "v.*")


def cadastral_layers(parcels: DataFrame, buildings: DataFrame, blocks: DataFrame, streets: DataFrame) -> DataFrame:
    """Every building with its parcel, the block of the parcel and the street in front of it.

    ``parcels``: refcat, masa, via. ``buildings``: refcat, .... ``blocks``: masa, .... ``streets``: via, ....
    """
    placed = buildings.join(parcels, ["refcat"])
    return placed.join(blocks, ["masa"], "left").join(streets, ["via"], "left")


def zone_precedence(resolved: DataFrame) -> DataFrame:
    """Ordinance by reference, else by coordinates, with the origin. Columns ord_by_ref, name_by_ref,
    ord_by_point, name_by_point."""
    ref_ok = F.coalesce("ord_by_ref", F.lit("")) != ""
    return resolved.withColumns({
        "ordinance": F.when(ref_ok, F.col("ord_by_ref")).otherwise(F.coalesce("ord_by_point", F.lit("N/A"))),
        "zone_name": F.coalesce(F.when(ref_ok, F.col("name_by_ref")).otherwise(F.col("name_by_point")), F.lit("")),
        "zone_origin": F.when(ref_ok, "ref").when(F.col("ord_by_point").isNotNull(), "coordinates").otherwise("none")})


def parcel_metrics(parcels: DataFrame, units: DataFrame, footprints: DataFrame, fronts: DataFrame) -> DataFrame:
    """Built ratio, coverage, estimated floors and whether a parcel fronts two streets.

    Only the names of these metrics are public; the definitions here are inferred.
    ``parcels``: parcel_ref, area. ``units``: parcel_ref, area, floor_no. ``footprints``: parcel_ref, area.
    ``fronts``: parcel_ref, via.
    """
    built = units.groupBy("parcel_ref").agg(F.sum("area").alias("built"), F.max("floor_no").alias("floors"))
    ground = footprints.groupBy("parcel_ref").agg(F.sum("area").alias("ground"))
    streets = fronts.groupBy("parcel_ref").agg(F.count_distinct("via").alias("streets"))
    j = parcels.join(built, "parcel_ref", "left").join(ground, "parcel_ref", "left").join(streets, "parcel_ref", "left")
    ratio = lambda c: F.round(F.coalesce(c, F.lit(0.0)) / F.nullif(F.col("area"), F.lit(0.0)), 4)
    return j.select("parcel_ref", ratio(F.col("built")).alias("built_ratio"), ratio(F.col("ground")).alias("coverage"),
                    F.coalesce("floors", F.lit(0)).alias("floors"),
                    (F.coalesce("streets", F.lit(0)) >= 2).alias("through_parcel"))
