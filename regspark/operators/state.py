"""Chunk state, incremental selection, upserts and copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regspark.operators.ordered import last_by
from regspark.session import cut_lineage


def latest_state(log: DataFrame, key: str = "chunk_id", ts: str = "ts", tie: str | None = None) -> DataFrame:
    """M5: the newest state row per chunk of an append-only log."""
    return last_by(log, [key], [ts] + ([tie] if tie else []))


def apply_enrichment(chunks: DataFrame, state: DataFrame, cols: list[str]) -> DataFrame:
    """Take over stored enrichment columns where a chunk has a state row."""
    s = state.select("chunk_id", F.lit(True).alias("_has"), *[F.col(c).alias("_s_" + c) for c in cols])
    out = chunks.join(s, "chunk_id", "left")
    return out.select(*[F.when(F.col("_has"), F.col("_s_" + c)).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
                        for c in chunks.columns])


def to_enrich(chunks: DataFrame, state: DataFrame) -> DataFrame:
    """Chunks without a state row."""
    return chunks.join(state.select("chunk_id"), "chunk_id", "left_anti")


def to_index(chunks: DataFrame, state: DataFrame) -> DataFrame:
    """Enriched chunks that are not indexed yet."""
    return chunks.join(state.filter(~F.col("indexed")).select("chunk_id"), "chunk_id", "left_semi")


def progress(chunks: DataFrame, state: DataFrame) -> DataFrame:
    """Per source the chunks, enriched, indexed, to index and to enrich."""
    j = chunks.select("source", "chunk_id").join(state.select("chunk_id", "indexed"), "chunk_id", "left")
    return j.groupBy("source").agg(
        F.count("*").alias("chunks"), F.count("indexed").alias("enriched"),
        F.count_if(F.col("indexed")).alias("indexed"), F.count_if(~F.col("indexed")).alias("to_index"),
        F.count_if(F.col("indexed").isNull()).alias("to_enrich"))


def completion(results: DataFrame) -> DataFrame:
    """M3: per source the finished rows and those that stay pending for the next run. ``results``: source, status."""
    pending = F.col("status").isin("quota", "retry")
    return results.groupBy("source").agg(F.count("*").alias("chunks"), F.count_if(~pending).alias("finished"),
                                         F.count_if(pending).alias("pending"))


def upsert(old: DataFrame, new: DataFrame, key: str, version: list[str]) -> DataFrame:
    """K4: the last version of every new key plus the old rows of all other keys."""
    fresh = last_by(new, [key], version)
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def point_ids(existing_max: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Ids that continue after the current count (the natural key is the better choice), by rank, however sparse the order column is.

    ``existing_max`` is one row: next_id. Rows are put into ranges of the order column and written once, so that a partition's rows stay
    its rows; the sizes of the partitions before (a row a partition) are a row's base.
    """
    ranged = new.repartitionByRange(order).sortWithinPartitions(order)
    placed = cut_lineage(ranged.withColumn("_at", F.monotonically_increasing_id()))  # partition in the upper bits, row in the lower 33
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    base = existing_max.agg(F.coalesce(F.max("next_id"), F.lit(0)).cast("long").alias("base")).scalar()
    return placed.withColumn("_part", part).join(sizes, "_part").select(*new.columns, (base + F.col("_before") + row).cast("long").alias("point_id"))


def cache_aside(requests: DataFrame, cache: DataFrame, key: str, compute) -> tuple[DataFrame, DataFrame]:
    """(answers, rows to add to the cache). ``compute`` maps the missing keys to cache rows."""
    keys = requests.select(key).distinct()
    added = compute(keys.join(cache.select(key), key, "left_anti")).select(*cache.columns)
    return requests.join(cache.unionByName(added), [key]), added


def stored_answers(requests: DataFrame, store, compute) -> DataFrame:
    """K10 with a store (``KeyedStore``): the cached rows of the requests' keys, and of those that were missing; what is computed is stored
    first, so a second run, or a run after a failure, finds it. ``compute`` maps the missing keys to rows."""
    keys = requests.select(store.key).filter(F.col(store.key).isNotNull()).distinct()
    missing = keys.join(store.read(keys).select(store.key), store.key, "left_anti")
    missing = cut_lineage(missing)
    if not missing.isEmpty():
        store.merge(compute(missing))
    return requests.join(store.read(keys), store.key)


def fingerprint(df: DataFrame, name: str) -> DataFrame:
    """K5: row count and order-free content hash of a collection (one row)."""
    cols = sorted(df.columns)
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*cols)), F.lit(0)).alias("hash")) \
        .select(F.lit(name).alias("collection"), "rows", "hash")


def totals(collections: dict[str, DataFrame]) -> DataFrame:
    """K6: rows per collection."""
    out = None
    for name, df in collections.items():
        part = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("collection"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def update_where(target: DataFrame, updates: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Replace ``cols`` of every target row whose key has an update (also by NULL)."""
    u = updates.select(key, F.lit(True).alias("_u"), *[F.col(c).alias("_u_" + c) for c in cols])
    j = target.join(u, [key], "left")
    return j.select(*[F.when(F.col("_u"), F.col("_u_" + c)).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
                      for c in target.columns])


def scroll(df: DataFrame, key: str, after, size: int, where: Column | None = None, cols: list[str] | None = None) -> DataFrame:
    """One page of a filtered collection, continuing after a key."""
    out = df if where is None else df.filter(where)
    if after is not None:
        out = out.filter(F.col(key) > F.lit(after))
    return out.select(*(cols or df.columns)).orderBy(key).limit(size)


def run_summary(results: DataFrame) -> DataFrame:
    """Results (code, reason; NULL reason is ok) per outcome."""
    return results.groupBy(F.coalesce("reason", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))
