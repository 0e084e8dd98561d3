"""Shards in random order by a two-pass external shuffle.

Pass one scatters rows into buckets that fit in memory, by a seeded hash of the whole row; Spark's shuffle is the
external part. Pass two orders each bucket by the row's hash, which makes it independent of arrival, and permutes it by a
Fisher-Yates shuffle seeded by the bucket. Prefix sums of the bucket sizes give every row its place in the whole, and
consecutive places are cut into shards whose row counts are at most one apart (law ``rows``).

Null ids or texts are values like any other; a null text has size 16. Rows that are equal in every column are
interchangeable: few go to one bucket, more than ``hot_rows`` are counted before the shuffle and dealt out copy by copy.
Columns named shard or slot are replaced, others pass through. An empty table gives an empty result. The same rows,
seed and bucket size give the same result on any cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark.llm.common import numbered, prefix_bases, row_key

#: A broadcast of two numbers a bucket stays below 32 MB up to here; more buckets are joined by a shuffle.
BROADCAST_BUCKETS = 1 << 20


def row_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def _scattered(docs: DataFrame, seed: int, buckets: int, hot_rows: int) -> DataFrame:
    """Adds ``_k1, _k2, _bucket``."""
    keyed = docs.select("*", *row_key(docs.columns))
    place = lambda *more: F.pmod(F.xxhash64(F.lit(seed), F.col("_k1"), F.col("_k2"), *more), F.lit(buckets)).cast("int").alias("_bucket")
    hot = keyed.groupBy("_k1", "_k2").agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows)
    if hot.isEmpty():
        return keyed.select("*", place())
    cold = keyed.join(hot, ["_k1", "_k2"], "left_anti").select("*", place())
    one = keyed.join(hot.drop("_n"), ["_k1", "_k2"], "left_semi").groupBy(*keyed.columns).agg(F.count("*").alias("_n"))
    lots = one.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / hot_rows))).alias("_lot")).repartition("_k1", "_lot")
    copies = lots.select("*", F.explode(F.sequence(F.col("_lot") * hot_rows, F.least(F.col("_n"), (F.col("_lot") + 1) * hot_rows) - 1)).alias("_copy"))
    return cold.unionByName(copies.select(*keyed.columns, place(F.col("_copy"))))


def deal(docs: DataFrame, shards: int, seed: int = 0, bucket_bytes: int = 32 << 20, least_buckets: int = 64,
         hot_rows: int = 20_000, text: str = "text") -> DataFrame:
    """All rows and columns, with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard)."""
    own, of = numbered(docs.drop("shard", "slot"))
    n, size = own.agg(F.count("*"), F.coalesce(F.sum(row_size(of[text])), F.lit(0))).first()
    buckets = max(least_buckets, -(-size // bucket_bytes))
    rows = _scattered(own, seed, buckets, hot_rows)
    bases = prefix_bases(rows.groupBy("_bucket").agg(F.count("*").alias("_n")), "_bucket", "_n", "_base").drop("_n")
    placed = rows.join(F.broadcast(bases) if buckets <= BROADCAST_BUCKETS else bases, "_bucket")
    each, longer = divmod(n, shards)
    names = own.columns

    def shuffled(bucket: pa.Table) -> pa.Table:
        if not bucket.num_rows:
            return pa.Table.from_arrays([*[bucket[c] for c in names], pa.array([], pa.int32()), pa.array([], pa.int64())], [*names, "shard", "slot"])
        bucket = bucket.sort_by([("_k1", "ascending"), ("_k2", "ascending")])
        order = np.arange(bucket.num_rows)
        np.random.default_rng([seed, bucket["_bucket"][0].as_py()]).shuffle(order)  # numpy's shuffle is Fisher-Yates
        at = bucket["_base"][0].as_py() + np.arange(bucket.num_rows)
        late = np.maximum(at - longer * (each + 1), 0)
        early = at < longer * (each + 1)
        shard = np.where(early, at // (each + 1), longer + late // max(each, 1))
        slot = np.where(early, at % (each + 1), late % max(each, 1))
        out = bucket.select(names).take(order)
        return out.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(slot.astype(np.int64)))

    schema = T.StructType([*own.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return placed.groupBy("_bucket").applyInArrow(shuffled, schema).toDF(*of, "shard", "slot")


def write_shards(dealt: DataFrame, folder: str) -> None:
    """One folder a shard; within each file rows are in slot order."""
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
