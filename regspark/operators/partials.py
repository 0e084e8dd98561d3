"""Reports from partial states: each ingest batch stores counts by key and sketches, a report merges what is stored.

A batch overwrites its own folder, so one that runs again counts once. Exact states are counts by value and distinct pairs; beside them
stands a HyperLogLog sketch a key, which merges without the values. Merging reads states only, never the rows they came from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _write(state: DataFrame, folder: str, batch: str) -> None:
    state.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def add_counts(rows: DataFrame, by: list[str], folder: str, batch: str, **sums: Column) -> None:
    """Counts of a batch by value, and further sums."""
    _write(rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(c.cast("long")).alias(k) for k, c in sums.items()]), folder, batch)


def merged_counts(spark: SparkSession, folder: str, by: list[str]) -> DataFrame:
    """The columns of ``by`` with ``n`` and the sums, over all batches."""
    d = spark.read.parquet(folder).drop("batch")
    return d.groupBy(*by).agg(*[F.sum(c).alias(c) for c in d.columns if c not in by])


def add_distinct(rows: DataFrame, key: str, value: str, folder: str, batch: str, lg_k: int = 12) -> None:
    """Rows and different values of each key in a batch (A16): the values themselves, and a sketch."""
    pairs = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    _write(pairs, f"{folder}/values", batch)
    held = rows.sparkSession.read.parquet(f"{folder}/values/batch={batch}")
    _write(held.groupBy(key).agg(F.sum("n").alias("n"), F.hll_sketch_agg(value, F.lit(lg_k)).alias("sketch")), f"{folder}/sketches", batch)


def merged_distinct(spark: SparkSession, folder: str, key: str, value: str, approximate: bool = False) -> DataFrame:
    """``key, n, different`` over all batches; ``approximate`` reads the sketches only (relative error about 1.04 / sqrt(2 ** lg_k))."""
    if approximate:
        d = spark.read.parquet(f"{folder}/sketches")
        return d.groupBy(key).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("different"))
    once = spark.read.parquet(f"{folder}/values").groupBy(key, value).agg(F.sum("n").alias("n"))
    return once.groupBy(key).agg(F.sum("n").alias("n"), F.count(value).alias("different"))
