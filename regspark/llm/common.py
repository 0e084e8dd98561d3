"""Small helpers that several operators of the subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.session import cut_lineage, ensure_checkpoint_dir

#: The separators between words of every contract: space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["WORD", "cut_lineage", "documents", "new_folder", "numbered", "prefix_bases", "row_key"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the cluster's shared checkpoint folder, as a URI."""
    base = ensure_checkpoint_dir(spark)
    base = f"file://{base}" if base.startswith("/") else base.replace("file:/", "file:///", 1) if base.startswith("file:/") and not base.startswith("file://") else base
    return f"{base}/{name}-{uuid.uuid4().hex}"


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with its columns named c0, c1, ..., and the new name of each; so no column can clash with an operator's own."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def row_key(cols: Sequence[str]) -> list[Column]:
    """``_k1, _k2``: 128 hash bits that name a row by the given columns; nulls count as values.

    ``xxhash64`` skips nulls, so a mask of the nulls is hashed with the values.
    """
    nulls = F.concat(*[F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cols])
    return [F.xxhash64(F.lit(seed), nulls, *[F.col(c) for c in cols]).alias(name) for name, seed in (("_k1", 17), ("_k2", 7129))]


def prefix_bases(counts: DataFrame, by: str, value: str, base: str, width: int = 4096) -> DataFrame:
    """Adds ``base``: the sum of ``value`` over all smaller ``by`` (integers from 0), in blocks so that no window holds all rows."""
    from pyspark.sql import Window

    d = counts.withColumn("_blk", F.floor(F.col(by) / width))
    within = Window.partitionBy("_blk").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = d.groupBy("_blk").agg(F.sum(value).alias("_s")).select("_blk", F.coalesce(F.sum("_s").over(across), F.lit(0)).alias("_b"))
    return (d.withColumn(base, F.coalesce(F.sum(value).over(within), F.lit(0)))
            .join(blocks, "_blk").withColumn(base, (F.col(base) + F.col("_b")).cast("long")).drop("_blk", "_b"))
