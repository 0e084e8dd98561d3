"""Sinks: article files, collections, tables, annotations and wiki pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from regspark.functions import text as C
from regspark.operators.state import upsert

# filter columns of a collection: sorted or bloom-filtered on write
KEYWORD_COLUMNS = ["ordinance", "ordinance_code", "article_no", "source", "wiki_path", "scope"]


def write_articles(articles: DataFrame, path: str, source_label: str) -> None:
    """K1: article JSON lines and a one-row metadata file next to them."""
    articles.write.mode("overwrite").json(f"{path}/articles")
    meta = articles.agg(F.count("*").alias("total_articles")).withColumns(
        {"extracted_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), "source": F.lit(source_label)})
    meta.write.mode("overwrite").json(f"{path}/metadata")


def _collection_writer(chunks: DataFrame, mode: str) -> DataFrameWriter:
    """A few files a source (a source with very many rows is split), sorted by ordinance code, with bloom filters."""
    rows = chunks.hint("rebalance", F.col("source")).sortWithinPartitions("source", *[c for c in ("ordinance_code",) if c in chunks.columns])
    out = rows.write.mode(mode)
    for c in KEYWORD_COLUMNS:
        if c in chunks.columns and c != "source":
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    return out.partitionBy("source")


def write_collection(chunks: DataFrame, path: str, recreate: bool = False) -> None:
    """K2, K3: chunk collection partitioned by source, sorted by ordinance code inside each file, with bloom
    filters on the other keyword columns so that equality filters skip row groups. Flags are plain columns, which
    Parquet's statistics and dictionaries serve."""
    _collection_writer(chunks, "overwrite" if recreate else "append").parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def create_collection(spark: SparkSession, path: str, schema, recreate: bool = False) -> int:
    """K2: create an empty collection, or keep an existing one and return its row count."""
    if path_exists(spark, path) and not recreate:
        return spark.read.parquet(path).count()
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return 0


def upsert_collection(spark: SparkSession, path: str, staging: str, new: DataFrame, version: list[str], key: str = "chunk_id") -> None:
    """K4: rewrite only the source partitions that the new rows touch or leave, through a staging folder.

    A chunk whose source changes leaves the folder of its old source. Nothing is read and overwritten in one job, so a lost executor
    or a failed write leaves the old rows in place. Sources are replaced one after the other; a collection that is read while it is
    replaced is better held in a ``KeyedStore``, whose merges readers see whole or not at all.
    """
    old = spark.read.parquet(path)
    left = old.join(new.select(key).distinct(), [key], "left_semi").select("source")
    names = new.select("source").union(left).distinct()
    touched = old.join(names, ["source"], "left_semi").select(*old.columns)
    merged = upsert(touched.select(*new.columns), new, key, version)
    merged.write.mode("overwrite").partitionBy("source").parquet(staging)
    staged = spark.read.schema(merged.schema).parquet(staging)
    empty = [r.source for r in names.join(staged.select("source").distinct(), ["source"], "left_anti").collect()]  # a row a source
    _collection_writer(staged, "overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    for source in empty:
        folder = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("source", source)
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def copy_collection(spark: SparkSession, src: str, dst: str) -> dict:
    """K5: copy a collection and compare row count and content hash."""
    df = spark.read.parquet(src)
    df.write.mode("overwrite").parquet(dst)
    cols = sorted(df.columns)

    def mark(d: DataFrame):
        return d.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*cols)).alias("h")).first()

    a, b = mark(df), mark(spark.read.parquet(dst))
    if tuple(a) != tuple(b):
        raise ValueError(f"copy differs: {a} != {b}")
    return {"rows": a["n"], "hash": a["h"]}


def split_zones(zones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K7: (zones to store, rejected zones with the reason)."""
    reason = F.when(F.col("code").isNull(), "code").when(F.col("rings").isNull() | (F.size("rings") == 0), "geometry")
    marked = zones.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def write_zones(zones: DataFrame, path: str, rejects: str, replace: bool = False) -> None:
    """K7: append or replace zones; rows without code or geometry go to a reject table."""
    good, bad = split_zones(zones)
    mode = "overwrite" if replace else "append"
    good.write.mode(mode).parquet(path)
    bad.write.mode(mode).parquet(rejects)


def append_annotations(notes: DataFrame, path: str) -> None:
    """K9: annotations with user, article and text; incomplete ones are not stored."""
    valid_annotations(notes).write.mode("append").parquet(path)


def valid_annotations(notes: DataFrame) -> DataFrame:
    """K9: rows whose user, article_ref and text are all filled, with a timestamp."""
    ok = F.lit(True)
    for c in ("user", "article_ref", "text"):
        ok &= F.coalesce(F.col(c), F.lit("")) != ""
    stamped = notes if "created" in notes.columns else notes.withColumn("created", F.current_timestamp())
    return stamped.filter(ok)


def pending_pages(pages: DataFrame, done: DataFrame) -> DataFrame:
    """Pages whose (source, number) is not processed yet."""
    return pages.join(done.select("source", "number"), ["source", "number"], "left_anti")


def write_wiki(pages: DataFrame, path: str, done: DataFrame | None = None) -> None:
    """Append the pages (source, number, page) that are not processed yet."""
    todo = pages if done is None else pending_pages(pages, done)
    todo.withColumn("wiki_path", C.wiki_path("source", "number")).write.mode("append").partitionBy("source").parquet(path)
