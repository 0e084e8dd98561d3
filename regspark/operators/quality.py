"""Reports and data-quality checks (all partial aggregations)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def extraction_report(articles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A1: articles, characters, mean, longest and shortest article (ties: smaller number), of all or for each value of ``by``, such as the document."""
    longest = F.min_by("number", F.struct(-F.col("chars"), F.col("number")))
    shortest = F.min_by("number", F.struct(F.col("chars"), F.col("number")))
    return articles.groupBy(*by or []).agg(F.count("*").alias("articles"), F.sum("chars").alias("chars"),
                        F.round(F.avg("chars"), 2).alias("mean_chars"), longest.alias("longest"), shortest.alias("shortest"))


def duplicate_numbers(articles: DataFrame) -> DataFrame:
    """A2: every row of a number that occurs more than once in its document (long form, so no group is collected)."""
    n = articles.groupBy("doc", "number").agg(F.count("*").alias("copies")).filter("copies > 1")
    return articles.select("doc", "number", "pos", "heading").join(n, ["doc", "number"])


def number_profile(articles: DataFrame) -> DataFrame:
    """A2: smallest and largest numeric article number and the count of other numbers, per document."""
    n = F.col("number").try_cast("int")
    return articles.groupBy("doc").agg(F.min(n).alias("min_number"), F.max(n).alias("max_number"),
                                       F.count_if(n.isNull()).alias("not_numeric"))


def missing_numbers(present: DataFrame, last: int, first: int = 1) -> DataFrame:
    """Numbers of a range that do not occur."""
    wanted = present.sparkSession.range(first, last + 1).select(F.col("id").alias("number"))
    return wanted.join(present.select(F.col("number").try_cast("long").alias("number")).distinct(), "number", "left_anti")


def missing_per_document(present: DataFrame, last: int, first: int = 1) -> DataFrame:
    """(doc, number) of the numbers of a range that a document lacks; at most ``last - first + 1`` numbers are held for each."""
    n = F.col("number").try_cast("long")
    held = present.groupBy("doc").agg(F.collect_set(F.when(n.between(first, last), n)).alias("held"))
    return held.select("doc", F.explode(F.array_except(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long")), "held")).alias("number"))


def paragraph_report(articles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A4: numbered and simple articles, their shares, total and mean paragraphs, of all or for each value of ``by``. ``articles``: kind,
    n_paragraphs."""
    n, numbered = F.count("*"), F.count_if(F.col("kind") == "numbered")
    return articles.groupBy(*by or []).agg(n.alias("articles"), numbered.alias("numbered"), (n - numbered).alias("simple"),
                        F.round(numbered * 100.0 / n, 1).alias("numbered_share"),
                        F.sum("n_paragraphs").cast("long").alias("paragraphs"),
                        F.round(F.sum("n_paragraphs") / F.nullif(numbered, F.lit(0)), 2).alias("mean_paragraphs"))


def chunk_report(chunks: DataFrame) -> DataFrame:
    """A5: chunks, with ordinance, with tables, with images."""
    return chunks.agg(F.count("*").alias("chunks"), F.count_if(F.col("ordinance_code") != "").alias("with_ordinance"),
                      F.count_if(F.col("has_tables")).alias("with_tables"), F.count_if(F.size("raw_images") > 0).alias("with_images"))


def chunks_per_source(chunks: DataFrame) -> DataFrame:
    """Chunks per source and a TOTAL row."""
    return chunks.rollup("source").agg(F.count("*").alias("chunks")).select(F.coalesce("source", F.lit("TOTAL")).alias("source"), "chunks")


def question_coverage(chunks: DataFrame) -> DataFrame:
    """Chunks with and without questions."""
    has = F.size(F.coalesce("questions", F.array().cast("array<string>"))) > 0
    return chunks.agg(F.count_if(has).alias("with_questions"), F.count_if(~has).alias("without_questions"))


def null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """NULLs per column and the row count."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias("no_" + c) for c in cols], F.count("*").alias("rows"))


def value_frequency(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value, ties to the smaller one."""
    return df.groupBy(column).agg(F.count("*").alias("n")).agg(
        F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias(column), F.max("n").alias("n"))


def long_articles(articles: DataFrame, limit: int = 4000, size: Column | None = None) -> DataFrame:
    """Articles above a length, longest first."""
    size = F.col("chars") if size is None else size
    return articles.filter(size > limit).orderBy(F.desc(size))


def image_totals(images: DataFrame, approximate: bool = False) -> DataFrame:
    """Images and different images per source. ``images``: source, hash."""
    distinct = F.approx_count_distinct("hash") if approximate else F.count_distinct("hash")
    return images.groupBy("source").agg(F.count("*").alias("images"), distinct.alias("unique_images"))


def layer_profile(layer: DataFrame, geometry_type: str) -> DataFrame:
    """Rows and geometry types of a layer."""
    return layer.agg(F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_set(geometry_type)), ",").alias("geometry_types"))
