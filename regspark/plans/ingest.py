"""Corpus to chunk table: cleaning, routing by kind of source, segmentation and features in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regspark.functions import fixed as X
from regspark.functions import text as C
from regspark.operators import segment as S

CODE_PREFIX = "cte"


def clean_markdown(docs: DataFrame, compat: bool = False) -> DataFrame:
    """C5 on the text of every source (source, md); spaces are tidied per article."""
    return docs.withColumn("md", C.split_glued_heading("md", compat))


def corpus_articles(docs: DataFrame, compat: bool = False) -> DataFrame:
    """Building-code sources give coded sections, all others articles and annexes.

    Each route counts its own pieces, so ``pos`` is spread to keep ``source, pos`` unique over the routes.
    """
    is_code = F.col("source").startswith(CODE_PREFIX)
    rules = docs.filter(~is_code)
    routes = [S.markdown_articles(rules, compat), S.markdown_annexes(rules), S.coded_sections(docs.filter(is_code))]
    own = [r.withColumn("pos", F.col("pos") * len(routes) + k) for k, r in enumerate(routes)]
    return own[0].unionByName(own[1]).unionByName(own[2])


def chunk_corpus(docs: DataFrame, image_map: DataFrame | None = None, max_frequency: int = 3, compat: bool = False) -> DataFrame:
    """S1 output (source, md) to the canonical chunk table."""
    return S.chunks(corpus_articles(clean_markdown(docs, compat), compat), image_map, max_frequency, compat=compat)


def pdf_articles(pages: DataFrame, first_page: int = 7) -> DataFrame:
    """Page texts (doc, page, text) to real articles with their numbered paragraphs; no document is built whole."""
    a = S.real_articles(S.plain_articles_of_pages(pages, first_page))
    return a.withColumn("structure", S.numbered_paragraphs("body"))


def source_summary(chunks: DataFrame) -> DataFrame:
    """Chunks, articles and concept flags per source."""
    flags = [F.count_if(F.col(n)).alias(n) for n, _, _ in X.CONCEPTS]
    return chunks.groupBy("source").agg(F.count("*").alias("chunks"), F.count_distinct("article_no").alias("articles"), *flags)
