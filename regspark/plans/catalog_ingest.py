"""Whole ingest flows over the derived rule books."""

from __future__ import annotations

from pyspark.sql import functions as F

from regspark.plans import derive as D
from regspark.plans import ingest
from regspark.plans.catalog import register
from regspark.plans.catalog_segment import ARTICLES, ITEMS


@register("ingest_corpus_chunks")
def _(spark, sf):
    """Rule books and building-code documents through one job, as a summary per source."""
    code = D._joined(D.shared(spark, sf, "code_parts"), "source", "ord", "part", "md")
    return ingest.source_summary(ingest.chunk_corpus(D.markdown_docs(spark, sf).unionByName(code), D.shared(spark, sf, "image_map"), 2))


LATE = ARTICLES.replace("string_agg(text, '' ORDER BY page) AS text FROM page_texts", "string_agg(text, chr(10) ORDER BY page) AS text FROM page_texts WHERE page >= 7") \
    + ", real AS (SELECT * FROM arts WHERE chars >= 100 QUALIFY row_number() OVER (PARTITION BY doc, number ORDER BY pos) = 1)"


@register("ingest_page_articles", f"""{LATE}, {ITEMS} SELECT doc, number, md5(body) AS body_md5, CASE WHEN len(ps) >= 2 THEN 'numbered' ELSE 'simple' END AS kind,
CASE WHEN len(ps) >= 2 THEN len(its) ELSE 0 END AS n_paragraphs FROM items""")
def _(spark, sf):
    a = ingest.pdf_articles(D.shared(spark, sf, "page_texts"))
    return a.select("doc", "number", F.md5("body").alias("body_md5"), "structure.kind", F.size("structure.paragraphs").alias("n_paragraphs"))


