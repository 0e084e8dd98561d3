"""Question to answer request: the whole retrieval flow for many questions in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regspark.functions import features as FE
from regspark.functions import fixed as X
from regspark.operators import chat
from regspark.operators import retrieve as V
from regspark.plans import derive as D
from regspark.providers import EmbeddingProvider, add_embeddings
from regspark.session import cut_lineage


def hits_with_payload(ranked: DataFrame, chunks: DataFrame, columns: list[str]) -> DataFrame:
    """Payload columns for the final hits only; the vectors are never joined.

    The hits are few and dear, so they are written once before the join counts its keys; a chunk that most
    queries find is salted.
    """
    return cut_lineage(ranked).join(chunks.select("chunk_id", *columns), ["chunk_id"])


def answer_requests(questions: DataFrame, chunks: DataFrame, provider: EmbeddingProvider, dictionary: FE.Dictionary,
                    system: str, k: int = X.TOP_K_SERVICE) -> DataFrame:
    """Expansion, zone enrichment, embedding, filtered search with fallback, context and request.

    ``questions``: query_id, text, code, language, history. ``chunks``: the chunk table with three vectors.
    """
    q = questions.withColumn("plain_q", FE.expand_query("text", dictionary)).withColumn("zoned_q", FE.enrich_with_zone("plain_q", "code"))
    q = cut_lineage(add_embeddings(q, {"vector": "zoned_q", "plain_vector": "plain_q"}, provider))  # each question is embedded once
    final = V.with_fallback(q.withColumnRenamed("code", "ordinance_code"), chunks, k, fallback_vector="plain_vector")
    payload = [c for c in ("source", "article_no", "ordinance", "header", "text", "chapter") if c in chunks.columns]
    hits = hits_with_payload(final, chunks, payload)
    for c in ("ordinance", "norm_title", "chapter", "section", "tables"):
        if c not in hits.columns:
            hits = hits.withColumn(c, F.lit(""))
    contexts = V.assemble_context(hits, "service")
    return chat.answer_requests(q.select("query_id", F.col("text").alias("question"), "language", "history"), contexts, system)


def flagship(spark, sf: str, k: int = X.TOP_K_FINAL) -> DataFrame:
    """Three-view search, rank fusion, top five and context of every benchmark query."""
    chunks = D.vector_chunks(spark, sf)
    final = V.retrieve(D.benchmark_queries(spark, sf), chunks, k)
    hits = hits_with_payload(final, chunks, ["source", "article_no", "header", "text", F.col("ordinance_code").alias("ordinance")])
    return V.assemble_context(hits, "retriever")
