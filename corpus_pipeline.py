"""From raw documents to token ids: five stages, each one an operator of ``regspark.llm`` over all that its predecessor kept.

Every stage is written as Parquet and read again, so a lost executor costs a stage at most. Null texts, empty texts and
repeated rows are treated as the operators' docstrings say; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.llm.common import WORD, documents, new_folder
from regspark.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or the classifier rejects go."""
    from regspark.llm.quality import judged

    return judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("kept").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go from the texts; a document of which no word is left goes."""
    from regspark.llm.line_dedup import deduplicated

    left = deduplicated(docs.select(COLUMNS), min_words=50).filter((F.col("n_deleted") == 0) | F.col("text").rlike(WORD))
    return left.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose sets of five-word shingles have similarity 0.8 or more."""
    from regspark.llm.shingles import without_near_copies

    return without_near_copies(docs.select(COLUMNS), width=5, least=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half a benchmark item or more go."""
    from regspark.llm.decontaminate import decontaminated

    return decontaminated(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' SentencePiece ids, and whether they decode to the text again."""
    from regspark.llm.piece_codec import encode

    return encode(docs.select(COLUMNS), vocabulary("piece_bpe_32k.model"), round_trip_col="round_trip")


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup),
          ("benchmark decontamination", decontamination), ("SentencePiece encoding and decoding", pieces)]

#: The classifier, the fingerprints and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = documents(spark, sf_dir), new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
