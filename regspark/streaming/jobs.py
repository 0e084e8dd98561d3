"""Structured Streaming jobs of the ingest: enrich, embed, index, mark.

State, index and pending rows are keyed stores: one current row a chunk, and a batch reads the buckets of its own chunks, not the
history. Every step is told by the stores what is left to do, so a batch that is tried again after a failure goes on where it stopped and
changes nothing twice. Chunks that a provider did not finish are in the pending store; the next batch or run takes them again, and
those that are finished leave it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from regspark.operators.enrich import embedding_texts, enrich_chunks
from regspark.operators.ordered import first_by, last_by
from regspark.operators.state import to_enrich, to_index
from regspark.providers import EmbeddingProvider, TextProvider, add_embeddings
from regspark.session import cut_lineage
from regspark.sources.keyed import KeyedStore

STATE_SCHEMA = "chunk_id string, keywords array<string>, questions array<string>, summary string, indexed boolean, seq long"
ENRICHED = ["keywords", "questions", "summary"]


def state_store(spark: SparkSession, path: str) -> KeyedStore:
    return KeyedStore(spark, path, STATE_SCHEMA)


def index_store(spark: SparkSession, path: str) -> KeyedStore:
    return KeyedStore(spark, path, "chunk_id string")


def pending_store(spark: SparkSession, state_path: str) -> KeyedStore:
    return KeyedStore(spark, f"{state_path.rstrip('/')}-pending", "chunk_id string")


def read_state(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """M5: the state row of every chunk, or of the chunks in ``keys``; an empty table before the first run."""
    return state_store(spark, path).read(keys).drop("seq")


def read_pending(spark: SparkSession, state_path: str) -> DataFrame:
    """M3: chunks that earlier batches left without a state."""
    return pending_store(spark, state_path).read()


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Indexed chunks, the newest version of each."""
    return index_store(spark, path).read()


def one_row_a_chunk(chunks: DataFrame) -> DataFrame:
    """A chunk that comes several times in a batch counts once."""
    return first_by(chunks, ["chunk_id"], [F.xxhash64(*[c for c in chunks.columns if c != "chunk_id"])])


def index_batch(chunks: DataFrame, embedder: EmbeddingProvider, index_path: str, state_path: str) -> None:
    """M1: embed, store and mark one batch of enriched chunks. The mark comes last, so a failure leaves it unmarked."""
    spark = chunks.sparkSession
    views = {"v_text": "view_text", "v_summary": "view_summary", "v_questions": "view_questions"}
    vectors = add_embeddings(chunks.withColumns(embedding_texts()), views, embedder).drop(*views.values())
    index = index_store(spark, index_path)
    index.merge(vectors)
    stored = index.read(chunks.select("chunk_id"))
    state_store(spark, state_path).merge(stored.select("chunk_id", *ENRICHED, F.lit(True).alias("indexed")))


def enrich_batch(chunks: DataFrame, provider: TextProvider | None, state_path: str) -> None:
    """M4: enrich the chunks of a batch that have no state yet; rows the provider did not finish get none (M3)."""
    spark, chunks = chunks.sparkSession, one_row_a_chunk(chunks)
    todo = to_enrich(chunks, read_state(spark, state_path, chunks))
    done = enrich_chunks(todo, provider).filter(F.col("status").isin("ok", "empty"))
    state_store(spark, state_path).merge(done.select("chunk_id", *ENRICHED, F.lit(False).alias("indexed")))


def _index_ready(chunks: DataFrame, embedder: EmbeddingProvider, index_path: str, state_path: str) -> None:
    """Indexes the chunks whose state says that they are enriched and not indexed."""
    state = read_state(chunks.sparkSession, state_path, chunks)
    ready = to_index(chunks.drop(*ENRICHED), state).join(state.select("chunk_id", *ENRICHED), "chunk_id")
    ready = cut_lineage(ready)
    if not ready.isEmpty():
        index_batch(ready, embedder, index_path, state_path)


def index_stream(source: DataFrame, embedder: EmbeddingProvider, index_path: str, state_path: str, checkpoint: str,
                 idle_seconds: float | None = None) -> StreamingQuery:
    """M1: stream of enriched chunks into the index. With ``idle_seconds`` it keeps running on that trigger,
    without it drains what is there and stops. Batch size is the source's ``maxFilesPerTrigger``; for batches by count or idle time a
    source see ``streaming.flush``."""
    def write(df: DataFrame, batch_id: int) -> None:
        index_batch(cut_lineage(one_row_a_chunk(df)), embedder, index_path, state_path)

    w = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if idle_seconds is None else w.trigger(processingTime=f"{idle_seconds} seconds")
    return w.start()


def ingest_stream(source: DataFrame, provider: TextProvider | None, embedder: EmbeddingProvider, index_path: str,
                  state_path: str, checkpoint: str) -> StreamingQuery:
    """M4: stream of raw chunks: each micro-batch is enriched, its finished rows are indexed, chunks seen before are skipped.

    What the provider does not finish stays pending: the next batch takes it again, and so does the next run, before its stream.
    """
    def take(chunks: DataFrame) -> None:
        spark, pending = chunks.sparkSession, pending_store(chunks.sparkSession, state_path)
        chunks = cut_lineage(one_row_a_chunk(chunks))
        enrich_batch(chunks, provider, state_path)
        done = read_state(spark, state_path, chunks).select("chunk_id")
        left = cut_lineage(chunks.join(done, "chunk_id", "left_anti"))
        over = pending.read(done).select("chunk_id")
        if not (left.isEmpty() and over.isEmpty()):
            pending.merge(left, removed=over)
        _index_ready(chunks, embedder, index_path, state_path)

    def write(df: DataFrame, batch_id: int) -> None:
        take(df.unionByName(read_pending(df.sparkSession, state_path), allowMissingColumns=True))

    left = read_pending(source.sparkSession, state_path)
    if not left.isEmpty():
        take(left)
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def two_phase_run(chunks: DataFrame, provider: TextProvider | None, embedder: EmbeddingProvider, index_path: str, state_path: str) -> None:
    """M2: first index what is enriched but not indexed, then enrich the rest and index it."""
    base = one_row_a_chunk(chunks.drop(*ENRICHED))
    _index_ready(base, embedder, index_path, state_path)
    enrich_batch(base, provider, state_path)
    _index_ready(base, embedder, index_path, state_path)


def state_stream(events: DataFrame, state_path: str, checkpoint: str) -> StreamingQuery:
    """M5: stream of state transitions into the state store; an event that is older (``seq``) than the chunk's last event changes nothing.
    A micro-batch that runs again is applied once."""
    def write(df: DataFrame, batch_id: int) -> None:
        store = state_store(df.sparkSession, state_path)
        new = cut_lineage(last_by(df, ["chunk_id"], ["seq"]))
        known = store.read(new).select("chunk_id", F.col("seq").alias("_seq"))
        store.merge(new.join(known, "chunk_id", "left").filter("_seq is null or _seq < seq").drop("_seq"), writer=checkpoint, number=batch_id)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
