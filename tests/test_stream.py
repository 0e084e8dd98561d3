"""Incremental ingest: streaming equals batch, failed batches stay pending, reruns change nothing."""

import sys

import pytest
from pyspark import cloudpickle

from regspark.operators.enrich import enrich_chunks
from regspark.operators.state import to_enrich, to_index
from regspark.providers import HashingEmbedding
from regspark.streaming import jobs

cloudpickle.register_pickle_by_value(sys.modules[__name__])
CHUNKS = "chunk_id string, text string, text_with_header string, header string, ordinance_code string"


class Echo:
    def complete(self, prompt):
        return "1. ¿Cuál es la altura máxima permitida?\n- corta?\n2. ¿Qué usos se permiten aquí?"


class Quota:
    """Fails with a rate limit on every text that names a quota."""

    def complete(self, prompt):
        if "cuota" in prompt:
            raise RuntimeError("429: try again in 900s")
        return "¿Qué regula este artículo de la norma?"


def chunks(spark, n=12, word="altura"):
    return spark.createDataFrame([(f"c{i}", f"texto {i} {word if i % 3 else 'cuota'}", f"cab\n\ntexto {i}", "cab", "U1") for i in range(n)], CHUNKS)


def test_enrichment_and_error_rows(spark):
    rows = {r["chunk_id"]: r for r in enrich_chunks(chunks(spark), Quota()).collect()}
    assert rows["c0"]["status"] == "quota" and rows["c1"]["status"] == "ok"
    full = enrich_chunks(chunks(spark), Echo()).first()
    assert full["questions"] == ["¿Cuál es la altura máxima permitida?", "¿Qué usos se permiten aquí?"]


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    src, index, state = (str(tmp_path / n) for n in ("src", "index", "state"))
    chunks(spark).repartition(3).write.parquet(src)
    source = lambda: spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).parquet(src)

    def go():
        q = jobs.ingest_stream(source(), Echo(), HashingEmbedding(16), index, state, str(tmp_path / "ck"))
        q.awaitTermination(120)
        assert q.exception() is None

    go()
    assert jobs.read_index(spark, index).count() == 12
    chunks(spark, 15).coalesce(1).write.mode("append").parquet(src)  # old chunks again, and three new ones
    go()
    got = {r["chunk_id"]: r["indexed"] for r in jobs.read_state(spark, state).collect()}
    assert len(got) == 15 and all(got.values())
    batch_index, batch_state = str(tmp_path / "bi"), str(tmp_path / "bs")
    jobs.two_phase_run(chunks(spark, 15), Echo(), HashingEmbedding(16), batch_index, batch_state)
    pick = lambda p: sorted((r["chunk_id"], tuple(r["keywords"]), tuple(r["v_text"])) for r in jobs.read_index(spark, p).collect())
    assert pick(index) == pick(batch_index)


def test_rows_left_by_a_provider_are_taken_by_the_next_run(spark, tmp_path):
    index, state = str(tmp_path / "i"), str(tmp_path / "s")
    data = chunks(spark)
    jobs.two_phase_run(data, Quota(), HashingEmbedding(16), index, state)
    left = to_enrich(data, jobs.read_state(spark, state))
    assert {r["chunk_id"] for r in left.collect()} == {"c0", "c3", "c6", "c9"}
    jobs.two_phase_run(data, Echo(), HashingEmbedding(16), index, state)
    assert jobs.read_index(spark, index).count() == 12
    assert to_index(data, jobs.read_state(spark, state)).count() == 0


def test_index_failure_leaves_the_batch_unmarked(spark, tmp_path):
    class Broken:
        dim = 4

        def embed(self, texts):
            raise ValueError("model gone")

    index, state = str(tmp_path / "i"), str(tmp_path / "s")
    data = chunks(spark, 3)
    with pytest.raises(Exception):
        jobs.two_phase_run(data, None, Broken(), index, state)
    assert {r["indexed"] for r in jobs.read_state(spark, state).collect()} == {False}
    jobs.two_phase_run(data, None, HashingEmbedding(4), index, state)
    assert {r["indexed"] for r in jobs.read_state(spark, state).collect()} == {True}


def test_state_stream_keeps_the_newest_row(spark, tmp_path):
    src, state = str(tmp_path / "e"), str(tmp_path / "s")
    log = [("a", ["k"], [], "s1", False, 1), ("a", ["k"], [], "s2", True, 2), ("b", [], [], "", False, 3)]
    spark.createDataFrame(log, jobs.STATE_SCHEMA).coalesce(1).write.parquet(src)
    q = jobs.state_stream(spark.readStream.schema(jobs.STATE_SCHEMA).parquet(src), state, str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert {(r["chunk_id"], r["summary"], r["indexed"]) for r in jobs.read_state(spark, state).collect()} == {("a", "s2", True), ("b", "", False)}


def test_stream_takes_pending_rows_again_and_duplicates_once(spark, tmp_path):
    src, index, state = (str(tmp_path / n) for n in ("src", "index", "state"))
    chunks(spark).union(chunks(spark)).coalesce(1).write.parquet(src)

    def go(provider):
        q = jobs.ingest_stream(spark.readStream.schema(CHUNKS).parquet(src), provider, HashingEmbedding(16), index, state, str(tmp_path / "ck"))
        q.awaitTermination(120)
        assert q.exception() is None

    go(Quota())
    assert {r["chunk_id"] for r in jobs.read_pending(spark, state).collect()} == {"c0", "c3", "c6", "c9"}
    assert jobs.read_index(spark, index).count() == 8 == jobs.read_state(spark, state).count()
    go(Echo())  # nothing new in the source
    got = {r["chunk_id"]: r["indexed"] for r in jobs.read_state(spark, state).collect()}
    assert len(got) == 12 and all(got.values()) and jobs.read_pending(spark, state).isEmpty()
    assert jobs.read_index(spark, index).count() == 12
    before = sorted(map(str, jobs.read_state(spark, state).collect()))
    store = jobs.state_store(spark, state)
    store.compact()
    assert sorted(map(str, jobs.read_state(spark, state).collect())) == before
    assert len(store.pointer().folders) == 1
    pending = jobs.pending_store(spark, state)
    pending.compact()
    assert spark.read.schema("chunk_id string").parquet(f"{state}-pending/data/{pending.pointer().folders[0]}").count() == 0  # it shrinks
    jobs.two_phase_run(chunks(spark, 15), Echo(), HashingEmbedding(16), index, state)
    assert jobs.read_state(spark, state).filter("indexed").count() == 15


def test_older_events_and_batches_that_run_again_change_nothing(spark, tmp_path):
    src, state = str(tmp_path / "e"), str(tmp_path / "s")
    go = lambda ck: jobs.state_stream(spark.readStream.schema(jobs.STATE_SCHEMA).parquet(src), state, str(tmp_path / ck)).awaitTermination(60)
    row = lambda i, s, seq: (i, [], [], s, False, seq)
    spark.createDataFrame([row("a", "new", 9), row("b", "one", 1)], jobs.STATE_SCHEMA).coalesce(1).write.parquet(src)
    go("ck")
    spark.createDataFrame([row("a", "late", 3), row("b", "two", 2)], jobs.STATE_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    go("ck")
    assert {(r.chunk_id, r.summary) for r in jobs.read_state(spark, state).collect()} == {("a", "new"), ("b", "two")}
    before = jobs.state_store(spark, state).pointer()
    go("ck2")  # another query reads all again: nothing newer
    assert {(r.chunk_id, r.summary) for r in jobs.read_state(spark, state).collect()} == {("a", "new"), ("b", "two")}
    assert before.applied == {str(tmp_path / "ck"): 1}


def test_flush_by_count_and_idle_time(spark, tmp_path):
    """M1: ten rows or one idle second a source; a failed write and a restart lose and repeat nothing."""
    from regspark.streaming import flush

    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", flush.STATE_STORE)
    try:
        schema = "source string, n int"
        put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        put([("a", i) for i in range(23)] + [("b", i) for i in range(4)])
        failed = []

        def write(df):
            if not failed:
                failed.append(1)
                raise ValueError("store gone")
            df.write.mode("append").parquet(out)

        def go(seconds, write=write):
            q = flush.flush_stream(spark.readStream.schema(schema).parquet(src), write, str(tmp_path / "ck"), most=10, idle_seconds=1)
            try:
                q.awaitTermination(seconds)
            finally:
                q.stop()

        with pytest.raises(Exception, match="store gone"):
            go(60)
        go(25)
        got = lambda: sorted((r.source, r.flush, r.reason, r.n) for r in spark.read.parquet(out).collect())
        want = [("a", i // 10, "count" if i < 20 else "idle", i) for i in range(23)] + [("b", 0, "idle", i) for i in range(4)]
        assert got() == sorted(want)
        put([("a", 100)])  # the number of flushes is state, too
        go(20)
        assert got() == sorted([*want, ("a", 3, "idle", 100)])
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
