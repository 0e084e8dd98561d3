"""Keyed stores, pruned search, text index and dictionary join against plain recomputation."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from regspark.functions import features as FE
from regspark.operators import cells, terms
from regspark.operators import retrieve as V
from regspark.providers import HashingEmbedding
from regspark.sources.keyed import Conflict, KeyedStore

ROWS = "chunk_id string, source string, text string, seq long"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_store_replaces_by_key(spark, tmp_path):
    make = lambda: KeyedStore(spark, str(tmp_path / "s"), ROWS, buckets=4)
    store = make()
    frame = lambda rows: spark.createDataFrame(rows, ROWS)
    assert store.read().collect() == []
    store.merge(frame([("c1", "A", "one", 1), ("c2", "A", "two", 1), ("c3", "B", "three", 1), (None, "B", "no key", 1)]))
    store.merge(frame([("c1", "B", "moved", 2), ("c4", "B", "four", 2), ("c4", "B", "four", 2)]))
    want = [("c1", "B", "moved", 2), ("c2", "A", "two", 1), ("c3", "B", "three", 1), ("c4", "B", "four", 2)]
    assert rows_of(store.read()) == want
    held = store.read()  # a reader from before
    store.merge(frame([]), removed=frame([("c2", None, None, None), ("c9", None, None, None)]))
    assert rows_of(make().read()) == [w for w in want if w[0] != "c2"]
    store.compact()
    assert len(store.pointer().folders) == 1 and rows_of(make().read()) == [w for w in want if w[0] != "c2"]
    assert rows_of(held) == want
    assert len(store.vacuum(keep=1)) == 3 and rows_of(make().read()) == [w for w in want if w[0] != "c2"]
    store.merge(frame([("c2", "C", "back", 3)]).withColumn("extra", F.lit(7)))
    assert rows_of(make().read()) == [(*w, None) for w in [*want[:1], ("c2", "C", "back", 3), *want[2:]] if w[0] != "c2"][:1] + [("c2", "C", "back", 3, 7)] + [(*w, None) for w in want[2:]]


def test_store_versions_retries_and_conflicts(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), ROWS, version=("seq",), buckets=3, compact_after=3)
    frame = lambda *rows: spark.createDataFrame(rows, ROWS)
    assert store.merge(frame(("a", "x", "new", 9), ("a", "x", "old", 3)), writer="w", number=0)
    assert not store.merge(frame(("a", "x", "again", 99)), writer="w", number=0)
    store.merge(frame(("a", "x", "late", 5)), writer="w", number=1)
    assert rows_of(store.read()) == [("a", "x", "new", 9)]
    store.merge(frame(), removed=frame(("a", "", "", 0)))
    assert rows_of(store.read()) == []
    store.merge(frame(("a", "x", "after", 1)))
    assert len(store.pointer().folders) == 1  # compacted by itself
    assert rows_of(store.read()) == [("a", "x", "after", 1)]
    seen = store.pointer()
    store.merge(frame(("b", "x", "first", 1)))
    with pytest.raises(Conflict):
        store._commit(seen, ("gone",), {}, seen.schema)
    assert rows_of(store.read()) == [("a", "x", "after", 1), ("b", "x", "first", 1)]


def test_a_read_by_keys_reads_their_buckets(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), ROWS, buckets=32)
    data = spark.range(2000).select(F.col("id").cast("string").alias("chunk_id"), F.lit("s").alias("source"), F.lit("t").alias("text"), F.col("id").alias("seq"))
    store.merge(data)
    store.merge(data.filter("seq % 3 = 0").withColumn("text", F.lit("u")))
    keys = spark.createDataFrame([("7",), ("9",), ("none",)], "chunk_id string")
    got = store.read(keys)
    assert rows_of(got) == [("7", "s", "t", 7), ("9", "s", "u", 9)]
    scans = re.findall(r"PartitionFilters: \[([^\]]*)\]", got._jdf.queryExecution().executedPlan().toString())
    assert len(scans) >= 2 and all("bucket" in x for x in scans)


def test_upsert_into_a_collection_moves_a_chunk(spark, tmp_path):
    from regspark.sources import sinks

    path = str(tmp_path / "c")
    frame = lambda *rows: spark.createDataFrame(rows, ROWS)
    sinks.write_collection(frame(("c1", "A", "one", 1), ("c2", "B", "two", 1), ("c3", "B", "three", 1)), path)
    sinks.upsert_collection(spark, path, str(tmp_path / "stage"), frame(("c1", "B", "moved", 2)), ["seq"])
    got = spark.read.parquet(path).select(*ROWS.replace(",", "").split()[::2])
    assert rows_of(got) == [("c1", "B", "moved", 2), ("c2", "B", "two", 1), ("c3", "B", "three", 1)]


# ------------------------------------------------------------------ pruned search


def collection(spark, n=1500, dim=12, seed=1):
    rnd = np.random.default_rng(seed)
    middle = rnd.normal(size=(20, dim))
    v = lambda: (middle[rnd.integers(20)] + rnd.normal(scale=0.25, size=dim)).tolist()
    rows = [(f"c{i}", f"U{i % 3}", v(), v() if i % 7 else None, [0.0] * dim if i % 50 == 0 else v()) for i in range(n)]
    rows += [("twin1", "U1", rows[min(3, n - 1)][2], None, None), ("twin2", "U2", rows[min(3, n - 1)][2], None, None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, ordinance_code string, v_text array<double>, v_summary array<double>, v_questions array<double>").repartition(4)
    queries = spark.createDataFrame([(i, v(), f"U{i % 4}" if i % 5 else "") for i in range(30)] + [(99, None, "U1")], "query_id int, vector array<double>, ordinance_code string")
    return chunks, queries


def test_pruned_search_equals_the_full_search(spark, tmp_path):
    chunks, queries = collection(spark)
    index = cells.build_index(chunks, str(tmp_path / "i"), code=F.col("ordinance_code"), cells=24, block_rows=32)
    for k, floor in ((5, 0.3), (40, None)):
        want = V.similarity_hits(queries, chunks, k, floor)
        found = cells.pruned_search(queries, index, k, floor)
        assert rows_of(found.hits.select(want.columns)) == rows_of(want)
        share = found.read.agg(F.sum("scored") / F.sum("all_vectors")).first()[0]
        assert share < (0.25 if k == 5 else 0.7), share
    coded = queries.withColumn("_code", F.expr("nullif(ordinance_code, '')"))
    want = V.similarity_hits(coded, chunks, 5, 0.3, match=("_code", "ordinance_code"))
    found = cells.pruned_search(coded, index, 5, 0.3, "_code")
    assert rows_of(found.hits.select(want.columns)) == rows_of(want)
    assert found.read.filter("query_id = 1 and view = 'text'").first().all_vectors == chunks.filter("ordinance_code = 'U1'").count()


def test_zone_search_equals_the_masked_search(spark, tmp_path):
    chunks, queries = collection(spark, 400)
    queries = queries.withColumn("plain", F.reverse("vector"))
    index = cells.build_index(chunks, str(tmp_path / "i"), code=F.col("ordinance_code"), cells=8, block_rows=20)
    want = V.with_fallback(queries, chunks, 6, fallback_vector="plain")
    got = cells.zone_search(queries, index, 6, fallback_vector="plain")
    assert rows_of(got.select(want.columns)) == rows_of(want) and got.filter("used_fallback").count() > 0


def test_pruned_search_of_small_collections(spark, tmp_path):
    chunks, queries = collection(spark, 3)
    index = cells.build_index(chunks, str(tmp_path / "a"), {"text": "v_text"})
    assert cells.pruned_search(queries, index, 5, None).hits.count() == 5 * 30
    assert cells.pruned_search(queries.limit(0), index).hits.collect() == []
    index = cells.build_index(chunks.limit(0), str(tmp_path / "b"), {"text": "v_text"})
    assert cells.pruned_search(queries, index).hits.collect() == []


# ------------------------------------------------------------------ terms


def texts(spark, n=120, seed=3):
    rnd = random.Random(seed)
    rows = [(f"t{i}", "".join(rnd.choice("abcñ .") for _ in range(rnd.randint(0, 60)))) for i in range(n)] + [("null", None), ("empty", ""), ("a's", "aaaaaaa")]
    return spark.createDataFrame(rows, "id string, text string"), rows


TERMS = ["a", "ñ", "ab", "aa", "a.", "abc", "aaaa", "b ñ", "c.a", "zzz", "abca", " ", "", None, "\\E", "%", "a" * 9]


def brute_places(rows, wanted):
    out = []
    for t in {t for t in wanted if t}:
        for i, x in rows:
            at = [p + 1 for p in range(len(x or "")) if x[p:p + len(t)] == t]
            if at:
                out.append((t, i, at))
    return sorted(out)


def test_occurrences_of_many_terms(spark):
    data, rows = texts(spark)
    table = spark.createDataFrame([(t,) for t in TERMS + TERMS[:3]], "term string")
    want = brute_places(rows, TERMS)
    assert rows_of(terms.occurrences(data, table, "id", "text").select("term", "id", "places")) == sorted(want, key=repr)
    assert terms.occurrences(data.limit(0), table, "id", "text").collect() == []
    n = terms.occurrences(data, table, "id", "text").select("term", "id", terms.count_apart(F.col("places"), F.length("term")).alias("n"))
    texts_of = dict(rows)
    assert all(r.n == texts_of[r.id].count(r.term) for r in n.collect())


def test_text_index_by_batches(spark, tmp_path):
    data, rows = texts(spark)
    folder = str(tmp_path / "i")
    table = spark.createDataFrame([(t,) for t in TERMS], "term string")
    assert terms.search_index(spark, folder, table).collect() == []
    terms.add_to_index(folder, data, "0001", "id", "text")
    again = [(i, (x or "")[::-1]) for i, x in rows[::3]] + [("new", "abcñ abc")]
    for _ in range(2):  # a batch that runs again
        terms.add_to_index(folder, spark.createDataFrame(again, "id string, text string"), "0002", "id", "text")
    now = list((dict(rows) | dict(again)).items())
    assert rows_of(terms.search_index(spark, folder, table).select("term", "id", "places")) == sorted(brute_places(now, TERMS), key=repr)


def test_dictionary_join_equals_the_dictionary_in_the_plan(spark):
    rnd = random.Random(8)
    words = ["solar", "sol", "piscina", "pis", "altura", "alt", "uso", "suelo", "a", "máxima"]
    dictionary = [(rnd.choice(words) + rnd.choice(["", " " + rnd.choice(words)]), [rnd.choice(words) for _ in range(rnd.randint(0, 4))]) for _ in range(60)]
    asked = [(i, " ".join(rnd.choice(words).title() for _ in range(rnd.randint(0, 6)))) for i in range(80)] + [(80, None), (81, "")]
    q = spark.createDataFrame(asked, "query_id int, text string")
    got = terms.expand_questions(q, terms.dictionary_table(spark, dictionary))
    m = FE.expansion_matches("text", dictionary)
    want = q.select("query_id", F.transform(m, lambda h: h["term"]).alias("terms"), FE.expand_query("text", dictionary).alias("expanded"))
    assert rows_of(got.filter("text is not null").select("query_id", "terms", "expanded")) == rows_of(want.filter("query_id <> 80"))
    assert got.filter("query_id = 80").count() == 1


def test_questions_are_embedded_once(spark):
    from regspark.plans import retrieval

    seen = spark.sparkContext.accumulator(0)

    class Counting(HashingEmbedding):
        def embed(self, texts):
            seen.add(len(texts))
            return super().embed(texts)

    v = F.array(*[F.rand(i) for i in range(8)])
    chunks = spark.range(50).select(F.col("id").cast("string").alias("chunk_id"), F.lit("s").alias("source"), F.lit("1").alias("article_no"), F.lit("h").alias("header"), F.lit("t").alias("text"),
                                    F.lit("U1").alias("ordinance_code"), v.alias("v_text"), v.alias("v_summary"), v.alias("v_questions"))
    q = spark.range(20).select(F.col("id").alias("query_id"), F.concat(F.lit("altura "), "id").alias("text"), F.lit("U1").alias("code"), F.lit("es").alias("language"), F.expr("cast(array() as array<struct<role:string,text:string>>)").alias("history"))
    retrieval.answer_requests(q, chunks, Counting(8), [("altura", ["alto"])], "system").collect()
    assert seen.value == 40


def test_only_postings_of_the_terms_are_kept(spark):
    texts = spark.createDataFrame([(1, "abcdef xyz"), (2, "zb")], "id int, text string")
    asked = spark.createDataFrame([("bcde",), ("z",), (None,), ("",)], "term string")
    kept = terms._of_terms(terms.postings(texts, "id", "text"), asked, "term", 3)
    assert sorted((r.gram, r.id, r.place) for r in kept.collect()) == [("bcd", 1, 2), ("cde", 1, 3), ("z" + terms.END * 2, 1, 10), ("zb" + terms.END, 2, 1)]


@pytest.mark.parametrize("q", [1, 3, 4])
def test_places_of_a_text_are_a_row_a_gram(spark, q):
    """A text of n characters gives a row for each different q-gram, not for each place; long texts are cut into stretches."""
    rows = [(1, "abcabc ñ😀abc" * 9), (2, ""), (3, None), (4, "a"), (5, "ab" * 40)]
    data = spark.createDataFrame(rows, "id int, text string")
    want = sorted((r.gram, r.id, r.place) for r in terms.postings(data, "id", "text", q).collect())
    for most in (1 << 20, 7):
        got = terms.places(data, "id", "text", q, most).collect()
        assert sorted((r.gram, r.id, p) for r in got for p in r.places) == want
    assert len([r for r in terms.places(data, "id", "text", q).collect() if r.id == 5]) <= 2 * q + 2


def test_the_stored_index_has_no_row_a_place(spark, tmp_path):
    folder = str(tmp_path / "i")
    terms.add_to_index(folder, spark.createDataFrame([(1, "abc" * 1000)], "id int, text string"), "0001", "id", "text")
    kept = [f for f in tmp_path.rglob("batch=0001") if f.parent.name not in ("texts", "grams")]
    assert len(kept) == 1 and spark.read.parquet(str(kept[0])).count() == 5


def test_the_index_is_written_without_a_shuffle_of_its_rows(spark, tmp_path):
    """A row of the index stands for a q-gram of many texts, and neither writing nor reading shuffles the whole index."""
    rows = [(i, f"text {i % 7} of {i}" + "x" * (i % 5)) for i in range(400)]
    data = spark.createDataFrame(rows, "id int, text string").repartition(2)
    folder = str(tmp_path / "i")
    terms.add_to_index(folder, data, "0001", "id", "text")
    kept = [f for f in tmp_path.rglob("batch=0001") if f.parent.name not in ("texts", "grams")]
    assert len(kept) == 1 and spark.read.parquet(str(kept[0])).count() < terms.places(data, "id", "text").count() / 2
    asked = spark.createDataFrame([("7 of",), ("xxxx",), ("t 3 o",), ("9",)], "term string")
    for most in (200_000, 0):  # anchors sent to all tasks, or joined
        found = terms.search_index(spark, folder, asked, most=most)
        assert rows_of(found.select("term", "id", "places")) == sorted(brute_places(rows, ["7 of", "xxxx", "t 3 o", "9"]), key=repr)
        assert ("LeftSemi" in found._jdf.queryExecution().executedPlan().toString()) == (most > 0)
