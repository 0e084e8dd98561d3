"""Whitening, substring deduplication and periodic runs against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from regspark.llm import periods, quality
from regspark.llm.passages import without_repeats
from regspark.llm.periods import Catcher, periodic_runs, runs_of
from regspark.llm.queries import QUERIES
from regspark.llm.whitening import whiten
from regspark.llm.words import Words, sliding_min


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def test_word_hashes_tell_words_apart():
    texts = ["a b  a", None, "", "\tb a\nb ", "x" * 3000 + " a", "aa a"]
    w = Words(pa.array(texts))
    want = [x for t in texts for x in (t or "").encode().split()]
    assert len(w.hash) == len(want) and list(np.diff(w.first)) == [3, 0, 0, 2, 2, 2]
    assert len({*zip(want, w.hash.tolist())}) == len(set(want)) == len(set(w.hash.tolist()))
    assert list(w.text_of()) == [0, 0, 0, 3, 3, 4, 4, 5, 5]
    s = Words(pa.array(texts).slice(3, 2))
    assert (s.hash == w.hash[3:7]).all()


@pytest.mark.parametrize("width", range(1, 12))
def test_sliding_min(width):
    x = np.random.default_rng(width).integers(0, 99, 40)
    assert list(sliding_min(x, width)) == [min(x[i:i + width]) for i in range(41 - width)]


def brute_runs(words, least):
    """Maximal stretches for every period, those of the least period each."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= 2 * q:
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= least)


def sequences():
    rnd = random.Random(5)
    yield []
    yield [1] * 70
    yield [1, 2] * 40 + [3] + [1, 2] * 21
    for letters in (2, 3, 5):
        for n in (3, 12, 31, 64, 200):
            yield [rnd.randrange(letters) for _ in range(n)]
    for _ in range(30):
        s = []
        while len(s) < 150:
            unit = [rnd.randrange(4) for _ in range(rnd.randint(1, 30))]
            s += (unit * rnd.randint(1, 4))[:rnd.randint(len(unit), 4 * len(unit))] + [rnd.randrange(50)]
        yield s
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    yield b  # a Fibonacci word: many runs


def test_runs_against_brute_force():
    cases = list(sequences())
    code = np.random.default_rng(3).integers(0, 1 << 63, 60, np.uint64)
    words = [code[np.array(s, int)] for s in cases]
    first = np.concatenate([[0], np.cumsum([len(s) for s in cases])])
    for least in (2, 12):
        want = [brute_runs(s, least) for s in cases]
        for piece in (1 << 16, 50):
            got = runs_of(np.concatenate(words), first, least, piece)
            assert [[tuple(r) for r in x.tolist()] for x in got] == want
    for s, w in zip(cases[-6:], words[-6:]):  # word by word, and what is known after each
        c = Catcher()
        for i in range(len(w)):
            c.append(w[i:i + 1])
            if i % 37 == 0:
                assert [(s_, e - s_, q) for s_, e, q in c.runs().tolist()] == brute_runs(s[:i + 1], 2)
        assert [(s_, e - s_, q) for s_, e, q in c.runs().tolist()] == brute_runs(s, 2)


def brute_periods(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len((text or "").encode().split())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words, 12)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    return {"doc_id": doc_id, "n_runs": len(runs), "start": best and best[0], "length": best and best[1], "period": best and best[2],
            "exponent_milli": best and 1000 * best[1] // best[2], "runs_sha256": sha("".join(f"{s},{x},{q}\n" for s, x, q in runs)),
            "collapsed_sha256": sha(b" ".join(w for i, w in enumerate(words) if i not in gone).decode())}


def test_periodic_runs_query(spark, sf):
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") < 6000]
    got = {r.doc_id: r.asDict() for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    assert len(docs) > 120 and any(got[r.doc_id]["n_runs"] for r in docs)
    for r in docs:
        assert got[r.doc_id] == brute_periods(r.doc_id, r.text)


def odd_rows():
    base = " ".join(f"w{i}" for i in range(40))
    return [(1, base, "a"), (2, base, "b"), (2, base, "b"), (3, None, None), (4, "", "c"), (5, " \n\t ", "d"), (None, base, "e"), (6, "short text", None),
            (7, "x " * 60, "f"), (0, "no no no", "g"), (8, "q " + base[:100] + "   " + base[50:], "h"), (9, "x " * 30 + base, "i"), (2, "another text " + base, "j")]


def brute_cuts(rows, window):
    first = {}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1 if i is not None else 0):
            x = tuple(w[k:k + window])
            first[x] = min(first.get(x, i), i)
    out = []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[k:k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone).decode())))
    return out


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("hot", [0, 2, 4096])
def test_passages_of_odd_rows(spark, hot):
    schema = "doc_id long, text string, n_words string"
    rows = odd_rows()
    got = without_repeats(spark.createDataFrame(rows, schema).repartition(3), hot=hot, shard=5).collect()
    assert order((r.doc_id, r.n_words, sum(c["to"] - c["from"] for c in r.cuts), sha(r.text or "")) for r in got) == order(brute_cuts(rows, 13))
    assert [r.text for r in got if r.doc_id == 3] == [None]
    assert without_repeats(spark.createDataFrame([], schema)).collect() == []
    assert without_repeats(spark.createDataFrame([(1, None), (2, "a b")], "doc_id int, text string")).count() == 2


@pytest.mark.parametrize("window", [5, 7, 13])
def test_passages_of_random_words(spark, window):
    rnd = random.Random(window)
    pool = [[str(rnd.randrange(30)) for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rnd.randint(0, 5)):
            p, a = rnd.choice(pool), rnd.randrange(50)
            words += p[a:a + rnd.randint(3, 40)] + [str(rnd.randrange(1000)) for _ in range(rnd.randint(0, 9))]
        rows.append((rnd.randrange(110), " ".join(words)))
    for hot in (3, 4096):
        got = without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), window, hot=hot, shard=40).collect()
        assert order((r.doc_id, r.n_words, sum(c["to"] - c["from"] for c in r.cuts), sha(r.text or "")) for r in got) == order(brute_cuts(rows, window))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_substring_query(spark, size):
    folder = f"/root/testdata/{size}"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = QUERIES["op12_substring_dedup"](spark, folder)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert order(map(tuple, got.collect())) == order(brute_cuts(docs, 13))


def brute_whitening(vectors):
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x)]
    y = np.array([[n * c - t for c, t in zip(v, s)] for v in x], float) / n
    values, basis = np.linalg.eigh(y.T @ y / n)
    deviation = [sum((n * c - t) ** 2 for c, t in zip(v, s)) for v in x]
    return n, deviation, y, values[::-1], basis[:, ::-1]


def test_whitening_query(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    n, deviation, y, values, basis = brute_whitening([r.embedding for r in table])
    got = QUERIES["op11_whitening"](spark, sf).collect()
    assert len(got) == 8 * n and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    of = {r.vec_id: i for i, r in enumerate(table)}
    for c in range(1, 9):
        rows = [r for r in got if r.component == c]
        assert {r.deviation == deviation[of[r.vec_id]] for r in rows} == {True}
        assert all(abs(r.explained / (values[c - 1] / values.sum()) - 1) < 1e-9 for r in rows)
        mine, want = np.array([r.whitened for r in rows]), np.array([y[of[r.vec_id]] @ basis[:, c - 1] / np.sqrt(values[c - 1]) for r in rows])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8


def test_whitening_of_odd_rows(spark):
    schema = "vec_id long, embedding array<double>, deviation string"
    rnd = np.random.default_rng(1)
    good = [(i, [float(v) for v in rnd.normal(0, 3, 5)], "x") for i in range(40)] + [(None, [9e300, -4.0, 0.0, 1.0, 2.0], None), (3, [0.0] * 5, "y"), (3, [0.0] * 5, "y")]
    bad = [(50, None, "z"), (51, [], "z"), (52, [1.0, None, 2.0, 3.0, 4.0], "z"), (53, [float("nan")] * 5, "z"), (54, [float("inf"), 0.0, 0.0, 0.0, 0.0], "z"), (55, [1.0, 2.0], "z")]
    w = whiten(spark.createDataFrame(good + bad, schema).repartition(3), block=4, components=3)
    rows = w.rows.collect()
    assert w.n == 43 == len(rows) and w.identity_error < 1e-6 and w.rows.columns == ["id", "deviation", "whitened"]
    assert [r.deviation for r in rows if r.id is None] == [None]  # beyond 64 bits
    small = [g for g in good if g[0] is not None]
    w = whiten(spark.createDataFrame(small, schema).repartition(3), block=4, components=9)
    n, deviation, y, values, _ = brute_whitening([g[1] for g in small])
    assert w.n == n and sorted(r.deviation for r in w.rows.collect()) == sorted(deviation)
    assert np.allclose(w.eigenvalues, values[:5]) and np.isclose(sum(w.explained), 1)
    assert {len(r.whitened) for r in w.rows.collect()} == {5}
    same = whiten(spark.createDataFrame([(1, [1.0, 2.0], "a")] * 3, schema))
    assert [(r.id, r.deviation, r.whitened) for r in same.rows.collect()] == [(1, 0, [])] * 3 and same.eigenvalues == []
    assert whiten(spark.createDataFrame([], schema)).rows.collect() == []
    assert whiten(spark.createDataFrame([(1, None, "a")], schema)).n == 0
    line = whiten(spark.createDataFrame([(i, [float(i), 2.0 * i], "a") for i in range(9)], schema))
    assert len(line.eigenvalues) == 1 and abs(line.explained[0] - 1) < 1e-9


def test_runs_of_odd_rows(spark):
    schema = "doc_id long, text string, runs string"
    rows = odd_rows() + [(11, "a b c " * 5 + "z", "k"), (11, "a b c " * 5 + "z", "k")]
    got = periodic_runs(spark.createDataFrame(rows, schema)).collect()
    want = [(i, None if t is None else brute_runs(t.encode().split(), 12)) for i, t, _ in rows]
    assert order((r.doc_id, r.n_words, [tuple(x) for x in r.runs]) for r in got) == order((i, len((t or "").encode().split()), x or []) for (i, x), (_, t, _) in zip(want, rows))
    assert {r.collapsed for r in got if r.doc_id == 11} == {"a b c z"} and [r.collapsed for r in got if r.doc_id == 3] == [None]
    assert periodic_runs(spark.createDataFrame([], schema)).collect() == []
    planted = periods.with_planted_period(spark.createDataFrame([(i, " \n".join(f"w{k}" for k in range(i)), "") for i in range(120)], schema)).collect()
    for r in planted:
        text = " \n".join(f"w{k}" for k in range(r.doc_id))
        if zlib.crc32(str(r.doc_id).encode()) % 10:
            assert r.text == text


def test_a_very_long_text(spark):
    """A text of 50 MB, one word of 2 MB in it."""
    rnd = np.random.default_rng(9)
    words = np.char.add("w", rnd.integers(0, 10**6, 7_000_000).astype(str)).tolist()
    words[1000:1400] = words[600:1000]
    text = " ".join(words[:3_000_000]) + " " + "y" * 2_000_000 + " " + " ".join(words[3_000_000:])
    docs = spark.createDataFrame([(1, " ".join(words[500:700])), (2, text)], "doc_id long, text string")
    found = {r.doc_id: r for r in periodic_runs(docs).select("doc_id", "n_words", "runs").collect()}
    assert found[2].n_words == 7_000_001 and [tuple(r) for r in found[2].runs] == [(600, 800, 400)]
    got = {r.doc_id: r for r in without_repeats(docs).select("doc_id", "n_words", "cuts").collect()}
    assert [tuple(c) for c in got[2].cuts] == [(500, 700), (1000, 1100)]


def test_scoring_a_batch_holds_little_beside_its_text():
    import tracemalloc

    text = " ".join(random.Random(1).choices(["alpha", "beta", "gamma9"], k=700))
    model = quality.Model(np.zeros(1 << quality.BITS, np.float32), np.zeros(1 << quality.BITS, np.float32))
    batch = pa.array([text] * 1200)  # 4.5 MB
    tracemalloc.start()
    scored = sum(len(model.z(data, offsets)) for _, data, offsets in quality.pieces(batch))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert scored == len(batch) and most < 120e6
