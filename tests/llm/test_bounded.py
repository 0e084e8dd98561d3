"""Operators that deal, judge, encode and write: against brute force, with the odd cases of every table."""

import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from regspark.llm import piece_codec, quality, sharding, token_files
from regspark.llm.common import new_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(-1, None), (None, ""), (None, "a  b \n c"), (5000, " lead"), (5001, "trail "), (5002, "x\n y  z  q <|endoftext|> it's 12 34!"), (5003, "\n"), (5003, "\n"), (5004, "é ▁ 日本 🎉 \x85 x"), (5005, "w" * 100_000)]


@pytest.fixture(scope="module")
def docs(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return d.union(spark.createDataFrame(ODD, "doc_id long, text string")).cache()


def empty(docs):
    return docs.limit(0)


def test_shards_have_all_rows_and_even_counts(spark, docs):
    d = docs.withColumns({"shard": F.lit("x"), "_k1": F.lit(1), "_bucket": F.lit(None).cast("int")})
    rows = sharding.deal(d, 7, seed=3).collect()
    assert Counter((r.doc_id, r.text, r._k1) for r in rows) == Counter((r.doc_id, r.text, 1) for r in docs.collect())
    of = Counter(r.shard for r in rows)
    assert set(of) == set(range(7)) and max(of.values()) - min(of.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in of.items())
    again = sharding.deal(d.repartition(5), 7, seed=3).collect()
    assert Counter((r.text, r.shard, r.slot) for r in again) == Counter((r.text, r.shard, r.slot) for r in rows)
    other = sharding.deal(d, 7, seed=4).collect()
    assert Counter((r.text, r.shard, r.slot) for r in other) != Counter((r.text, r.shard, r.slot) for r in rows)


def test_shards_of_hot_copies_and_empty_tables(spark, docs):
    d = spark.createDataFrame([(1, "a")] * 95 + [(None, None)] * 3 + [(i, "x") for i in range(9)], "doc_id long, text string")
    rows = sharding.deal(d, 4, hot_rows=10, bucket_bytes=100).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in d.collect())
    assert sorted((r.shard, r.slot) for r in rows) == [(s, i) for s in range(4) for i in range(27 - (s == 3))]
    assert sharding.deal(empty(docs), 4).collect() == []
    assert sorted((r.shard, r.slot) for r in sharding.deal(d.limit(2), 4).collect()) == [(0, 0), (1, 0)]


def test_written_shards(spark, docs):
    folder = new_folder(spark, "shards")
    sharding.write_shards(sharding.deal(docs, 3), folder)
    assert Counter(r.text for r in spark.read.parquet(folder).collect()) == Counter(r.text for r in docs.collect())


def brute_statistics(text):
    w = WORD.findall(text or "")
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    seen, dup = set(), 0
    for x in (text or "").split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum((text or "").count(s) for s in "#*$%&|<>"), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_statistics_equal_brute_force(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    d = docs.union(spark.createDataFrame([(1, "a b c a b c\na b\n\na b\n \n"), (2, "x " * 60 + "\xa0 é%\r\n")], "doc_id long, text string"))
    rows = quality.judged(d.withColumn("kept", F.lit("no")), labels).collect()
    assert len(rows) == d.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_statistics(r.text)
        assert not (r.base_failed and r.kept)
    assert quality.judged(empty(d), labels).collect() == []
    alone = quality.judged(d, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) and r.p_good is None for r in alone)


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").filter("quality is not null")
    model = quality.train(docs, labels, sample=800)
    used = {r[0] for r in labels.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(800).collect()}
    table = docs.join(labels, "doc_id").filter("length(text) > 300").select("doc_id", "text", "quality").toArrow()
    table = table.filter(pa.array([i not in used for i in table["doc_id"].to_pylist()])).combine_chunks()
    z = np.concatenate([model.z(data, offsets) for b in table.to_batches() for _, data, offsets in quality.pieces(b.column("text"))])
    p, y = model.p(z), np.asarray(table["quality"]) > 0
    assert ((p >= 0.5) == y).mean() > 0.95
    assert (p[y] >= 0.5).mean() > 0.98
    for low, high in ((0.0, 0.2), (0.8, 1.01)):  # calibrated
        own = (p >= low) & (p < high)
        assert abs(p[own].mean() - y[own].mean()) < 0.1


def test_features_do_not_depend_on_slices():
    texts = pa.array(["one two three", "two", "", None, " lead ab", "ab", "x" * 50])
    model = quality.Model(np.random.default_rng(1).random(1 << quality.BITS), np.random.default_rng(2).random(1 << quality.BITS))
    whole = np.concatenate([model.z(d, o) for _, d, o in quality.pieces(texts)])
    small = np.concatenate([model.z(d, o) for _, d, o in quality.pieces(texts, 4)])
    assert np.allclose(whole, small)
    shares = [v for _, d, o in quality.pieces(texts, 4) for v in quality.shares(d, o)]
    both = np.concatenate([model.words, model.chars])
    assert np.allclose([float((both[i] * v).sum()) for i, v in shares], whole, atol=1e-6)


def test_token_files_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path, folder = public_tokenizers.path("byte_bpe_50k.json"), new_folder(spark, "tokens")
    token_files.write_token_files(docs, folder, path, 2)
    got = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    t = Tokenizer.from_file(path)
    want = Counter((r.doc_id, tuple([*t.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in docs.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    token_files.write_token_files(empty(docs), f"{folder}-none", path, 2)
    assert token_files.read_token_files(spark, f"{folder}-none").collect() == []


def test_pieces_equal_the_library(spark, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    d = docs.withColumns({"ids": F.lit("old"), "decoded": F.lit(1), "same": F.lit(2)})
    rows = piece_codec.decode(piece_codec.encode(d, path, round_trip_col="same"), path).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
    for r in rows:
        assert r.ids == (None if r.text is None else own.encode(r.text))
        assert r.decoded == (None if r.text is None else own.decode(r.ids))
        assert r.same == (None if r.text is None else r.decoded == r.text)
    assert piece_codec.encode(empty(d), path).collect() == []


def test_broken_bytes_decode_like_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [own.piece_to_id("<0xE3>"), own.piece_to_id("▁the"), own.piece_to_id("<0x41>")]
    rows = piece_codec.decode(spark.createDataFrame([(1, ids), (2, []), (3, None)], "doc_id long, ids array<int>"), path).collect()
    assert [r.decoded for r in sorted(rows)] == [own.decode(ids), "", None]


def _field(number, kind, body):
    size = b"" if kind != 2 else bytes([len(body)])
    return bytes([number << 3 | kind]) + size + body


def test_unigram_model_with_byte_fallback():
    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{i:02X}>", -20.0, 6) for i in range(256)]]
    pieces += [(p, s, 1) for p, s in (("▁", -3.0), ("a", -4.0), ("b", -4.5), ("ab", -5.0), ("▁a", -4.2), ("▁ab", -4.9), ("ba", -6.0), ("c", -7.0), ("abab", -7.5))]
    data = b"".join(_field(1, 2, _field(1, 2, p.encode()) + _field(2, 5, struct.pack("<f", s)) + _field(3, 0, bytes([k]))) for p, s, k in pieces)
    data += _field(2, 2, _field(3, 0, b"\1") + bytes([0x98, 0x02, 1])) + _field(3, 2, _field(3, 0, b"\1") + _field(4, 0, b"\0"))
    own, codec = sentencepiece.SentencePieceProcessor(model_proto=data), piece_codec.Codec(data, 1, True)
    texts = ["", "ab", "abab ba", "  a b", "xé", "c abba 🎉", "ab " * 40]
    ids, ends = codec.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [own.encode(t) for t in texts]


def test_words_cut_into_parts_encode_as_the_library_does():
    """Also special tokens: their strings are tokens, as the library comes."""
    import random

    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, t = token_files.byte_level_encoder(path), Tokenizer.from_file(path)
    assert t.encode("x <|endoftext|> y", add_special_tokens=False).ids == [87, 220, 50256, 331]
    rnd = random.Random(4)
    parts = ["it's", "we'll", "'", "''", "'s", "s", "ré", "é", "Ω", "12", "3", ",", ".", "!?", "(", "word", "Abc", "_", "-", "—", "\u00a0", "日本", "🎉", "x\ny", "\t", "ab1", "\x00", "\x7f", "<|endoftext|>", "<|", "٣", "²"]
    texts = ["x <|endoftext|> y", "a<|endoftext|>b", "", None] + ["".join(rnd.choice(parts) + rnd.choice(["", "", " ", " ", "  "]) for _ in range(rnd.randint(1, 12))) for _ in range(4000)]
    for _ in range(2):  # the second time all words are known
        ids, ends = encoder.encode(pa.array(texts))
        got = [x.tolist() for x in np.split(ids, ends[:-1])]
        assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_signature_of_a_long_text_takes_little_memory():
    import tracemalloc

    import numpy as np

    from regspark.llm.shingles import signature

    hashes = np.unique(np.random.default_rng(1).integers(0, 2**64, 20_000, dtype=np.uint64))
    tracemalloc.start()
    own = signature(hashes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5e6
    assert own == signature(hashes, 1 << 12)
