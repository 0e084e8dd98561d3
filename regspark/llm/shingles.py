"""Near copies by the Jaccard similarity of word shingles, through an inverted index of byte positions with count filtering.

A document is the set of the XXH64 values of its ``width``-word shingles (words and case as in ``simhash``; fewer words are one
shingle). Its signature has POSITIONS bytes, each the last byte of a MinHash value, so two documents of similarity s have
a byte in common with probability s + (1 - s) / 256. At 0.8 a pair shares LEAST_EQUAL = 134 bytes of 192 with probability
0.9998: the minimum of the count filter. A list for each single positional byte would hold 1/256 of all documents, so an
entry of the index is a set of six positions with their bytes; of the 32 sets a pair at 0.8 has one in common with probability
0.99994. Pairs that meet are tallied over all positions, those that reach the minimum are verified by their whole shingle sets.

The index holds distinct sets, so copies of a text meet nowhere, and a list is not paired out. Its members are compared with the one that
is in the longest lists overall: of a group of edited copies that is the text they were made from. Where members of a list stay apart
after that, those that are not in its largest class are tallied against the others of the list, in slices, and only
pairs of different classes that reach the minimum are verified; so no list is cut short.

Null text counts as empty; texts without words are equal. Rows that repeat, rows without id, extra columns and empty tables are
treated as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regspark.llm.common import cut_lineage, numbered, row_key
from regspark.llm.components import components
from regspark.llm.words import whole_groups

POSITIONS, IN_SET, LEAST_EQUAL = 192, 6, 134
SETS = POSITIONS // IN_SET
_COMPARED = 4 << 20  # bytes of signatures compared at once; where nearly all pairs reach the minimum, four such arrays are held
_MIX = np.random.default_rng(42).integers(0, 1 << 63, (2, POSITIONS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, width: int = 5, seed: int = 42) -> np.ndarray:
    """Distinct shingle hashes of a UTF-8 text, sorted."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([h(b" ".join(words), seed)], np.uint64)
    return np.unique(np.fromiter((h(b" ".join(x), seed) for x in zip(*(words[k:] for k in range(width)))), np.uint64))


def signature(hashes: np.ndarray, block: int = 1 << 9) -> bytes:
    """A byte for each position; none for the empty set."""
    if not len(hashes):
        return b""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), block):
        mixed = (hashes[i:i + block, None] ^ _MIX[0]) * _MIX[1]
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0), out=least)
    return (least & np.uint64(0xFF)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_k1, _k2, id, node, sig`` of every row; ``node`` is a hash of the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            nodes, sigs = [], []
            for t in pc.fill_null(b.column(3), "").cast(pa.binary()):
                own = shingle_set(t.as_py(), width)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), 7))
                sigs.append(signature(own))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sigs, pa.binary())], ["_k1", "_k2", "id", "node", "sig"])

    thin = docs.select(*row_key([id_col, text_col]), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return thin.mapInArrow(run, "_k1 long, _k2 long, id long, node long, sig binary")


def index_entries(nodes: DataFrame) -> DataFrame:
    """``key, s, node`` for each set of positions of rows (node, sig); ``s`` is the set's number, which is in the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            keys = [xxhash.xxh64_intdigest(s[i:i + IN_SET], i) for s in b.column(1).to_pylist() for i in range(0, POSITIONS, IN_SET)]
            node, s = np.repeat(np.asarray(b.column(0)), SETS), np.tile(np.arange(SETS, dtype=np.int32), b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(s), pa.array(node)], ["key", "s", "node"])

    return nodes.filter("length(sig) > 0").select("node", "sig").mapInArrow(run, "key long, s int, node long")


def _bytes_of(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, POSITIONS)


def tallied(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (a, b) that share LEAST_EQUAL positional bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            enough = (_bytes_of(b.column(2)) == _bytes_of(b.column(3))).sum(axis=1) >= LEAST_EQUAL
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(enough))

    one, two = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """``node, s``: the shingle sets of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column(1), "").cast(pa.binary())
            for i in range(0, b.num_rows, 256):
                own = [shingle_set(t.as_py(), width).view(np.int64) for t in texts[i:i + 256]]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:i + 256], pa.array(own, pa.list_(pa.int64()))], ["node", "s"])

    return texts.mapInArrow(run, "node long, s array<long>").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have similarity ``least``."""
    one, two = sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    n, m, both = F.size("sa"), F.size("sb"), F.size(F.array_intersect("sa", "sb"))
    met = pairs.join(one, "a").join(two, "b").filter(F.least(n, m) >= F.greatest(n, m) * least - 1e-9)
    return met.filter(both >= (n + m - both) * least - 1e-9).select("a", "b")


def apart(entries: DataFrame, tied: DataFrame, sigs: DataFrame, slice_rows: int = 20_000) -> DataFrame:
    """Pairs (a, b) of different classes that share a list and reach the minimum: members outside a list's largest class against all others."""
    now = entries.select("key", "s", "node").join(tied, "node", "left").select("key", "s", "node", F.coalesce("root", "node").alias("root"))
    classes = now.groupBy("key", "root").count()
    lists = classes.groupBy("key").agg(F.max(F.struct("count", "root")).alias("top"), F.sum("count").alias("n")).filter("n > top.count")
    lists = lists.select("key", F.col("top.root").alias("main"), F.ceil(F.col("n") / slice_rows).cast("int").alias("slices"))
    members = now.join(lists, "key").withColumn("few", F.col("root") != F.col("main"))
    # the largest class is dealt out over the slices of a long list, the others are in each
    own = F.pmod(F.xxhash64("node"), "slices").cast("int")
    placed = members.withColumn("own", own).withColumn("slice", F.explode(F.when(F.col("few"), F.sequence(F.lit(0), F.col("slices") - 1)).otherwise(F.array("own"))))
    rows = placed.select(F.xxhash64("key", "slice").alias("list"), "s", "node", "root", F.col("few"), (F.col("own") == F.col("slice")).alias("home")).join(sigs, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            which, node, root = (t.column(k).to_numpy() for k in ("list", "node", "root"))
            number = t.column("s").to_numpy()
            few, home, sig = np.asarray(t.column("few")), np.asarray(t.column("home")), _bytes_of(t.column("sig"))
            edge = np.append(np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])), len(which))
            out: list[np.ndarray] = []
            for s, e in zip(edge[:-1], edge[1:]):
                asks = s + np.flatnonzero(few[s:e])
                step = max(1, _COMPARED // (POSITIONS * (e - s)))
                for i in range(0, len(asks), step):
                    q = asks[i:i + step]
                    equal = (sig[q, None] == sig[None, s:e]).sum(axis=2, dtype=np.int16)
                    # two members outside the largest class meet in every slice: there, the one with the larger number is asked at home
                    once = ~few[None, s:e] | ((node[q, None] > node[None, s:e]) & home[q, None])
                    x, y = np.nonzero((equal >= LEAST_EQUAL) & (root[q, None] != root[None, s:e]) & once)
                    # a pair that shares several lists, which all stand apart, is named in the first of them
                    shared = (sig[q[x]] == sig[s + y]).reshape(-1, SETS, IN_SET).all(axis=2).argmax(axis=1)
                    x, y = x[shared == number[s]], y[shared == number[s]]
                    out.append(np.stack([node[q[x]], node[s + y]]))
            a, b = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    dealt = rows.repartition("list").sortWithinPartitions("list").select("list", "s", "node", "root", "few", "home", "sig")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def links(entries: DataFrame, sigs: DataFrame, sets: DataFrame, least: float = 0.8) -> DataFrame:
    """``node, root`` of the components of the candidates that have similarity ``least``. ``entries``: key, node, n (length) of lists with two members or more."""
    score = entries.groupBy("node").agg(F.sum("n").alias("score"))
    leads = entries.join(score, "node").groupBy("key").agg(F.max(F.struct("score", "node")).alias("l")).select("key", F.col("l.node").alias("other"))
    met = entries.join(leads, "key").filter("node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    tied = components(verified(tallied(met, sigs), sets, least))
    tied = cut_lineage(tied.union(tied.select("root", "root").distinct()))  # components names no root as a node
    more = cut_lineage(verified(apart(entries, tied, sigs), sets, least))
    if more.isEmpty():
        return tied
    # what the second step links are classes of the first
    root = tied.select("node", "root")
    between = more.join(root.toDF("a", "ra"), "a", "left").join(root.toDF("b", "rb"), "b", "left")
    joined = components(between.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    ends = more.select("a").union(more.select("b")).toDF("node").distinct().join(tied, "node", "left_anti").select("node", F.col("node").alias("root"))
    top = joined.toDF("root", "top")
    return tied.union(ends).join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def near_copies(docs: DataFrame, width: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_k1, _k2, doc_id, component_id, stays`` for every row; of the rows of a component that differ in id or text, the one
    with the smallest id stays."""
    rows = cut_lineage(signatures(docs, width, id_col, text_col))
    order = F.struct(F.col("id").isNull().alias("no"), "id", "_k1", "_k2")
    distinct = rows.groupBy("node").agg(F.min(order).alias("first"), F.first("sig").alias("sig"))
    keyed = index_entries(distinct)
    entries = cut_lineage(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key"))
    need = entries.select("node").distinct().join(distinct, "node").select("node", "first._k1", "first._k2", "sig")
    texts = docs.select(*row_key([id_col, text_col]), F.col(text_col).alias("text")).join(need, ["_k1", "_k2"]).select("node", "text")
    tied = links(entries, cut_lineage(need.select("node", "sig")), cut_lineage(_sets(texts, width)), least)
    placed = distinct.drop("sig").join(tied, "node", "left").select("node", "first", "root")
    named = placed.filter("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    classes = placed.join(named, "root", "left").select("node", F.coalesce("least", "first").alias("least"))
    return rows.drop("sig").join(classes, "node").select(
        "_k1", "_k2", F.col("id").alias("doc_id"), F.col("least.id").alias("component_id"),
        ((F.col("_k1") == F.col("least._k1")) & (F.col("_k2") == F.col("least._k2"))).alias("stays"))


def without_near_copies(docs: DataFrame, width: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all columns. Rows equal in id and text are one document, of which one row stays."""
    gone = near_copies(docs, width, least, id_col, text_col).filter("not stays").select("_k1", "_k2").distinct()
    own, of = numbered(docs)
    keyed = own.select("*", *row_key([of[id_col], of[text_col]]))
    return keyed.join(gone, ["_k1", "_k2"], "left_anti").dropDuplicates(["_k1", "_k2"]).drop("_k1", "_k2").toDF(*of)
