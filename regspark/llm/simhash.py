"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

A fingerprint is eight bytes, each with its position. Two fingerprints that differ in at most ``max_bits`` bits differ in
at most that many bytes, so they share at least ``8 - max_bits`` positional bytes: the guaranteed minimum. A list for each
single positional byte would hold 1/256 of all fingerprints, and tallying its pairs grows with their square. So the
count filter is in the index key: an entry is a set of ``8 - max_bits`` positions with their bytes, and a pair meets only
where its tally has reached the minimum. Pairs that meet are verified by their differing bits.

The index holds distinct fingerprints, so copies of a text meet nowhere. A list holds at most ``256 ** max_bits``
fingerprints, as all other bytes agree; it is linked inside without forming its pairs where it is long: each member looks
up the values that a flip of up to ``max_bits`` bits gives. A list gives a link from each linked member to one other,
never more links than members, which keeps every connection.

Null text counts as empty; a text without words has fingerprint zero and is linked like any other. Rows that repeat get
the same result. A row without id is linked like any other but gives no id: the component is the smallest id that is not
null, or null if there is none. Extra columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regspark.llm.common import cut_lineage, numbered, row_key
from regspark.llm.components import components


def fingerprint(text: bytes, width: int = 3, seed: int = 42, block: int = 1 << 15) -> int:
    """64-bit fingerprint of a UTF-8 text: ASCII lower case, words between ASCII white space, shingles with repeats."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < width:
        return h(b" ".join(words), seed)
    n = len(words) - width + 1
    counts = np.zeros(64, np.int64)
    for i in range(0, n, block):
        own = words[i:i + block + width - 1]
        hashes = np.fromiter((h(b" ".join(x), seed) for x in zip(*(own[k:] for k in range(width)))), "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_k1, _k2, id, fp`` (signed 64 bit) of every row; the first two name a row by id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column(3), "").cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fps.view(np.int64))], ["_k1", "_k2", "id", "fp"])

    thin = docs.select(*row_key([id_col, text_col]), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return thin.mapInArrow(run, "_k1 long, _k2 long, id long, fp long")


def _roots(values: np.ndarray, max_bits: int) -> np.ndarray:
    """For distinct fingerprints, the place of the first member that each is connected to within ``max_bits`` a step."""
    n = len(values)
    root = np.arange(n)
    free = int(np.bitwise_or.reduce(values ^ values[0]))
    bits = [np.uint64(1 << k) for k in range(64) if free >> k & 1]
    flips = sum(comb(len(bits), k) for k in range(1, max_bits + 1))
    steps = []
    if n <= 16 * flips:  # comparing all is less work than looking up all flips
        for i in range(0, n, max(1, (1 << 20) // n)):
            x, y = np.nonzero(np.bitwise_count(values[i:i + max(1, (1 << 20) // n), None] ^ values[None, :]) <= max_bits)
            steps.append((x + i, y))
    else:
        order = np.argsort(values)
        ranked = values[order]
        for k in range(1, max_bits + 1):
            for c in combinations(bits, k):
                other = values ^ np.bitwise_or.reduce(np.array(c))
                at = np.minimum(np.searchsorted(ranked, other), n - 1)
                hit = np.flatnonzero(ranked[at] == other)
                if len(hit):
                    steps.append((hit, order[at[hit]]))
    while True:
        before = root.copy()
        for i, j in steps:
            np.minimum.at(root, i, root[j])
        root = root[root]
        if (root == before).all():
            return root


def _index_sets(max_bits: int) -> list[int]:
    """Masks, as signed longs, of every choice of 8 - max_bits byte positions."""
    masks = []
    for out in combinations(range(8), max_bits):
        m = sum(0xFF << 8 * k for k in range(8) if k not in out)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """``a, b``: links that connect exactly what the pairs within ``max_bits`` connect. ``distinct``: column fp, no repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(sets: np.ndarray, keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            edge = np.flatnonzero(np.diff(sets) | (np.diff(keys) != 0)) + 1
            start = np.concatenate([[0], edge])
            size = np.diff(np.append(start, len(fps)))
            two = start[size == 2]
            pair = np.bitwise_count((fps[two] ^ fps[two + 1]).view(np.uint64)) <= max_bits
            a, b = [fps[two][pair]], [fps[two + 1][pair]]
            for s, n in zip(start[size > 2], size[size > 2]):
                own = fps[s:s + n]
                r = _roots(own.view(np.uint64), max_bits)
                tied = r != np.arange(n)
                a.append(own[tied])
                b.append(own[r[tied]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

        rest: list[np.ndarray] | None = None
        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1])) if len(cols[0]) else []
            cut = int(last[-1]) + 1 if len(last) else 0  # the last list may go on in the next batch
            if cut:
                yield linked(*(c[:cut] for c in cols))
            rest = [c[cut:] for c in cols]
        if rest is not None and len(rest[0]):
            yield linked(*rest)

    entries = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(_index_sets(max_bits))]))
    index = distinct.select(entries.alias("e"), "fp").select("e.s", "e.k", "fp")
    return index.repartition("s", "k").sortWithinPartitions("s", "k").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_k1, _k2, doc_id, fingerprint`` (16 hex digits)``, component_id, stays`` for every row; of the rows of a component that
    differ in id or text, the one with the smallest id stays."""
    rows = cut_lineage(fingerprints(docs, width, id_col, text_col))
    order = F.struct(F.col("id").isNull().alias("no"), "id", "_k1", "_k2")
    distinct = rows.groupBy("fp").agg(F.min(order).alias("first"))
    tied = components(links(distinct.select("fp"), max_bits))
    tied = tied.union(tied.select("root", "root").distinct())  # components names no root as a node
    placed = distinct.join(tied, distinct.fp == tied.node, "left").select("fp", "first", "root")
    named = placed.filter("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    classes = placed.join(named, "root", "left").select("fp", F.coalesce("least", "first").alias("least"))
    return rows.join(classes, "fp").select(
        "_k1", "_k2", F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least.id").alias("component_id"),
        ((F.col("_k1") == F.col("least._k1")) & (F.col("_k2") == F.col("least._k2"))).alias("stays"))


def without_near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all columns. Rows equal in id and text are one document, of which one row stays."""
    gone = near_duplicates(docs, width, max_bits, id_col, text_col).filter("not stays").select("_k1", "_k2").distinct()
    own, of = numbered(docs)
    keyed = own.select("*", *row_key([of[id_col], of[text_col]]))
    return keyed.join(gone, ["_k1", "_k2"], "left_anti").dropDuplicates(["_k1", "_k2"]).drop("_k1", "_k2").toDF(*of)
