"""Benchmark decontamination by greedy string tiling.

Texts are cut into tokens: runs of ASCII letters and digits or of other than ASCII characters, in lower case. The seeds are
runs of ``width`` tokens that a document shares with a test item. A rolling hash of every run of a document is looked up in
a bit table of fixed size that holds the runs of the tests; what passes is joined with the tests' runs by its tokens, which
are exact. For each pair that has a seed, matches are grown from equal seeds on (running Karp-Rabin: a match goes on as long
as the next seeds agree), the longest are marked first where no token of theirs is marked yet, and again until none of
``width`` tokens is left. The share of a test's tokens under tiles is its coverage; the tiles may stand in any order and
place, so a reordered passage counts as much as a whole one.

Items with fewer than ``width`` tokens have one seed: all their tokens. An item without tokens matches nothing, one without
id is compared like any other. Null and empty texts match nothing. Rows of documents equal in id and text are one document: all get its result; items that share
an id are all compared, the highest coverage counts. Extra columns are not looked at. Empty tables give no match.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regspark.llm.common import cut_lineage, numbered, row_key
from regspark.llm.quality import pieces

TOKEN = np.zeros(256, bool)
TOKEN[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_RANDOM = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each token of a slice of lower-case texts, and which token begins each text (one more than texts)."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = TOKEN[data]
    turn = np.flatnonzero(solid[1:] != solid[:-1])
    start, stop = turn[::2], turn[1::2]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    inner = np.unique(inner[TOKEN[data[inner]] & TOKEN[data[inner - 1]]]) if len(inner) else inner
    if len(inner):  # a text's end is a token's end
        start, stop = np.sort(np.append(start, inner)), np.sort(np.append(stop, inner))
    return start, stop, np.searchsorted(start, offsets)


def rolling(data: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` tokens; token hashes are sums over their bytes, which is enough to look up."""
    if len(start) < width:
        return np.zeros(0, np.uint64)
    own = np.add.reduceat(np.where(TOKEN[data], _RANDOM[data], np.uint64(0)), start) * _MIX
    own ^= own >> np.uint64(29)
    h = np.zeros(len(own) - width + 1, np.uint64)
    for i in range(width):
        h = h * _BASE + own[i:len(own) - width + 1 + i]
    return h * _MIX


def _runs(texts: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]]:
    """By text: row, tokens, places and hashes of its runs, its slice's bytes, starts and ends of the slice's tokens."""
    for first, data, offsets in pieces(pc.utf8_lower(texts)):
        start, stop, of = tokens(data, offsets)
        h, raw = rolling(data, start, width), data.tobytes()
        for i in range(len(offsets) - 1):
            n = int(of[i + 1] - of[i])
            yield first + i, n, np.arange(of[i], of[i] + max(n - width + 1, 0)), h[of[i]:of[i] + max(n - width + 1, 0)], raw, start, stop


def _run_text(raw: bytes, start: np.ndarray, stop: np.ndarray, at: int, width: int) -> str:
    return " ".join(raw[start[k]:stop[k]].decode("utf-8", "replace") for k in range(at, at + width))


def test_seeds(tests: DataFrame, width: int, bits: int, id_col: str, text_col: str) -> DataFrame:
    """``item, copy, n_tokens, place, size, gram, slot``: the seeds of every test item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("item", "copy", "n_tokens", "place", "size", "gram", "slot")}
            texts = pc.fill_null(b.column(2), "")
            sizes = {width}
            for row, n, *_ in _runs(texts, 1):
                sizes |= {n} if 0 < n < width else set()
            for size in sizes:
                for row, n, at, h, raw, start, stop in _runs(texts, size):
                    if n >= width if size == width else n == size:
                        for place, (k, x) in enumerate(zip(at, h)):
                            for name, v in zip(out, (b.column(0)[row].as_py(), b.column(1)[row].as_py(), n, place, size, _run_text(raw, start, stop, k, size), int(x >> np.uint64(64 - bits)))):
                                out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("item", pa.int64()), ("copy", pa.int64()), ("n_tokens", pa.int32()), ("place", pa.int32()), ("size", pa.int32()), ("gram", pa.string()), ("slot", pa.int64())]))

    thin = tests.select(F.col(id_col).cast("long").alias("item"), row_key([id_col, text_col])[0].alias("copy"), F.col(text_col).alias("text"))
    return cut_lineage(thin.mapInArrow(run, "item long, copy long, n_tokens int, place int, size int, gram string, slot long").distinct())


def _bit_table(seeds: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, whatever the number of tests: at most 2**(bits - 6) rows come to the driver."""
    rows = seeds.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("v")).toArrow()
    table = np.zeros(1 << bits - 6, np.uint64)
    table[np.asarray(rows["at"])] = np.asarray(rows["v"]).view(np.uint64)
    return table


def tile(hits: list[tuple[int, int]], item: list[int], size: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in document, place in item, tokens) of each tile.

    ``hits``: place in the document and seed name; ``item``: seed name at each place of the item. Equal seeds have equal
    names; a seed is ``size`` tokens.
    """
    where = defaultdict(list)
    for i, name in enumerate(item):
        where[name].append(i)
    hits = sorted(hits)
    used_doc: set[int] = set()
    used_item = np.zeros(len(item) + size, bool)
    tiles = []
    while True:
        best, found, before, last = 0, [], {}, None
        for d, name in reversed(hits):
            now = {}
            if not any(x in used_doc for x in range(d, d + size)):
                for i in where[name]:
                    if not used_item[i:i + size].any():
                        now[i] = before.get(i + 1, 0) + 1 if last == d + 1 else 1
                        if now[i] >= best:
                            if now[i] > best:
                                best, found = now[i], []
                            found.append((d, i))
            before, last = now, d
        if not best:
            return tiles
        length = best + size - 1
        for d, i in sorted(found):
            if not used_item[i:i + length].any() and not any(x in used_doc for x in range(d, d + length)):
                used_item[i:i + length] = True
                used_doc.update(range(d, d + length))
                tiles.append((d, i, length))


def scanned(docs: DataFrame, seeds: DataFrame, width: int, bits: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each document: ``_k1, _k2, id, hits``, the hits being the places and tokens of runs that the bit table has."""
    table = _bit_table(seeds, bits)
    sizes = sorted({width} | {r[0] for r in seeds.select("size").distinct().collect()})  # at most ``width`` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column(3), "")
            hits: list[list] = [[] for _ in range(len(texts))]
            for size in sizes:
                for row, _, at, h, raw, start, stop in _runs(texts, size):
                    slot = h >> np.uint64(64 - bits)
                    for k in np.flatnonzero(table[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)):
                        hits[row].append({"place": int(k), "gram": _run_text(raw, start, stop, at[k], size)})
            kind = pa.list_(pa.struct([("place", pa.int32()), ("gram", pa.string())]))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(hits, kind)], ["_k1", "_k2", "id", "hits"])

    thin = docs.select(*row_key([id_col, text_col]), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return cut_lineage(thin.mapInArrow(run, "_k1 long, _k2 long, id long, hits array<struct<place:int,gram:string>>"))


def overlaps(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """``_k1, _k2, item, copy, n_tokens, covered, tiles`` of each pair of document and item that has a seed. ``rows``: of ``scanned``."""
    pairs_schema = "_k1 long, _k2 long, item long, copy long, n_tokens int, covered int, tiles array<struct<doc:int,item:int,tokens:int>>"
    kind = pa.list_(pa.struct([("doc", pa.int32()), ("item", pa.int32()), ("tokens", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits, names, size = b.column(5).to_pylist(), b.column(6).to_pylist(), b.column(7).to_pylist()
            tiles = [tile([(x["place"], x["name"]) for x in h], n, s) for h, n, s in zip(hits, names, size)]
            out = [*b.columns[:5], pa.array([sum(x[2] for x in t) for t in tiles], pa.int32()), pa.array([[dict(zip(("doc", "item", "tokens"), x)) for x in t] for t in tiles], kind)]
            yield pa.RecordBatch.from_arrays(out, ["_k1", "_k2", "item", "copy", "n_tokens", "covered", "tiles"])

    # an item is named by its key, as its id may be null
    named = seeds.groupBy("item", "copy", "n_tokens", "size", "gram").agg(F.min("place").alias("name"))
    spelled = (seeds.join(named.select("copy", "gram", "name"), ["copy", "gram"]).groupBy("copy", "n_tokens", "size")
               .agg(F.sort_array(F.collect_list(F.struct("place", "name"))).alias("p")).select("copy", "n_tokens", "size", F.col("p.name").alias("names")))
    met = (rows.filter("size(hits) > 0").select("_k1", "_k2", F.explode("hits").alias("h")).select("_k1", "_k2", "h.place", "h.gram")
           .join(named, "gram").groupBy("_k1", "_k2", "item", "copy").agg(F.collect_set(F.struct("place", "name")).alias("hits")))
    return (met.join(spelled, "copy").select("_k1", "_k2", "item", "copy", "n_tokens", "hits", "names", "size").mapInArrow(run, pairs_schema))


def contamination(docs: DataFrame, tests: DataFrame, width: int = 5, threshold: float = 0.5, bits: int = 22, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``_k1, _k2, doc_id, item_id, coverage, n_items, contaminated`` for every row: the item with the highest coverage (the smallest
    id among equals) and how many items reach the threshold. Without any seed coverage is 0 and the item null."""
    seeds = test_seeds(tests, width, bits, item_col, item_text)
    rows = scanned(docs, seeds, width, bits, id_col, text_col)
    share = overlaps(rows, seeds).withColumn("share", F.col("covered") / F.col("n_tokens"))
    by_item = share.groupBy("_k1", "_k2", "item").agg(F.max("share").alias("share"))
    best = by_item.groupBy("_k1", "_k2").agg(F.max(F.struct("share", (-F.col("item")).alias("i"))).alias("best"), F.sum((F.col("share") >= threshold).cast("long")).alias("n"))
    return (rows.drop("hits").join(best, ["_k1", "_k2"], "left")
            .select("_k1", "_k2", F.col("id").alias("doc_id"), (-F.col("best.i")).alias("item_id"), F.coalesce("best.share", F.lit(0.0)).alias("coverage"),
                    F.coalesce("n", F.lit(0)).alias("n_items"), (F.coalesce("n", F.lit(0)) > 0).alias("contaminated")))


def decontaminated(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows that no test item is found in."""
    bad = contamination(docs, tests, id_col=id_col, text_col=text_col, **how).filter("contaminated").select("_k1", "_k2").distinct()
    own, of = numbered(docs)
    return own.select("*", *row_key([of[id_col], of[text_col]])).join(bad, ["_k1", "_k2"], "left_anti").drop("_k1", "_k2").toDF(*of)
