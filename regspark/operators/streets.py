"""Matching of addresses and street names by shared words, as an exact set-similarity join in tiles.

Frequent words pair a share of all sets with a share of all sets, so the result itself grows with the square of the input, and a pair must
cost little. Both sides are dealt into tiles of bounded size, and a task pairs one tile of each: for a set on one side it adds up the rows of
its words in the other tile, a flag for each of its sets if the word is frequent there, else the list of those that hold it. A task holds one
tile of ``b`` and streams ``a`` past it, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.functions import text as C
from regspark.session import cut_lineage

TILE = 1 << 16  # sets of a tile
DENSE = 16  # a word that more than one in so many sets of a tile hold is kept as flags
FLAGS = 64 << 20  # bytes of flags that a tile has at most; further words are lists
ROWS = 1 << 18  # rows of an output batch, and one set's pairs at most more


def tokens(address: Column | str) -> Column:
    """The words that C17 compares: of the cleaned address, each once."""
    return F.array_distinct(F.filter(F.split(C.comparable_address(address), " "), lambda w: w != ""))


def _sets(rows: DataFrame, least: int) -> DataFrame:
    """``id, tokens``: one row an id with its different tokens, where these are enough."""
    own = F.array_distinct(F.flatten(F.collect_list(F.array_compact("tokens"))))
    return cut_lineage(rows.groupBy("id").agg(own.alias("tokens")).filter(F.size("tokens") >= max(least, 1)))


class _Tile:
    """The sets of one side, by token."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        held = table.column("tokens").combine_chunks()
        sizes = pc.list_value_length(held).to_numpy(zero_copy_only=False)
        self.ids, self.n = table.column("id_b").combine_chunks(), len(held)
        self.type = np.uint8 if sizes.max() < 256 else np.int32
        coded = held.flatten().dictionary_encode()
        self.names, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        often = np.bincount(codes, minlength=len(self.names))
        self.lists = np.split(np.repeat(np.arange(self.n, dtype=np.int32), sizes)[order], np.cumsum(often)[:-1])
        self.flags = {}
        for code in np.argsort(-often, kind="stable")[:max(FLAGS // (self.n * np.dtype(self.type).itemsize), 1)].tolist():
            if often[code] * DENSE > self.n:
                self.flags[code] = np.zeros(self.n, self.type)
                self.flags[code][self.lists[code]] = 1

    def shared(self, codes: list[int], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Which sets hold ``least`` of these tokens, and how many they hold."""
        dense = [self.flags[c] for c in codes if c in self.flags]
        few = [self.lists[c] for c in codes if c not in self.flags]
        if not dense and sum(map(len, few)) * DENSE < self.n:
            at = np.sort(np.concatenate(few)) if few else np.empty(0, np.int32)
            ends = np.append(np.flatnonzero(np.diff(at)), len(at) - 1) if len(at) else np.empty(0, np.int64)
            common, at = np.diff(ends, prepend=-1), at[ends]
            return at[common >= least], common[common >= least].astype(np.int32)
        counts = dense[0].copy() if dense else np.zeros(self.n, self.type)
        for flags in dense[1:]:
            counts += flags
        for at in few:
            counts[at] += 1
        at = np.flatnonzero(counts >= least)
        return at, counts[at].astype(np.int32)


def _pairs(least: int):
    """Rows of a partition, those of side 0 first: each set of side 1 with all of side 0 that share enough of its tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tile = [], None
        for b in batches:
            own = int(pc.sum(pc.equal(b.column("side"), 0)).as_py() or 0)
            if own:
                held.append(b.slice(0, own))
            rest = b.slice(own)
            if not rest.num_rows or not held:
                continue
            tile = tile or _Tile(held)
            sets = rest.column("tokens")
            codes = pc.fill_null(pc.index_in(sets.flatten(), value_set=tile.names), -1).to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.list_value_length(sets).to_numpy(zero_copy_only=False))
            found, size = [], 0
            for row, end in enumerate(ends.tolist()):
                known = codes[ends[row - 1] if row else 0:end]
                known = known[known >= 0].tolist()
                at, common = tile.shared(known, least) if len(known) >= least else ((), ())
                if len(at):
                    found.append((row, at, common))
                    size += len(at)
                if found and (size >= ROWS or row + 1 == len(ends)):
                    rows = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
                    yield pa.RecordBatch.from_arrays([rest.column("id_a").take(pa.array(rows)), tile.ids.take(pa.array(np.concatenate([f[1] for f in found]))),
                                                      pa.array(np.concatenate([f[2] for f in found]))], ["id_a", "id_b", "common"])
                    found, size = [], 0

    return run


def sharing(a: DataFrame, b: DataFrame, least: int = 2) -> DataFrame:
    """``id_a, id_b, common`` (number of shared tokens) of all pairs that share ``least`` tokens. ``a``, ``b``: id (unique), tokens. Null and empty
    token arrays have no pair; rows of one id count as one set."""
    least = max(least, 1)
    a, b = _sets(a, least), _sets(b, least)
    cores = a.sparkSession.sparkContext.defaultParallelism
    rows, tiles = a.count(), max(-(-b.count() // TILE), 1)
    parts = max(-(-rows // TILE), min(2 * cores, -(-rows // 1024)), 1)
    # a set of a meets every tile of b in its own part, and a tile of b is there once for every part of a
    left = a.select(F.lit(1).alias("side"), F.col("id").alias("id_a"), F.lit(None).cast(b.schema["id"].dataType).alias("id_b"), "tokens",
                    F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1))).alias("tile"))
    right = b.select(F.lit(0).alias("side"), F.lit(None).cast(a.schema["id"].dataType).alias("id_a"), F.col("id").alias("id_b"), "tokens",
                     F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64("id"), F.lit(tiles)).alias("tile"))
    dealt = left.unionByName(right).repartitionById(parts * tiles, (F.col("tile") * parts + F.col("part")).cast("int")).drop("part", "tile").sortWithinPartitions("side")
    types = [d.schema["id"].dataType.simpleString() for d in (a, b)]
    return dealt.mapInArrow(_pairs(least), f"id_a {types[0]}, id_b {types[1]}, common int")


def same_streets(addresses: DataFrame, streets: DataFrame) -> DataFrame:
    """For each address the streets that are not different from it, most shared words first (``rank``; ties: smaller id).

    ``addresses``, ``streets``: id, name. An address that shares fewer than two words with every street has no row.
    """
    from regspark.operators.ordered import top_per_key

    pairs = sharing(addresses.select("id", tokens("name").alias("tokens")), streets.select("id", tokens("name").alias("tokens")))
    return top_per_key(pairs, ["id_a"], [F.desc("common"), F.asc("id_b")], 1 << 30)
