"""Periodic runs of words by online dyadic square catching.

A ``Catcher`` reads words as they are appended. For each power of two L it keeps a catcher over every completed block of L
words that begins at a multiple of L. A square whose half has p words, 2L - 1 <= p <= 4L - 2, holds such a block in its first
half, and the same words p places later; so each block waits for its own L words to come again within that distance, which
fingerprints of the last L words tell. From then on the two suffixes are compared: backwards at once, forwards with every
word that is appended. As soon as the words that agree number p, a square is caught; further words that agree are further
squares of the same period, and all of them merge into one run, which ends with the first word that differs. A run that is
caught with several periods has the least of them.

The words of a call of ``append`` are taken together by numpy; how a text is cut into calls changes nothing. The work for n
words is O(n log n) and the comparisons of what was caught. A word is its 64-bit hash; every run is compared word by
word in the end. Memory is some 100 bytes a word of one text, and one text is read in pieces of 65,536 words.

Null text counts as empty (its text stays null); texts of fewer words than ``least`` have no runs. Rows that repeat get the
same result. Columns of the results replace columns of the same name, others pass through. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark.llm.common import numbered
from regspark.llm.encoding import text_cuts
from regspark.llm.words import Words, powers

_BASE_ROOM = 1 << 16


class Catcher:
    """Runs (start, stop, period) with stop - start >= 2 * period of a sequence of 64-bit words that grows at its end. ``longest``: periods above it are not wanted."""

    def __init__(self, longest: int | None = None):
        self.n, self.longest = 0, longest
        self.words, self.sums = np.zeros(_BASE_ROOM, np.uint64), np.zeros(_BASE_ROOM + 1, np.uint64)
        self.live = np.zeros((0, 2), np.int64)  # start, period of what agrees up to the last word
        self.done: list[np.ndarray] = []

    def _hash(self, start: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * powers(self.n + 1)[1][start]

    def _ahead(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """How many words from ``at`` on equal the words a period before."""
        have, step = np.zeros(len(at), np.int64), 1
        power = powers(self.n + 1)[1]
        same = lambda have, size, i: (self.sums[at[i] + have[i] + size] - self.sums[at[i] + have[i]]) * power[at[i] + have[i]] == (self.sums[at[i] - period[i] + have[i] + size] - self.sums[at[i] - period[i] + have[i]]) * power[at[i] - period[i] + have[i]]
        open_ = np.arange(len(at))
        while len(open_):  # doubling, then halving
            fits = open_[at[open_] + have[open_] + step <= self.n]
            open_ = fits[same(have, step, fits)]
            have[open_] += step
            step *= 2
        while step > 1:
            step //= 2
            fits = np.flatnonzero(at + have + step <= self.n)
            ok = fits[same(have, step, fits)]
            have[ok] += step
        return have

    def _back(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """How many words before ``at - period`` equal the words before ``at``."""
        have, step = np.zeros(len(at), np.int64), 1
        power = powers(self.n + 1)[1]

        def same(size: int, i: np.ndarray) -> np.ndarray:
            right = at[i] - have[i] - size
            left = right - period[i]
            return (self.sums[right + size] - self.sums[right]) * power[right] == (self.sums[left + size] - self.sums[left]) * power[left]

        open_ = np.arange(len(at))
        while len(open_):
            fits = open_[at[open_] - period[open_] - have[open_] - step >= 0]
            open_ = fits[same(step, fits)]
            have[open_] += step
            step *= 2
        while step > 1:
            step //= 2
            fits = np.flatnonzero(at - period - have - step >= 0)
            ok = fits[same(step, fits)]
            have[ok] += step
        return have

    def append(self, words: np.ndarray) -> None:
        """More words at the end."""
        if not len(words):
            return
        old, self.n = self.n, self.n + len(words)
        if self.n > len(self.words):
            room = max(self.n, 2 * len(self.words))
            self.words = np.concatenate([self.words[:old], np.zeros(room - old, np.uint64)])
            self.sums = np.concatenate([self.sums[:old + 1], np.zeros(room - old, np.uint64)])
        self.words[old:self.n] = words
        self.sums[old + 1:self.n + 1] = self.sums[old] + np.cumsum(words * powers(self.n)[0][old:self.n])
        found = [self.live]
        size, most = 1, self.n if self.longest is None else self.longest  # a square may end later
        while 2 * size - 1 <= most:
            at = np.arange(max(old - size + 1, 0), self.n - size + 1)  # where the last ``size`` words begin, with a new word at their end
            now = self._hash(at, size)
            for back in range(1, 4):
                block = (at // size - back) * size
                period = at - block
                i = np.flatnonzero((block >= 0) & (period >= 2 * size - 1) & (period <= min(4 * size - 2, most)))
                i = i[now[i] == self._hash(block[i], size)]
                if len(i):
                    start = block[i] - self._back(at[i], period[i])
                    found.append(np.stack([start, period[i]], axis=1))
            size *= 2
        if sum(map(len, found)):
            self._advance(np.unique(np.concatenate(found), axis=0))

    def _advance(self, pairs: np.ndarray) -> None:
        start, period = pairs[:, 0], pairs[:, 1]
        stop = start + period + self._ahead(start + period, period)
        self.live = pairs[stop == self.n]
        over = (stop < self.n) & (stop - start >= 2 * period)
        if over.any():
            self.done.append(np.stack([start[over], stop[over], period[over]], axis=1))

    def runs(self) -> np.ndarray:
        """All runs so far, by start and stop; those that reach the end may still grow."""
        live = np.stack([self.live[:, 0], np.full(len(self.live), self.n), self.live[:, 1]], axis=1)
        found = np.unique(np.concatenate([*self.done, live[live[:, 1] - live[:, 0] >= 2 * live[:, 2]]]), axis=0)
        first = np.concatenate([[True], (np.diff(found[:, :2], axis=0) != 0).any(axis=1)]) if len(found) else np.zeros(0, bool)
        found = found[first]  # sorted, so the least period of each stretch
        exact = [(self.words[s:e - p] == self.words[s + p:e]).all() for s, e, p in found]
        return found[np.array(exact, bool)]


def runs_of(words: np.ndarray, first: np.ndarray, least: int = 12, piece: int = 1 << 16) -> list[np.ndarray]:
    """Runs (start, length, period) of ``least`` words or more of each text, by start and period; ``first``: where each text begins, and the end.

    The texts go to one catcher, with a word between them that occurs nowhere else.
    """
    sizes = np.diff(first)
    n = len(sizes)
    at = first[:-1] + np.arange(n)  # places in the sequence with the words between
    line = np.empty(len(words) + n, np.uint64)
    between = first[1:] + np.arange(n)
    held = np.ones(len(line), bool)
    held[between] = False
    line[held] = words[first[0]:first[-1]]
    line[between] = np.random.default_rng(len(line)).integers(0, 1 << 63, n, np.uint64)
    catcher = Catcher(int(sizes.max(initial=0)) // 2)
    for i in range(0, len(line), piece):
        catcher.append(line[i:i + piece])
    found = catcher.runs()
    found = found[found[:, 1] - found[:, 0] >= least]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    text = np.searchsorted(at, found[:, 0], "right") - 1
    own = np.stack([found[:, 0] - at[text], found[:, 1] - found[:, 0], found[:, 2]], axis=1)
    return np.split(own, np.searchsorted(text, np.arange(1, n)))


def later_periods(runs: np.ndarray, n_words: int) -> np.ndarray:
    """Which words some run holds after its first period."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def periodic_runs(docs: DataFrame, least: int = 12, text_col: str = "text") -> DataFrame:
    """All rows with ``n_words``, ``runs`` (start, length, period, by start and period), and as ``collapsed`` the text with one period of
    each run: its kept words joined by one space."""
    own, of = numbered(docs.drop("n_words", "runs", "collapsed"))
    names, at = own.columns, own.columns.index(of[text_col])
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, j in text_cuts(whole.column(at), 1 << 20):
                b = whole.slice(i, j - i)
                w = Words(b.column(at))
                sizes = np.diff(w.first)
                found = runs_of(w.hash, w.first, least)
                collapsed = []
                for text, n, r in zip(b.column(at).cast(pa.binary()), sizes, found):
                    t = text.as_py()
                    if t is not None:
                        kept = t.split()
                        t = b" ".join(compress(kept, ~later_periods(r, int(n))) if len(r) else kept).decode()
                    collapsed.append(t)
                ends = np.cumsum([0, *map(len, found)])
                flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
                runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, pa.int64()), runs.cast(run_type), pa.array(collapsed, pa.string())], [*names, "n_words", "runs", "collapsed"])

    triple = T.StructType([T.StructField(k, T.LongType()) for k in ("start", "length", "period")])
    schema = T.StructType([*own.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(triple)), T.StructField("collapsed", T.StringType())])
    return own.mapInArrow(run, schema).toDF(*of, "n_words", "runs", "collapsed")


def with_planted_period(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every tenth text by the crc32 of its id made periodic from some word on: with g = crc32 // 10, n words, a = g % n and
    p = 1 + (n - a) // (3 + g % 8), word i >= a becomes word a + (i - a) % p, the words joined by one space. Null ids and texts without
    words stay as they are."""
    crc = F.crc32(F.col(id_col).cast("string"))
    words = rf"filter(split(`{text_col}`, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
    planted = F.expr(f"""element_at(transform(array({words}), ws -> element_at(transform(array(named_struct(
        'n', size(ws), 'g', crc32(cast(`{id_col}` as string)) div 10)), v -> element_at(transform(array(cast(v.g % v.n as int)), a ->
        element_at(transform(array(cast(1 + (v.n - a) div (3 + v.g % 8) as int)), p ->
        array_join(transform(ws, (w, i) -> if(i < a, w, ws[a + (i - a) % p])), ' ')), 1)), 1)), 1)), 1)""")
    affected = (crc % 10 == 0) & F.col(text_col).rlike(r"[^\x20\x09-\x0D]")
    return docs.withColumn(text_col, F.when(affected, planted).otherwise(F.col(text_col)))
