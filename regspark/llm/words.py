"""Words of whole Arrow columns as numpy arrays: 64-bit hashes, places and documents, without a Python step a word.

A word's hash is a polynomial of its UTF-8 bytes, each first mapped to a random 64-bit number, modulo 2 ** 64, and mixed.
Sums over prefixes give every word's polynomial at once; they are taken over blocks of about a megabyte, cut between words,
so the memory is some 10 bytes a byte of text beside the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_RANDOM.integers(0, 1 << 62)) * 4 + 3
_BLOCK = 1 << 20


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for at least n exponents."""
    n = max(_BLOCK, 1 << int(n - 1).bit_length())
    return _powers(n, BASE), _powers(n, pow(BASE, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums that ``stretch_hashes`` takes its differences from."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0][:len(values)], out=out[1:])
    return out


def stretch_hashes(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """One polynomial of the values from start to stop (exclusive), not mixed."""
    return (sums[stop] - sums[start]) * powers(len(sums))[1][start]


class Words:
    """The words of some texts, one after the other: ``hash``, ``start`` and ``stop`` in the bytes ``data``, and ``first``: where each text's words begin
    (one entry more than texts). ``separators``: a mark for each byte that stands between words. With ``kinds``, a number for each byte, words
    are cut where two kinds meet, neither of which is 0; ``spaced`` tells which of the parts have a separator before them."""

    def __init__(self, texts: pa.Array, separators: np.ndarray = _SEPARATOR, kinds: np.ndarray | None = None, uncut_after: int = -1):
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        body = texts.buffers()[2]
        data = np.frombuffer(body, np.uint8)[offsets[0]:offsets[-1]] if body is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        inside = ~separators[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], inside[:-1]])[:len(data)]
        after = np.concatenate([inside[1:], [False]])[:len(data)]
        begins = edge[:-1].copy()
        if kinds is not None and len(data):
            kind = kinds[data]
            edge[1:-1] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & (data[:-1] != uncut_after)
        start = np.flatnonzero(inside & (~before | edge[:-1]))
        stop = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.data, self.start, self.stop = data, start, stop
        self.spaced = ~before[start] & ~begins[start]
        self.first = np.searchsorted(start, offsets)
        self.hash = np.zeros(len(start), np.uint64)
        i = 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(stop, start[i] + _BLOCK, "right")))
            base = start[i]
            sums = prefix_sums(_BYTE[data[base:stop[j - 1]]])
            self.hash[i:j] = mix(stretch_hashes(sums, start[i:j] - base, stop[i:j] - base))
            i = j

    def text_of(self) -> np.ndarray:
        """The place of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == width else np.minimum(x[:-(width - have)], x[width - have:])


def whole_groups(batches: Iterator[pa.RecordBatch], least: int = 1) -> Iterator[pa.Table]:
    """Tables of ``least`` rows or more, where the rows come sorted by the first column and none of its values is in two tables."""
    kept: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        kept.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(kept).combine_chunks()
        key = table.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield table.slice(0, cut)
            kept, rows = table.slice(cut).to_batches(), table.num_rows - cut
    if rows:
        yield pa.Table.from_batches(kept).combine_chunks()
