"""Quality rules: text statistics, and a logistic regression on hashed word and character n-grams.

Word 1- and 2-grams and character (byte) 3- and 4-grams are hashed into two tables of weights; a text's score is the mean
weight of its word n-grams plus the mean weight of its character n-grams plus a constant. The model is fitted on labelled
rows, its probability is calibrated on labelled rows held out from the fit (Platt scaling), and a document goes if the
calibrated probability of good quality is below a fixed threshold, or if a base rule fails. The fit takes the
``sample`` labelled rows with the smallest hash of their id; scoring takes whole texts of all rows in Arrow batches.

Null text counts as a text without words; it fails the base rules. Rows that repeat get the same result. Labels that are
null, or whose document is missing, are left out of the fit; with no labels of both kinds the base rules alone decide and
``p_good`` is null. Columns of the results replace columns of the same name; others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark.llm.encoding import cuts

BITS = 14
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * _ODD) >> np.uint64(64 - BITS)).astype(np.int32)


def pieces(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a batch of 1 MB (a longer text is a slice alone), as n-grams take some 100 bytes a byte of text: first row, bytes, offsets of the slice's texts."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


@dataclass
class Grams:
    """Bucket of each n-gram of a slice and, for each text, from where to where its n-grams stand."""

    words: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    chars: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def grams(data: np.ndarray, offsets: np.ndarray) -> Grams:
    n = len(data)
    start, stop = offsets[:-1], offsets[1:]
    chars = []
    wide = data.astype(np.uint64)
    for k in (3, 4):
        m = max(n - k + 1, 0)
        h = np.full(m, k, np.uint64)
        for i in range(k):
            h = (h << np.uint64(8)) | wide[i:m + i]
        chars.append((_bucket(h), np.minimum(start, m), np.minimum(np.maximum(stop - k + 1, start), m)))
    solid = ~SPACE[data]
    head = solid.copy()
    head[1:] &= ~solid[:-1]
    inner = start[(start > 0) & (start < n)]
    head[inner] = solid[inner]  # a text's first byte begins a word of its own
    at = np.flatnonzero(head)
    ones = np.cumsum(head) - 1
    place = (np.arange(n) - at[np.maximum(ones, 0)] if len(at) else np.zeros(n, np.int64))
    power = np.cumprod(np.full(min(int(place.max(initial=0)) + 1, 1 << 12), 0x100000001B3, np.uint64))
    terms = np.where(solid, (wide + np.uint64(1)) * power[place % len(power)], np.uint64(0))
    word = np.add.reduceat(terms, at) if len(at) else np.zeros(0, np.uint64)
    w_start, w_stop = np.searchsorted(at, start), np.searchsorted(at, stop)
    two = word[:-1] * np.uint64(31) + word[1:] * np.uint64(1_000_003) if len(word) > 1 else np.zeros(0, np.uint64)
    return Grams([(_bucket(word), w_start, w_stop), (_bucket(two), np.minimum(w_start, len(two)), np.minimum(np.maximum(w_stop - 1, w_start), len(two)))], chars)


@dataclass
class Model:
    """Weights of good quality by bucket; z = words + chars + bias, p = 1 / (1 + exp(-(scale * z + shift)))."""

    words: np.ndarray
    chars: np.ndarray
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def z(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        g, z = grams(data, offsets), np.full(len(offsets) - 1, self.bias)
        for table, kinds in ((self.words, g.words), (self.chars, g.chars)):
            total, number = np.zeros(len(z)), np.zeros(len(z))
            for bucket, start, stop in kinds:
                run = np.concatenate([[0.0], np.cumsum(table[bucket], dtype=np.float64)])
                total += run[stop] - run[start]
                number += stop - start
            z += total / np.maximum(number, 1)
        return z

    def p(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -500, 500)))


def shares(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For the fit: the buckets of each text (those of characters after those of words) and their shares of its n-grams."""
    g, out = grams(data, offsets), []
    for i in range(len(offsets) - 1):
        idx, val = [], []
        for base, kinds in ((0, g.words), (1 << BITS, g.chars)):
            own = np.concatenate([bucket[start[i]:stop[i]] for bucket, start, stop in kinds])
            b, c = np.unique(own, return_counts=True)
            idx.append(b + base)
            val.append(c / max(len(own), 1))
        out.append((np.concatenate(idx).astype(np.int32), np.concatenate(val).astype(np.float32)))
    return out


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a calibrated probability, by Newton steps with the usual smoothed targets."""
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -500, 500)))
        w, d = p * (1 - p) + 1e-9, p - target
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, [(d * z).sum() + 1e-3 * (a - 1), d.sum()])
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, rounds: int = 60, decay: float = 1e-6, held_out: float = 0.25) -> Model | None:
    """Adam on the whole sample; every fourth row is held out for the calibration."""
    held = np.arange(len(rows)) % round(1 / held_out) == 0
    if min(good[~held].sum(), (~good[~held]).sum(), good[held].sum(), (~good[held]).sum()) == 0:
        return None
    size = np.array([len(i) for i, _ in rows])
    ends = np.cumsum(size)
    idx, val = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])
    steps = cuts(size, 1 << 17)  # rows at a time, so that a round holds little beside the sample
    y, train = good.astype(np.float64), (~held).astype(np.float64)
    balance = train * np.where(good, 0.5 / (train * y).sum(), 0.5 / (train * (1 - y)).sum())
    w, bias = np.zeros(2 << BITS), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0

    def places(i: int, j: int) -> tuple[slice, np.ndarray]:
        return slice(ends[i] - size[i], ends[j - 1]), np.repeat(np.arange(j - i), size[i:j])

    def scores() -> np.ndarray:
        z = np.full(len(rows), bias)
        for i, j in steps:
            at, of = places(i, j)
            z[i:j] += np.bincount(of, w[idx[at]] * val[at], j - i)
        return z

    for t in range(1, rounds + 1):
        d = balance * (1 / (1 + np.exp(-np.clip(scores(), -500, 500))) - y)
        g, gb = decay * w, d.sum()
        for i, j in steps:
            at, of = places(i, j)
            g += np.bincount(idx[at], d[i:j][of] * val[at], len(w))
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
        bias -= 0.05 * (mb / (1 - 0.9 ** t)) / (np.sqrt(vb / (1 - 0.99 ** t)) + 1e-9)
    model = Model(w[:1 << BITS].astype(np.float32), w[1 << BITS:].astype(np.float32), float(bias))
    z = scores()
    model.scale, model.shift = _platt(z[held], good[held])
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = 1500, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fits on at most ``sample`` labelled rows; their hashed n-grams, not their texts, come to the driver."""
    chosen = (labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).filter("_id is not null and _y is not null")
              .groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for _, data, offsets in pieces(b.column(1)) for r in shares(data, offsets)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([i for i, _ in rows], pa.list_(pa.int32())), pa.array([v for _, v in rows], pa.list_(pa.float32()))], ["y", "idx", "val"])

    known = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).filter("text is not null")
    one = known.join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    rows = one.select("_id", "_y", "x.text")  # one row an id, so at most ``sample`` rows
    got = rows.select("_y", "text").mapInArrow(run, "y int, idx array<int>, val array<float>").toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (got["idx"][i].values.slice(0, 8).to_pylist(), len(got["idx"][i])))
    return fit([(np.asarray(got["idx"][i].values), np.asarray(got["val"][i].values)) for i in order], np.asarray(got["y"])[order] > 0)


def statistics(text: bytes) -> tuple[int, int, int]:
    """n_words, n_dup_lines, n_repeat_words of one text."""
    words = text.split()
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    if len(words) < 4:
        return len(words), dup, 0
    ids = _Numbers()
    a = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    pair = a[:-1] * len(ids) + a[1:]
    if len(ids) > 1 << 20:  # three numbers would not fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, inverse, counts = np.unique(pair[:-1] * len(ids) + a[2:], return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k:len(words) - 2 + k] |= twice
    return len(words), dup, int(covered.sum())


class _Numbers(dict):
    """Numbers from 0 in order of first use."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


RESULT = {"n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(), "n_dup_lines": T.LongType(), "n_repeat_words": T.LongType(),
          "base_failed": T.BooleanType(), "p_good": T.DoubleType(), "kept": T.BooleanType()}


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, least_words: int = 50, most_repeat_percent: int = 50,
           id_col: str = "doc_id", text_col: str = "text", sample: int = 1500) -> DataFrame:
    """All rows with the statistics, ``base_failed``, ``p_good`` and ``kept``."""
    model = train(docs, labels, sample, id_col=id_col, text_col=text_col)
    docs = docs.drop(*RESULT)
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: dict[str, list[np.ndarray]] = {k: [] for k in RESULT}
            for _, data, offsets in pieces(b.column(at)):
                start, stop = offsets[:-1], offsets[1:]
                raw = data.tobytes()
                words, dup, repeat = np.array([statistics(raw[x:y]) for x, y in zip(start, stop)], np.int64).reshape(-1, 3).T
                count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
                failed = (words < least_words) | (100 * repeat > most_repeat_percent * words)
                p = model.p(model.z(data, offsets)) if model else np.full(len(start), np.nan)
                for k, v in zip(RESULT, (words, count((data & 0xC0 != 0x80) & ~SPACE[data]), count(SYMBOL[data]), dup, repeat, failed, p, ~failed & ~(p < threshold))):
                    cols[k].append(v)
            out = [pa.array(np.concatenate(v) if v else np.zeros(0, bool if k in ("base_failed", "kept") else float if k == "p_good" else np.int64), from_pandas=True) for k, v in cols.items()]
            yield pa.RecordBatch.from_arrays([*b.columns, *out], [*names, *RESULT])

    schema = T.StructType([*docs.schema.fields, *[T.StructField(k, t) for k, t in RESULT.items()]])
    return docs.mapInArrow(run, schema)
