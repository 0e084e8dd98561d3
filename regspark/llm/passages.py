"""Substring deduplication: repeated passages of words, located by Aho-Corasick automata over shards of the corpus.

A window is ``window`` consecutive words of one document. A word goes if it lies in a window whose words also start in a
document with a smaller id; windows are judged on the input.

1. *Anchors.* Each window is filed under its least five-word hash, so equal windows have equal anchors. An anchor that has
   windows in one document only can be in no repeated window. Anchors are shuffled as one row a file, not a document.
2. *Contexts.* Neighbouring windows with one anchor are a context of up to ``window + 8`` words, cut from every document with
   recurring anchors. Contexts that are equal in one file are one row, with the least and largest id of its documents.
3. *Automata.* Contexts meet by anchor, in shards of some 20,000. In a shard, windows of different documents with one
   hash are confirmed as phrases and compiled into an Aho-Corasick automaton over words; all contexts of the shard are
   streamed through it, which finds each phrase wherever it occurs, word by word, and so its smallest document.
4. *Cut.* Every file gets the first documents of its own contexts' windows; words under a window with a smaller one go.

An anchor with more than ``hot`` contexts is not kept together: its windows are filed one by one under their own hash, where
a row a file meets. So no shard grows with a passage that very many documents share, and no copies are paired.

Texts are never shuffled. Every pass reads the documents anew and finds what was sent to it by the name of the input file,
which stays the same when a lost executor's work is done again. ``from_files``: the documents are read straight from files that
do not change; otherwise they are written to the shared folder once. What concerns one file is held by a task that reads it
(some 60 bytes for a context that repeats), so files of some GB should be split before.

Null text has no words and stays null. A row without id keeps its words and counts as no document. Rows that share an id
are one document in that none is earlier than another. Columns of the results replace columns of the same name, others pass
through. An empty table gives an empty result. A word is compared by 40 bits of its hash and its place in the window, files and
contexts by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark.llm.common import new_folder, numbered
from regspark.llm.encoding import gather, text_cuts
from regspark.llm.words import Words, mix, prefix_sums, sliding_min, stretch_hashes, whole_groups

GRAM = 5
_BYTES = 5  # of a word's hash in a context
_NONE = np.iinfo(np.int64).max
_BUFFER = 1 << 20


class Contexts:
    """Contexts of the texts of a slice: ``start`` (word), ``windows``, ``anchor``, ``text`` (place)."""

    def __init__(self, texts: pa.Array, usable: np.ndarray, window: int):
        self.words, self.window = Words(texts), window
        h, text = self.words.hash, self.words.text_of()
        self.sums = prefix_sums(h)
        n = len(h) - window + 1
        if n <= 0:
            self.start = self.windows = self.text = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
            return
        grams = len(h) - GRAM + 1
        gram = mix(stretch_hashes(self.sums, np.arange(grams), np.arange(grams) + GRAM))
        least = sliding_min(gram, window - GRAM + 1)
        valid = (text[:n] == text[window - 1:]) & usable[text[:n]]
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
        s = np.flatnonzero(valid)
        run = np.cumsum(new)[s] - 1
        begin = np.flatnonzero(new)
        place = s - begin[run]
        cut = place % (window - GRAM + 1) == 0  # a run of one anchor is longer only in periodic text
        self.start = s[cut]
        self.windows = np.diff(np.append(np.flatnonzero(cut), len(s)))
        self.anchor, self.text = least[self.start], text[self.start]

    def split(self, which: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """start, windows, key and name of the chosen contexts; of those in ``single`` every window is a context by its own name."""
        whole, apart = which & ~single, which & single
        each = self.windows[apart]
        ends = np.cumsum(each)
        alone = np.repeat(self.start[apart] - (ends - each), each) + np.arange(int(each.sum()))
        start = np.concatenate([self.start[whole], alone])
        windows = np.concatenate([self.windows[whole], np.ones(len(alone), np.int64)])
        name = mix(stretch_hashes(self.sums, start, start + windows + self.window - 1) + windows.astype(np.uint64))
        key = np.concatenate([self.anchor[whole], name[int(whole.sum()):]])
        return start, windows, key, name


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.xxhash64(F.input_file_name()).alias("file"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def _slices(batches: Iterator[pa.RecordBatch], text_at: int, window: int, id_at: int) -> Iterator[tuple[pa.RecordBatch, Contexts]]:
    for whole in batches:
        for i, j in text_cuts(whole.column(text_at), 1 << 20):
            b = whole.slice(i, j - i)
            yield b, Contexts(b.column(text_at), np.asarray(b.column(id_at).is_valid()), window)


def _combined(cols: list[np.ndarray], lo: np.ndarray, hi: np.ndarray, counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows equal in ``cols`` as one: these columns, least lo, largest hi and the sum of counts; and the first row of each."""
    order = np.lexsort(cols[::-1])
    differs = np.zeros(len(order), bool)
    differs[:1] = True
    for c in cols:
        v = c[order]
        differs[1:] |= v[1:] != v[:-1]
    at = np.flatnonzero(differs)
    out = [c[order[at]] for c in cols] + [np.minimum.reduceat(lo[order], at), np.maximum.reduceat(hi[order], at)] if len(at) else [c[:0] for c in (*cols, lo, hi)]
    if counts is not None:
        out.append(np.add.reduceat(counts[order], at) if len(at) else counts[:0])
    return out, order[at]


def _anchors(thin: DataFrame, window: int) -> DataFrame:
    """``anchor, file, lo, hi, n``: ids and contexts of each anchor in a file; some rows may share anchor and file."""
    names = ["anchor", "file", "lo", "hi", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            anchor, file, lo, hi, n = (np.concatenate(x) for x in zip(*parts))
            cols, _ = _combined([anchor, file], lo, hi, n)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

        held, rows = [], 0
        for b, c in _slices(batches, 2, window, 1):
            ids = np.asarray(b.column(1).fill_null(0))[c.text]
            cols, _ = _combined([c.anchor.view(np.int64), np.asarray(b.column(0))[c.text]], ids, ids, np.ones(len(ids), np.int64))
            held.append(cols)
            rows += len(cols[0])
            if rows >= _BUFFER:
                yield out(held)
                held, rows = [], 0
        if held:
            yield out(held)

    return thin.mapInArrow(run, "anchor long, file long, lo long, hi long, n long")


def _recurring(anchors: DataFrame, hot: int) -> DataFrame:
    """``file, anchor, hot`` of the anchors that windows of different ids have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            anchor, file, lo, hi, n = (c.to_numpy() for c in t.columns)
            at = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            size = np.diff(np.append(at, len(anchor)))
            recurs = np.repeat(np.minimum.reduceat(lo, at) < np.maximum.reduceat(hi, at), size)
            many = np.repeat(np.add.reduceat(n, at) > hot, size)
            yield pa.RecordBatch.from_arrays([pa.array(x[recurs]) for x in (file, anchor, many)], ["file", "anchor", "hot"])

    return anchors.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "file long, anchor long, hot boolean")


def _by_file(rows: DataFrame, folder: str, order: str) -> None:
    """One folder of Parquet a file of the input, in which tasks look up what concerns the file they read."""
    rows.repartition("file").sortWithinPartitions("file", order).write.partitionBy("file").parquet(folder)


class _Sent:
    """The rows of ``folder`` for one input file after the other."""

    def __init__(self, folder: str):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.known: dict[int, pa.Table | None] = {}

    def table(self, file: int) -> pa.Table | None:
        if file not in self.known:
            path = f"{self.root}/file={file}"
            found = self.fs.get_file_info(path).type == pafs.FileType.Directory
            parts = [f.path for f in self.fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".parquet")] if found else []
            tables = [pq.read_table(self.fs.open_input_file(p)) for p in sorted(parts)]
            if len(self.known) > 2:
                self.known.clear()
            self.known[file] = pa.concat_tables(tables).combine_chunks() if tables else None
        return self.known[file]


class _Anchors(_Sent):
    """Sorted recurring anchors of a file, and which are hot."""

    def look_up(self, file: int, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = self.table(file)
        if t is None or not t.num_rows:
            return np.zeros(len(anchor), bool), np.zeros(len(anchor), bool)
        known, hot = t.column("anchor").to_numpy(), np.asarray(t.column("hot"))
        at = np.minimum(np.searchsorted(known, anchor.view(np.int64)), len(known) - 1)
        there = known[at] == anchor.view(np.int64)
        return there, there & hot[at]

    def chosen(self, c: Contexts, files: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        which, single = np.zeros(len(c.start), bool), np.zeros(len(c.start), bool)
        of = files[c.text]
        for f in np.unique(of):
            own = np.flatnonzero(of == f)
            which[own], single[own] = self.look_up(int(f), c.anchor[own])
        return which, single


def _contexts(thin: DataFrame, anchors: str, window: int) -> DataFrame:
    """``key, name, file, lo, hi, words``: the contexts with recurring anchors, once a file (or some times, where a task holds much of it)."""
    names = ["key", "name", "file", "lo", "hi", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, held, rows = _Anchors(anchors), [], 0

        def out(parts: list[list]) -> Iterator[pa.RecordBatch]:
            key, name, file, lo, hi, length = (np.concatenate([p[k] for p in parts]) for k in range(6))
            flat = np.concatenate([p[6] for p in parts])
            ends = np.cumsum(length)
            cols, first = _combined([key, name, file], lo, hi)
            for i in range(0, len(first), 20_000):
                f = first[i:i + 20_000]
                own, stop = gather(flat, (ends - length)[f], length[f])
                words = pa.Array.from_buffers(pa.binary(), len(f), [None, pa.py_buffer(np.concatenate([[0], stop * _BYTES]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(own.view(np.uint8).reshape(-1, 8)[:, :_BYTES]))])
                yield pa.RecordBatch.from_arrays([*[pa.array(c[i:i + 20_000]) for c in cols], words], names)

        for b, c in _slices(batches, 2, window, 1):
            files = np.asarray(b.column(0))
            start, windows, key, name = c.split(*sent.chosen(c, files))
            text = np.searchsorted(c.words.first, start, "right") - 1
            ids = np.asarray(b.column(1).fill_null(0))[text]
            # equal contexts of the slice are one before their words are copied
            cols, first = _combined([key.view(np.int64), name.view(np.int64), files[text]], ids, ids)
            length = windows[first] + window - 1
            flat, _ = gather(c.words.hash, start[first], length)
            held.append([*cols, length, flat])
            rows += len(flat)
            if rows >= _BUFFER:
                yield from out(held)
                held, rows = [], 0
        if held:
            yield from out(held)

    return thin.mapInArrow(run, "key long, name long, file long, lo long, hi long, words binary")


def locate(lo: np.ndarray, hi: np.ndarray, words: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For a shard's contexts (ids from lo to hi, words of ``_BYTES`` bytes) the smallest id of each of their windows, or ``_NONE`` where
    it is in one document only; flat, and where each context begins in it."""
    import ahocorasick

    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].reshape(-1, _BYTES)
    codes = np.zeros((len(raw), 8), np.uint8)
    codes[:, :_BYTES] = raw
    first = (offsets - offsets[0]) // _BYTES
    length = np.diff(first)
    values, letter = np.unique(codes.view(np.uint64)[:, 0], return_inverse=True)
    letter = letter + 1
    letter[letter >= 0xD800] += 0x800  # no surrogates
    if len(values) + 0x801 > 0x110000:
        raise ValueError("a shard has more distinct words than there are letters")
    # one long text of all contexts, each with the letter 0 behind it
    begin = first[:-1] + np.arange(len(length))
    line = np.zeros(len(letter) + len(length), np.uint32)
    line[np.arange(len(letter)) + np.repeat(np.arange(len(length)), length)] = letter
    text = line.tobytes().decode("utf-32-le")
    n_windows = length - window + 1
    w_first = np.concatenate([[0], np.cumsum(n_windows)])
    row = np.repeat(np.arange(len(length)), n_windows)
    at = begin[row] + np.arange(len(row)) - w_first[row]
    sums = prefix_sums(mix(line.astype(np.uint64)))
    hashes = stretch_hashes(sums, at, at + window)
    (_, least, most), example = _combined([hashes], lo[row], hi[row])
    result = np.full(len(row), _NONE, np.int64)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, i in enumerate(at[example[least < most]]):
        automaton.add_word(text[i:i + window], k)
    if not len(automaton):
        return result, w_first
    automaton.make_automaton()
    hits = np.array([x for hit in automaton.iter(text) for x in hit], np.int64).reshape(-1, 2)
    where, phrase = hits[:, 0] - window + 1, hits[:, 1]
    context = np.searchsorted(begin, where, "right") - 1
    small, large = np.full(phrase.max() + 1, _NONE), np.full(phrase.max() + 1, -_NONE)
    np.minimum.at(small, phrase, lo[context])
    np.maximum.at(large, phrase, hi[context])
    small[small >= large] = _NONE
    result[w_first[context] + where - begin[context]] = small[phrase]
    return result, w_first


def _located(contexts: DataFrame, window: int, shard: int) -> DataFrame:
    """``file, name, earliest``: for every context with a window that an earlier document has, the smallest id of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, shard):
            name, file, lo, hi = (t.column(k).to_numpy() for k in ("name", "file", "lo", "hi"))
            words = t.column("words").combine_chunks()
            found, first = locate(lo, hi, words.chunk(0) if isinstance(words, pa.ChunkedArray) else words, window)
            tells = np.minimum.reduceat(found, first[:-1]) < hi
            flat, stop = gather(found, first[:-1][tells], np.diff(first)[tells])
            yield pa.RecordBatch.from_arrays([pa.array(file[tells]), pa.array(name[tells]), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]), pa.int32()), pa.array(flat))], ["file", "name", "earliest"])

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(run, "file long, name long, earliest array<long>")


class _Earliest(_Sent):
    def look_up(self, file: int, name: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the contexts are there, and the smallest ids of the windows of these, one after the other."""
        t = self.table(file)
        if t is None or not t.num_rows:
            return np.zeros(len(name), bool), np.zeros(0, np.int64)
        lists = t.column("earliest")
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        known, offsets, flat = t.column("name").to_numpy(), np.asarray(lists.offsets), np.asarray(lists.values)
        at = np.minimum(np.searchsorted(known, name.view(np.int64)), len(known) - 1)
        there = known[at] == name.view(np.int64)
        found, _ = gather(flat, offsets[at[there]].astype(np.int64), windows[there])
        return there, found


def without_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", from_files: bool = False,
                    hot: int = 4096, shard: int = 20_000) -> DataFrame:
    """All rows with ``n_words``, ``cuts`` (from, to: the stretches of words that went) and as text the kept words joined by one space."""
    if window < GRAM:
        raise ValueError(f"a window has {GRAM} words at least")
    spark: SparkSession = docs.sparkSession
    folder = new_folder(spark, "passages")
    docs = docs.drop("n_words", "cuts")
    if not from_files:
        renamed, of = numbered(docs)
        renamed.write.parquet(f"{folder}/docs")
        docs = spark.read.parquet(f"{folder}/docs").toDF(*of)
    thin = _keyed(docs, id_col, text_col)
    _by_file(_recurring(_anchors(thin, window), hot), f"{folder}/anchors", "anchor")
    _by_file(_located(_contexts(thin, f"{folder}/anchors", window), window, shard), f"{folder}/earliest", "name")

    own, of = numbered(docs)
    names, at = own.columns, own.columns.index(of[text_col])
    keyed = own.select(*names, F.col(of[id_col]).cast("long").alias("id"), F.xxhash64(F.input_file_name()).alias("file"))
    cut_type = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, earliest = _Anchors(f"{folder}/anchors"), _Earliest(f"{folder}/earliest")
        for b, c in _slices(batches, at, window, len(names)):
            files, ids = np.asarray(b.column(len(names) + 1)), np.asarray(b.column(len(names)).fill_null(0))
            start, windows, _, name = c.split(*anchors.chosen(c, files))
            text = np.searchsorted(c.words.first, start, "right") - 1
            edge = np.zeros(len(c.words.hash) + 1, np.int64)
            for f in np.unique(files[text]):
                i = np.flatnonzero(files[text] == f)
                there, first = earliest.look_up(int(f), name[i], windows[i])
                i = i[there]
                ends = np.cumsum(windows[i])
                each = np.repeat(start[i] - (ends - windows[i]), windows[i]) + np.arange(len(first))
                each = each[first < np.repeat(ids[text[i]], windows[i])]
                np.add.at(edge, each, 1)
                np.add.at(edge, each + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            texts, cuts, ends = [], [], [0]
            for k, t in enumerate(b.column(at).cast(pa.binary())):
                t, own_gone = t.as_py(), gone[c.words.first[k]:c.words.first[k + 1]]
                if t is not None:
                    kept = t.split()
                    if own_gone.any():
                        kept = compress(kept, ~own_gone)
                        cuts.append(np.flatnonzero(np.diff(np.concatenate([[0], own_gone, [0]]).astype(np.int8))).reshape(-1, 2))
                    t = b" ".join(kept).decode()
                texts.append(t)
                ends.append(ends[-1] + (len(cuts[-1]) if own_gone.any() else 0))
            flat = np.concatenate(cuts) if cuts else np.zeros((0, 2), np.int64)
            spans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["from", "to"]))
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(c.words.first), pa.int64()), spans.cast(cut_type)], [*names, "n_words", "cuts"])

    pair = T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())])
    schema = T.StructType([*own.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("cuts", T.ArrayType(pair))])
    return keyed.mapInArrow(run, schema).toDF(*of, "n_words", "cuts")
