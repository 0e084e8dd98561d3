"""SentencePiece encoding and decoding by the ``tokenizers`` library, rebuilt from the model file.

The model's protobuf is read field by field (pieces with scores and kinds, model type, normaliser). From it come the
normaliser (character map, extra spaces, dummy prefix, space marker), the model (unigram scores, or for a BPE model the
merges that its scores imply) with byte fallback, and the decoder. Batches are encoded on the library's threads.
Where pieces hold the marker only in front, a text's words are encoded once each (see ``encoding``).

With ``verify`` all strings that reach the library are also encoded by the ``sentencepiece`` library, and any difference
is an error. As every text is a chain of such strings, this covers every text.

Null text gives null ids and decodes to null; an empty text gives no ids. Rows that repeat are encoded each. Other
columns pass through; an existing column of the output's name is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from regspark.llm.encoding import WordEncoder, cuts, gather, text_cuts, use_threads

MARK = "▁"
# Piece kinds and model types of the model file's format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_marker: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape: bool = True

    @property
    def unknown_id(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of one protobuf message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire = tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            n, at = (8, at) if wire == 1 else (4, at) if wire == 5 else _varint(data, at)
            value, at = data[at:at + n], at + n
        yield tag >> 3, value


def parse_model(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            m.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
        elif number == 2:
            own = dict(_fields(value))
            m.kind, m.byte_fallback, m.suffix_marker = own.get(3, UNIGRAM), bool(own.get(35, 0)), bool(own.get(24, 0))
        elif number == 3:
            own = dict(_fields(value))
            m.charsmap, m.dummy_prefix, m.trim_spaces, m.escape = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
    if m.kind not in (UNIGRAM, BPE) or m.suffix_marker or not m.escape:
        raise ValueError("only unigram and BPE models with the marker in front of words are read")
    return m


def build(m: Model):
    """The same tokenizer for the ``tokenizers`` library."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    names = [p for p, _, _ in m.pieces]
    if m.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=m.unknown_id, byte_fallback=m.byte_fallback)
    else:
        place = {p: i for i, p in enumerate(names)}
        usable = {p for p, _, kind in m.pieces if kind in (NORMAL, USER)}
        merges = [(-s, place[p], p[:i], p[i:]) for p, s, kind in m.pieces if kind == NORMAL
                  for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]
        model = models.BPE(place, [(a, b) for _, _, a, b in sorted(merges)], unk_token=names[m.unknown_id], fuse_unk=True, byte_fallback=m.byte_fallback)
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.trim_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *[decoders.Strip(" ", 1, 0)] * m.dummy_prefix])
    own = [AddedToken(p, normalized=False) for p, _, kind in m.pieces if kind == USER]
    if own:
        t.add_tokens(own)
    return t


class Codec:
    def __init__(self, data: bytes, threads: int, verify: bool):
        use_threads(threads)
        self.data, self.verify = data, verify
        self.model = m = parse_model(data)
        text = [bytes([int(p[3:5], 16)]) if kind == BYTE else b" \xe2\x81\x87 " if kind == UNKNOWN else b"" if kind == CONTROL
                else p.replace(MARK, " ").encode() for p, _, kind in m.pieces]
        self.bytes_len = np.array([len(x) for x in text], np.int64)
        self.bytes_start, self.bytes_flat = np.cumsum(self.bytes_len) - self.bytes_len, np.frombuffer(b"".join(text), np.uint8)

    @cached_property
    def t(self):
        return build(self.model)

    @cached_property
    def own(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.data)

    @cached_property
    def words(self) -> WordEncoder | None:
        """By words, where no piece reaches over a space."""
        m = self.model
        if not m.dummy_prefix or m.trim_spaces or m.charsmap or m.kind != BPE or any(kind == USER or MARK in p.lstrip(MARK) for p, _, kind in m.pieces):
            return None
        return _Checked(self, np.array([p.startswith(MARK) and kind == NORMAL for p, _, kind in m.pieces]))

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        out = [e.ids for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]
        if self.verify:
            for text, a, b in zip(texts, out, self.own.encode(texts, num_threads=1)):
                if a != b:
                    raise ValueError(f"the rebuilt tokenizer differs from the model on {text[:200]!r}")
        return [np.asarray(x, np.uint32) for x in out]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the end of each text's; null counts as empty."""
        if self.words is not None:
            return self.words.encode(texts)
        parts = self.whole(pc.fill_null(texts, "").to_pylist())
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), np.cumsum([len(p) for p in parts], dtype=np.int64)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts from ids. The bytes of all pieces are chained; what is not UTF-8 then goes through the library's decoder."""
        ids = ids.astype(np.int64)
        raw, byte_ends = gather(self.bytes_flat, self.bytes_start[ids], self.bytes_len[ids])
        stop = np.concatenate([[0], byte_ends])[ends]
        start = np.concatenate([[0], stop[:-1]])
        if self.model.dummy_prefix and len(raw):  # the space of the dummy prefix
            lead = (stop > start) & (raw[np.minimum(start, len(raw) - 1)] == 32)
            keep = np.ones(len(raw), bool)
            keep[start[lead]] = False
            raw, stop = raw[keep], stop - np.cumsum(lead)
        offsets = np.concatenate([[0], stop]).astype(np.int64)
        try:
            raw.tobytes().decode()  # else some text has broken bytes
            return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))).cast(pa.string())
        except UnicodeDecodeError:
            return pa.array(self.t.decode_batch([x.tolist() for x in np.split(ids, ends[:-1])] if len(ends) else [], skip_special_tokens=False))


class _Checked(WordEncoder):
    """The word encoder on top of a codec, so that what it gives to the library is verified too."""

    def __init__(self, codec: Codec, marks: np.ndarray):
        super().__init__(codec.t, marks, MARK, byte_level=False, keep=400_000)
        self._whole = codec.whole


_codecs: dict[tuple, Codec] = {}


def codec(path: str, data: bytes | None = None, threads: int = 2, verify: bool = True) -> Codec:
    """One codec a worker."""
    key = (path, threads, verify)
    if key not in _codecs:
        if data is None:
            with open(path, "rb") as f:
                data = f.read()
        _codecs[key] = Codec(data, threads, verify)
    return _codecs[key]


def _map(docs: DataFrame, read: str, made: dict[str, T.DataType], size, fn) -> DataFrame:
    """Adds or replaces columns in Arrow batches of bounded size; ``size`` cuts a batch, ``fn`` gives the columns of a part."""
    kept = [i for i, c in enumerate(docs.columns) if c not in made]
    names, at = [docs.columns[i] for i in kept], docs.columns.index(read)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, j in size(whole.column(at)):
                b = whole.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in kept], *fn(b.column(at))], [*names, *made])
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, T.StructType([*[docs.schema.fields[i] for i in kept], *[T.StructField(c, t) for c, t in made.items()]]))


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", round_trip_col: str | None = None,
           threads: int = 2, verify: bool = True) -> DataFrame:
    """Adds the ids of each text as ``array<int>`` and, if a column is named for it, whether they decode to the text (null with the text)."""

    def columns(texts: pa.Array) -> list[pa.Array]:
        c = codec(model_path, threads=threads, verify=verify)
        ids, ends = c.encode(texts)
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.append(np.asarray(texts.is_null()), False))
        out = [pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))]
        return out if round_trip_col is None else [*out, pc.equal(c.decode(ids, ends), texts)]

    made = {ids_col: T.ArrayType(T.IntegerType())} | ({} if round_trip_col is None else {round_trip_col: T.BooleanType()})
    return _map(docs, text_col, made, lambda texts: text_cuts(texts, 4 << 20), columns)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded", threads: int = 2) -> DataFrame:
    """Adds the text of each row's ids."""

    def columns(lists: pa.Array) -> list[pa.Array]:
        n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
        texts = codec(model_path, threads=threads, verify=False).decode(np.asarray(lists.flatten()), np.cumsum(n, dtype=np.int64))
        return [pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string()))]

    return _map(rows, ids_col, {text_col: T.StringType()}, lambda lists: cuts(np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64), 1 << 20), columns)
