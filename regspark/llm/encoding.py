"""Token ids of whole texts with the ``tokenizers`` library, where each distinct word is encoded once.

In byte-level BPE and in SentencePiece models whose pieces hold the space marker only in front, no token reaches
over a space that stands between two words. So a text that has single spaces only is the chain of its words' tokens,
each word with the space before it. The words of a batch are hashed and made distinct by numpy, those that the worker has not met are encoded
together by the library, and the chains are gathered by numpy. Texts in which this does not hold (runs of spaces, a
space at an end, a literal marker, an added token) are given to the library as they are.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from regspark.llm.words import Words, mix

#: White space of any kind, as RE2 classes; a superset sends a text to the library whole, which is always right.
_WS = r"[\s\v\x1c-\x1f\x85\p{Z}]"


def use_threads(n: int) -> None:
    """Threads of the library in this worker; only what is set before its first batch counts."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true" if n > 1 else "false")
    os.environ.setdefault("RAYON_NUM_THREADS", str(n))


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices flat[start:start+length], one after the other, and where each ends."""
    ends = np.cumsum(length)
    n = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - length), length) + np.arange(n)], ends


def cuts(lengths: np.ndarray, most: int = 8 << 20) -> list[tuple[int, int]]:
    """Stretches of rows whose lengths sum up to ``most`` at most; a longer row is one alone. Bounds what a step holds in memory."""
    ends, out, i = np.cumsum(lengths), [], 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        out.append((i, j))
        i = j
    return out


def text_cuts(texts: pa.Array, most: int = 8 << 20) -> list[tuple[int, int]]:
    return cuts(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64), most)


_SPACE = np.zeros(256, bool)
_SPACE[32] = True
_PLAIN = np.uint64(0x5851F42D4C957F2D)
#: Byte-level BPE never joins ASCII letters, digits and other signs, but for an apostrophe and what follows; beside other characters no cut is made.
_KINDS = np.zeros(256, np.uint8)
_KINDS[33:128] = 3
_KINDS[48:58] = 2
_KINDS[[*range(65, 91), *range(97, 123)]] = 1


class WordEncoder:
    """``byte_level``: a text's first word has no marker before it, and words fall into parts of letters, digits and signs. ``marks``: by id, whether the token begins with the marker.

    Words are known by their 64-bit hash. ``keep`` bounds the words remembered between batches (some 60 bytes each); it changes the time taken, never a
    result.
    """

    def __init__(self, tokenizer, marks: np.ndarray, marker: str, byte_level: bool, keep: int = 1_500_000):
        self.t, self.marks, self.byte_level, self.keep = tokenizer, marks, byte_level, keep
        # texts with an added token in them are for the library, which cuts these tokens out first
        extra = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()] if byte_level else []
        extra += [] if marker == " " else [marker]
        self.irregular = "|".join([rf"^$|^{_WS}| $| {_WS}", *extra])
        self.keys = np.zeros(0, np.uint64)  # sorted; the next two say where a word's ids are in ``flat``
        self.flat, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each after a space, and their number by word."""
        groups = [words[i:i + 1000] for i in range(0, len(words), 1000)]
        lead = " " if self.byte_level else ""
        flat, length = [], []
        for g, ids in zip(groups, self._whole([lead + " ".join(g) for g in groups])):
            at = np.flatnonzero(self.marks[ids])
            if len(at) == len(g) and at[0] == 0:
                flat.append(ids)
                length.append(np.diff(np.append(at, len(ids))))
            else:
                one = self._whole([lead + w for w in g])
                flat += one
                length.append(np.array([len(x) for x in one], np.int64))
        return np.concatenate(flat) if flat else np.zeros(0, np.uint32), np.concatenate(length) if length else np.zeros(0, np.int64)

    def _new(self, words: Words, at: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places, and their number by word; ``plain``: without a space before."""
        raw = words.data.tobytes()
        text = [raw[i:j].decode() for i, j in zip(words.start[at].tolist(), words.stop[at].tolist())]
        flat, length = self._words([t for t, p in zip(text, plain) if not p])
        alone = self._whole([t for t, p in zip(text, plain) if p]) if plain.any() else []
        size = np.zeros(len(at), np.int64)
        size[~plain], size[plain] = length, [len(x) for x in alone]
        start = np.zeros(len(at), np.int64)
        start[~plain] = np.cumsum(length) - length
        start[plain] = len(flat) + np.cumsum(size[plain]) - size[plain]
        return gather(np.concatenate([flat, *alone]), start, size)[0], size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the end of each text's ids. Null counts as the empty text."""
        texts = pc.fill_null(texts, "")
        odd = np.asarray(pc.match_substring_regex(texts, self.irregular))
        regular = pc.if_else(pa.array(odd), "", texts)
        words = Words(regular, _SPACE, _KINDS, ord("'")) if self.byte_level else Words(regular, _SPACE)
        plain = ~words.spaced & self.byte_level
        key = np.where(plain, mix(words.hash ^ _PLAIN), words.hash)
        distinct, example, of = np.unique(key, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        known = self.keys[at] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        missing = np.flatnonzero(~known)
        ids, length = self._new(words, example[missing], plain[example[missing]])
        tab = np.concatenate([self.flat, ids])
        w_start, w_len = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        w_start[known], w_len[known] = self.start[at[known]], self.length[at[known]]
        w_start[missing], w_len[missing] = len(self.flat) + np.cumsum(length) - length, length
        n = min(self.keep - len(self.keys), len(missing))
        if n > 0:
            room = missing[:n]
            keys = np.concatenate([self.keys, distinct[room]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.start = keys[order], np.concatenate([self.start, w_start[room]])[order]
            self.length = np.concatenate([self.length, w_len[room].astype(np.int32)])[order]
            self.flat = tab[:len(self.flat) + int(length[:n].sum())]
        out, ends = gather(tab, w_start[of], w_len[of])
        ends = np.concatenate([[0], ends])[words.first[1:]]
        if odd.any():
            at = np.flatnonzero(odd)
            parts = np.split(out, ends[:-1])
            for i, x in zip(at, self._whole(texts.take(pa.array(at)).to_pylist())):
                parts[i] = x
            out, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return out, ends
