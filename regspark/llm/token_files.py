"""Token-ID output: flat files of unsigned integers with 64-bit document offsets, read back through memory maps.

A folder holds, for each part, ``part-N.ids`` (all ids, little-endian unsigned 16 bit if every id fits, else 32 bit) and
``part-N.idx``: a header of three 64-bit words (documents, bytes of an id, 1 if the index says which document ids are
null), the document offsets (unsigned 64 bit, one more than documents, counted inside the part), the document ids
(signed 64 bit) and, if said so, one byte each for null ids. ``manifest`` is a Parquet table of the parts with the
prefix sums of their ids and documents: the base of a part plus an offset is a place in the whole corpus.

Documents go in ascending order of their id, nulls first; rows that share an id go by a hash of their text. Null text
counts as empty, an empty text gives the end id alone. Rows that repeat are all kept. An empty table gives a folder with
an empty manifest. Other columns are not looked at.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regspark.llm.encoding import WordEncoder, text_cuts, use_threads

_encoders: dict[str, WordEncoder] = {}


def byte_level_encoder(tokenizer_path: str, threads: int = 1) -> WordEncoder:
    """One encoder a worker; as the library comes, the string of a special token in a text is that token."""
    if tokenizer_path not in _encoders:
        use_threads(threads)
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer_path)
        marks = np.zeros(t.get_vocab_size(), bool)
        for piece, i in t.get_vocab().items():
            marks[i] = piece.startswith("Ġ")
        _encoders[tokenizer_path] = WordEncoder(t, marks, " ", byte_level=True)
    return _encoders[tokenizer_path]


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                      text_col: str = "text", id_bytes: int = 2) -> None:
    """Encodes every text and writes the folder. A task that runs again writes the same bytes and renames them into place."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        encoder = byte_level_encoder(tokenizer_path)
        fs, root = _filesystem(folder)
        name, attempt = f"{root}/part-{task.partitionId():07d}", task.taskAttemptId()
        dtype = np.dtype("<u2" if id_bytes == 2 else "<u4")
        ends, ids, nulls, base = [np.zeros(1, np.int64)], [], [], 0
        with fs.open_output_stream(f"{name}.ids.{attempt}") as out:
            for b in (b.slice(i, j - i) for b in batches for i, j in text_cuts(b.column(1))):
                flat, stop = encoder.encode(b.column(1))
                length = np.diff(np.concatenate([[0], stop])) + 1
                stop = np.cumsum(length)
                whole = np.insert(flat, np.cumsum(length - 1), end_id) if len(length) else flat
                if len(whole) and int(whole.max()) > np.iinfo(dtype).max:
                    raise ValueError(f"ids of {tokenizer_path} do not fit {id_bytes} bytes")
                out.write(whole.astype(dtype).tobytes())
                ends.append(stop + base)
                base += int(stop[-1]) if len(stop) else 0
                ids.append(np.asarray(b.column(0).fill_null(0), np.int64))
                nulls.append(np.asarray(b.column(0).is_null()))
        n = sum(map(len, ids))
        null = np.concatenate(nulls) if nulls else np.zeros(0, bool)
        with fs.open_output_stream(f"{name}.idx.{attempt}") as out:
            out.write(np.array([n, id_bytes, null.any()], "<u8").tobytes())
            out.write(np.concatenate(ends).astype("<u8").tobytes())
            out.write((np.concatenate(ids) if ids else np.zeros(0, np.int64)).astype("<i8").tobytes())
            if null.any():
                out.write(null.astype("u1").tobytes())
        for kind in ("ids", "idx"):
            fs.move(f"{name}.{kind}.{attempt}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "n_docs": [n], "n_ids": [base]},
                                         schema=pa.schema([("part", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    order = [F.col(id_col), F.xxhash64(text_col), F.monotonically_increasing_id()]  # the last only spreads rows that are equal
    parts = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[c.alias(f"_o{i}") for i, c in enumerate(order)])
             .repartitionByRange("_o0", "_o1", "_o2").sortWithinPartitions("_o0", "_o1", "_o2").select("id", "text")
             .mapInArrow(write, "part long, n_docs long, n_ids long"))
    parts.write.parquet(f"{folder}/parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    (docs.sparkSession.read.parquet(f"{folder}/parts").filter("n_docs > 0")
     .select("*", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("id_base"), F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("doc_base"))
     .write.parquet(f"{folder}/manifest"))


def _mapped(fs: pafs.FileSystem, path: str) -> memoryview | bytes:
    """A memory map where the folder is mounted, else the file's bytes."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else b""
    with fs.open_input_file(path) as f:
        return f.read()


def open_part(folder: str, part: int) -> tuple[np.ndarray, np.ndarray, list[int | None]]:
    """The ids, the offsets and the document ids of one part."""
    fs, root = _filesystem(folder)
    name = f"{root}/part-{part:07d}"
    index = _mapped(fs, f"{name}.idx")
    n, width, has_null = (int(x) for x in np.frombuffer(index, "<u8", 3))
    offsets = np.frombuffer(index, "<u8", n + 1, 24).astype(np.int64)
    doc_ids = np.frombuffer(index, "<i8", n, 24 + 8 * (n + 1))
    null = np.frombuffer(index, "u1", n, 24 + 8 * (2 * n + 1)) if has_null else np.zeros(n, np.uint8)
    ids = np.frombuffer(_mapped(fs, f"{name}.ids"), "<u2" if width == 2 else "<u4")
    return ids, offsets, pa.array(doc_ids, mask=null.astype(bool))


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = True, rows: int = 512) -> DataFrame:
    """A row for each document, in any order: doc_id, start (place of its first id in the corpus), n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers) and, if asked for, the ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids, offsets, doc_ids = open_part(folder, part)
                for i in range(0, len(doc_ids), rows):
                    o = offsets[i:i + rows + 1]
                    crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(o[:-1], o[1:])]
                    cols = [doc_ids[i:i + rows].cast(pa.int64()), pa.array(o[:-1] + base), pa.array(np.diff(o)), pa.array(crc, pa.int64())]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(o - o[0], pa.int32()), pa.array(ids[o[0]:o[-1]].astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(cols)])

    parts = spark.read.parquet(f"{folder}/manifest").select("part", "id_base")
    return parts.repartition(max(1, parts.count()), "part").mapInArrow(read, schema)
