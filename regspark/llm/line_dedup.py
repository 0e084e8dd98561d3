"""Removal of repeated runs of lines by a suffix array over line ids.

The lines that hold a word form one sequence a document. A line that occurs once in the corpus ends every repeated run, so
only the other lines get ids, by their order. Prefix doubling then ranks, round by round, the suffixes by their first
1, 2, 4, ... lines: the pairs (rank at i, rank at i + k) are made distinct, sorted over the cluster and numbered in order.
A suffix whose prefix occurs once drops out, as no longer run repeats from there. The ranks of a round are the suffix
array in the order of its first 2k lines.

A run counts if it has ``min_words`` words. Let a window be the shortest stretch of lines from a line onwards, or back
from a line, with that many words. The lines of all repeated runs that count are exactly the lines of all windows that
repeat: inside such a run every line lies in the window that starts at it or in the one that ends the run. So the
longest-common-prefix intervals are needed at the depths of the windows only, which ends doubling at ``min_words`` lines at
the latest, however long the repeated runs are. All suffixes with the window's lines in front are one interval, named by
the ranks of its first and its last 2**r lines. In each interval the first window in order of id and line stays, and the
lines of the others go; chained windows take away whole maximal runs. Of a line that repeats without end in one document
the first stays. Every deleted line has an equal line that stays.

Blank lines stand in no run and go with the line before them. Rows equal in id and text are one document: all get its
result. Null ids come first in order; a null text stays null and has no lines. An empty table gives an empty result.
Columns of the results replace columns of the same name, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark.llm.common import cut_lineage, numbered, row_key


def windows(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of every shortest stretch with ``least`` words, from each line on and back from each line."""
    end = np.cumsum(words)
    begin = end - words
    stop = np.searchsorted(end, begin + least) + 1  # one past the last line
    start = np.searchsorted(begin, end - least, "right") - 1
    i = np.arange(len(words))
    ahead, back = stop <= len(words), end >= least
    both = np.unique(np.stack([np.append(i[ahead], start[back]), np.append(stop[ahead] - i[ahead], i[back] + 1 - start[back])]), axis=1)
    return both[0], both[1]


def _sequences(keyed: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """A row a document: hashes and places of its lines with words, and its windows."""
    names = ["_k1", "_k2", "id", "n_lines", "h1", "h2", "place", "w_from", "w_lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            out: list[list] = [[] for _ in names[3:]]
            for text in b.column(3).cast(pa.binary()):
                lines = text.as_py().split(b"\n")
                words = np.fromiter((len(x.split()) for x in lines), np.int64, len(lines))
                at = np.flatnonzero(words)
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(lines[i]) for i in at), "<i8").reshape(-1, 2)
                start, size = windows(words[at], least)
                for o, v in zip(out, (len(lines), digest[:, 0], digest[:, 1], at, start, size)):
                    o.append(v)
            kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array(o, k) for o, k in zip(out, kinds)]], names)

    thin = keyed.filter(F.col(text_col).isNotNull()).select("_k1", "_k2", F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = keyed.schema[id_col].dataType.simpleString()
    rows = thin.mapInArrow(run, f"_k1 long, _k2 long, id {id_type}, n_lines int, h1 array<long>, h2 array<long>, place array<int>, w_from array<int>, w_lines array<int>")
    return cut_lineage(rows.filter("size(w_from) > 0").dropDuplicates(["_k1", "_k2"]))


def _ranked(names: DataFrame, cols: list[str]) -> DataFrame:
    """``rank``: a number for each row of ``names`` in the order of ``cols``; over ranges, so nothing meets in one task."""
    return cut_lineage(names.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("rank", F.monotonically_increasing_id()))


def suffix_ranks(lines: DataFrame, depth: int) -> list[DataFrame]:
    """Rank of the suffixes by their first 1, 2, 4, ... lines, up to ``depth`` lines. ``lines``: _k1, _k2, i, h1, h2.

    Round r has ``_k1, _k2, i, rank`` of the suffixes whose first 2**r lines occur more than once.
    """
    more = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    rounds = [cut_lineage(lines.join(_ranked(more, ["h1", "h2"]), ["h1", "h2"]).select("_k1", "_k2", "i", "rank"))]
    while 2 << (len(rounds) - 1) <= depth:
        k, last = 1 << (len(rounds) - 1), rounds[-1]
        ahead = last.select("_k1", "_k2", (F.col("i") - k).alias("i"), F.col("rank").alias("r2"))
        pairs = last.withColumnRenamed("rank", "r1").join(ahead, ["_k1", "_k2", "i"])
        more = pairs.groupBy("r1", "r2").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
        rounds.append(cut_lineage(pairs.join(_ranked(more, ["r1", "r2"]), ["r1", "r2"]).select("_k1", "_k2", "i", "rank")))
    return rounds


def repeats(sequences: DataFrame) -> DataFrame:
    """``_k1, _k2, cuts``: the stretches of lines of each document that are later copies, as arrays of (from, to)."""
    depth = sequences.agg(F.max(F.array_max("w_lines"))).first()[0] or 1
    lines = sequences.select("_k1", "_k2", F.posexplode(F.arrays_zip("h1", "h2")).alias("i", "h")).select("_k1", "_k2", "i", "h.h1", "h.h2")
    rounds = suffix_ranks(lines, depth)
    level = F.floor(F.log2(F.col("m") + 0.5)).cast("int")
    asked = (sequences.select("_k1", "_k2", "id", "n_lines", "place", F.explode(F.arrays_zip("w_from", "w_lines")).alias("w"))
             .select("_k1", "_k2", "id", F.col("w.w_from").alias("s"), F.col("w.w_lines").alias("m"), F.element_at("place", F.col("w.w_from") + 1).alias("from"),
                     F.coalesce(F.get("place", F.col("w.w_from") + F.col("w.w_lines")), F.col("n_lines")).alias("to"))
             .withColumn("r", level))
    ranks = rounds[0].withColumn("r", F.lit(0))
    for r, one in enumerate(rounds[1:], 1):
        ranks = ranks.union(one.withColumn("r", F.lit(r)))
    front = ranks.select("_k1", "_k2", "r", F.col("i").alias("s"), F.col("rank").alias("a"))
    back = ranks.select("_k1", "_k2", "r", F.col("i").alias("e"), F.col("rank").alias("b"))
    named = (asked.join(front, ["_k1", "_k2", "r", "s"]).withColumn("e", F.col("s") + F.col("m") - F.expr("shiftleft(1, r)"))
             .join(back, ["_k1", "_k2", "r", "e"]).select("m", "a", "b", F.struct("id", "_k1", "_k2", "s").alias("at"), "from", "to"))
    named = cut_lineage(named)
    # written first, so that the join stands on plain shuffles and Spark can split an interval with very many windows
    intervals = cut_lineage(named.groupBy("m", "a", "b").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    later = named.join(intervals, ["m", "a", "b"]).filter("not (at <=> first)")
    return later.groupBy("at._k1", "at._k2").agg(F.collect_list(F.struct("from", "to")).alias("cuts")).toDF("_k1", "_k2", "cuts")


def deduplicated(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows with later copies of repeated runs taken out of the text, and ``n_lines, n_deleted``."""
    own, of = numbered(docs.drop("n_lines", "n_deleted"))
    keyed = own.select("*", *row_key([of[id_col], of[text_col]]))
    cuts = repeats(_sequences(keyed, of[id_col], of[text_col], min_words))
    names, at = own.columns, own.columns.index(of[text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, total, gone = [], [], []
            for text, own in zip(b.column(at), b.column(len(names)).to_pylist()):
                t = text.as_py()
                n = 0 if t is None else t.count("\n") + 1
                cut = 0
                if own:
                    lines = t.split("\n")
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, [c["from"] for c in own], 1)
                    np.add.at(edge, [c["to"] for c in own], -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    cut = int(n - stays.sum())
                    t = "\n".join(x for x, s in zip(lines, stays) if s)
                texts.append(t)
                total.append(n)
                gone.append(cut)
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int32()), pa.array(gone, pa.int32())], [*names, "n_lines", "n_deleted"])

    schema = T.StructType([*own.schema.fields, T.StructField("n_lines", T.IntegerType()), T.StructField("n_deleted", T.IntegerType())])
    return keyed.join(cuts, ["_k1", "_k2"], "left").select(*names, "cuts").mapInArrow(run, schema).toDF(*of, "n_lines", "n_deleted")
