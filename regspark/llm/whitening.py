"""Whitening of embeddings with Spark MLlib's BlockMatrix.

Each entry c of a vector becomes the integer floor(1024 * c) + 100000; sums over the corpus are sums of integers, so the mean
is exact. The centred rows are cut into blocks of ``block`` rows inside their partitions, without a shuffle; the last block of a
partition is filled up with zero rows, which add nothing. A BlockMatrix of these blocks, transposed and multiplied with
itself, gives the scatter matrix; the middle dimension is split, so every task multiplies some blocks and only matrices
of the width of a vector meet. Its eigenvectors are taken on the driver (a matrix of that width squared), and a second product, of the blocks
with the whitening matrix, projects the rows. MLlib deals a matrix out by rectangles of its block grid, which makes few tasks of
one long column of blocks; for the projection the blocks are therefore laid out as a square grid, against a block-diagonal whitening matrix.

Rows whose vector is null, is empty, or holds a null or non-finite entry are dropped; so are rows whose vector has another
length than most (the shorter where two lengths are equally frequent) or than ``width`` where that is given. Integers are held
within 2 ** 62. Repeated rows all count and all get a result; ids are only passed on and may be null. Other columns are not
looked at. Components whose eigenvalue is zero to the precision of the doubles cannot be scaled and are left out, so equal vectors only, or
an empty table, give rows without components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.linalg import DenseMatrix, Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark.llm.common import cut_lineage

SCALE, SHIFT, _MOST = 1024.0, 100_000, float(1 << 62)


@dataclass
class Whitened:
    """``rows``: id, deviation (sum over dimensions of (n * x - S) ** 2, null beyond 64 bits), whitened (a value a component)."""

    rows: DataFrame
    n: int
    eigenvalues: list[float]
    explained: list[float]
    identity_error: float


def integers(vector: Column) -> Column:
    """The vector's entries as integers."""
    return F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-_MOST)), F.lit(_MOST))).cast("long") + F.lit(SHIFT).cast("long"))


def usable(vectors: DataFrame, vector_col: str, width: int | None = None) -> tuple[DataFrame, int]:
    """The rows with a whole vector of the usual length, and that length."""
    v = F.col(vector_col)
    whole = vectors.filter(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    if width is None:
        usual = whole.groupBy(F.size(v).alias("w")).count().orderBy(F.desc("count"), "w").first()
        width = usual.w if usual else 0
    return whole.filter(F.size(v) == width), width


def _matrix(b: pa.RecordBatch, col: int, width: int) -> np.ndarray:
    return np.asarray(b.column(col).flatten(), np.int64).reshape(-1, width)


def _sums(rows: DataFrame, width: int) -> tuple[dict[int, int], list[int]]:
    """Rows by partition, and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for b in batches:
            x = _matrix(b, 0, width)
            n += len(x)
            total += (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"part": [part] * (width + 1), "k": list(range(-1, width)), "s": [Decimal(int(v)) for v in (n, *total)]},
                                         schema=pa.schema([("part", pa.int32()), ("k", pa.int32()), ("s", pa.decimal128(38, 0))]))

    found = rows.select("x").mapInArrow(run, "part int, k int, s decimal(38,0)")
    sizes = {r.part: int(r.s) for r in found.filter("k = -1").collect()}  # a row a partition
    sums = {r.k: int(r.s) for r in found.filter("k >= 0").groupBy("k").agg(F.sum("s").alias("s")).collect()}  # a row a dimension
    return sizes, [sums[k] for k in range(width)]


def _blocks(rows: DataFrame, width: int, n: int, sums: list[int], bases: dict[int, int], block: int) -> DataFrame:
    """``block, members`` (id, deviation), ``values``: row by row, each block filled up with zero rows."""
    id_type = rows.schema["id"].dataType
    spread = np.array(sums, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = bases[TaskContext.get().partitionId()]
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> pa.RecordBatch:
            b = table.combine_chunks().to_batches()[0]
            x = _matrix(b, 1, width)
            reach = (int(np.abs(x).max()) + 1) * n + max(abs(s) for s in sums)
            if reach < 1 << 62:
                y = x * n - spread.astype(np.int64)
                centred = y / n
                top = int(np.abs(y).max())
            else:
                y = x.astype(object) * n - spread
                centred, top = (y / n).astype(float), 1 << 62
            if width * top * top < 1 << 63:
                deviation = pa.array((y * y).sum(axis=1), pa.int64())
            else:
                exact = (y.astype(object) ** 2).sum(axis=1)
                deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            values = np.zeros((block, width))
            values[:len(x)] = centred
            members = pa.StructArray.from_arrays([b.column(0), deviation], ["id", "deviation"])
            nonlocal at
            at += 1
            return pa.RecordBatch.from_arrays([pa.array([at - 1], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), members),
                                               pa.ListArray.from_arrays(pa.array([0, values.size], pa.int32()), pa.array(values.ravel()))], ["block", "members", "values"])

        for b in batches:
            held.append(b)
            while sum(x.num_rows for x in held) >= block:
                table = pa.Table.from_batches(held)
                yield out(table.slice(0, block))
                held = table.slice(block).to_batches()
        if sum(x.num_rows for x in held):
            yield out(pa.Table.from_batches(held))

    member = T.StructType([T.StructField("id", id_type), T.StructField("deviation", T.LongType())])
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("members", T.ArrayType(member)), T.StructField("values", T.ArrayType(T.DoubleType()))])
    return rows.select("id", "x").mapInArrow(run, schema)


def _scatter(blocks: BlockMatrix, splits: int) -> np.ndarray:
    """Transpose times matrix. The split of the middle dimension is an argument that MLlib's Python wrapper does not pass on."""
    java = blocks._java_matrix_wrapper._java_model
    product = java.transpose().multiply(java, splits)
    return BlockMatrix(product, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def whiten(vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", components: int = 8, width: int | None = None, block: int = 1024) -> Whitened:
    """Projects all usable rows on the first components of their covariance, scaled to variance one."""
    kept, width = usable(vectors, vector_col, width)
    rows = cut_lineage(kept.select(F.col(id_col).alias("id"), integers(F.col(vector_col)).alias("x")))
    sizes, sums = _sums(rows, width)
    n = sum(sizes.values())
    result = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    if not n:
        return Whitened(vectors.sparkSession.createDataFrame([], result), 0, [], [], 0.0)
    bases, total = {}, 0
    for part in sorted(sizes):
        bases[part], total = total, total + ceil(sizes[part] / block)
    blocks = cut_lineage(_blocks(rows, width, n, sums, bases, block))
    dense = blocks.select("block", "values").rdd.map(lambda r: (r.block, DenseMatrix(block, width, r["values"], True)))
    tall = BlockMatrix(dense.map(lambda b: ((b[0], 0), b[1])), block, width, total * block, width)
    covariance = _scatter(tall, max(1, ceil(total / 32))) / n
    values, basis = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values)[:components]
    order = order[values[order] > max(values.max(), 0.0) * width * np.finfo(float).eps * 16]
    axes = basis[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))])
    k = len(order)
    if not k:
        plain = blocks.select(F.explode("members").alias("m")).select("m.id", "m.deviation", F.array().cast("array<double>").alias("whitened"))
        return Whitened(plain, n, [], [], 0.0)
    side = isqrt(total - 1) + 1
    square = BlockMatrix(dense.map(lambda b: ((b[0] // side, b[0] % side), b[1])), block, width, ceil(total / side) * block, side * width)
    weights = Matrices.dense(width, k, (axes / np.sqrt(values[order])).ravel(order="F").tolist())
    spark = vectors.sparkSession
    diagonal = BlockMatrix(spark.sparkContext.parallelize(range(side), max(1, side // 64)).map(lambda i: ((i, i), weights)), width, k, side * width, side * k)
    projected = square.multiply(diagonal).blocks.map(lambda b: (b[0][0] * side + b[0][1], b[1].toArray().tolist()))
    whitened = spark.createDataFrame(projected, "block long, w array<array<double>>")
    joined = blocks.select("block", "members").join(whitened, "block")
    # the zero rows behind a block's members have no member
    got = cut_lineage(joined.select(F.explode(F.zip_with("members", F.slice("w", F.lit(1), F.size("members")), lambda m, w: F.struct(m["id"].alias("id"), m["deviation"].alias("deviation"), w.alias("whitened")))).alias("r")).select("r.*"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    again = got.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(again[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    trace = float(np.trace(covariance))
    return Whitened(got, n, [float(values[i]) for i in order], [float(values[i]) / trace for i in order], float(error))
