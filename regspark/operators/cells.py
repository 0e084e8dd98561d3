"""Exact nearest neighbours from a collection laid out by cells: only blocks that can still hold a hit are scored.

``build_index`` fits centres for each view by spherical k-means on a bounded sample (``sample`` vectors, those with the
smallest hash of their id), assigns every vector to its nearest centre, and writes the vectors by view and cell in blocks of up to
``block_rows`` neighbours in the order of (code, angle to the centre). Blocks come from a range partitioning, so a cell or code with
very many vectors is many blocks in many tasks. A table of blocks keeps cell, code, size and least and largest angle.

For a query at angle t to a centre, a vector at angle a to it is |t - a| away at least, so cos(max(0, t - largest, least - t)) bounds
what a block can give. A search scores the blocks with the best bounds until they hold k vectors; the k-th similarity found
is the bar, and only blocks whose bound reaches it are scored in the second step. The result is that of the full search: the bound
allows for the rounding of similarities to nine decimals.

A query with a code sees the blocks of that code only, before anything is scored. Vectors that are null are not in the index;
a vector of zeros has similarity 0 to all. Vectors of different lengths are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark.functions import features as FE
from regspark.functions import fixed as X
from regspark.operators import retrieve as V
from regspark.operators.ordered import top_per_key
from regspark.session import cut_lineage

QUERY_TILE = 2048  # queries that meet a block in one task
_SLACK = 2e-9


@dataclass(frozen=True)
class CellIndex:
    """An index on disk. ``centres``: for each view, a unit row a cell."""

    folder: str
    id_col: str
    id_type: str
    centres: dict[str, np.ndarray]

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"angle double, code string, id {self.id_type}, vector array<double>, block long, view string, cell int").parquet(f"{self.folder}/vectors")

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("view string, cell int, code string, block long, n long, least double, most double").parquet(f"{self.folder}/blocks")


def fit_centres(vectors: np.ndarray, cells: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means; a cell that loses all its vectors is put on the one that its centre fits worst."""
    distinct = np.unique(vectors, axis=0)
    if len(distinct) <= cells:
        return distinct
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), cells, replace=False)]
    for _ in range(rounds):
        sims = vectors @ centres.T
        own = sims.argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, vectors)
        norm = np.linalg.norm(total, axis=1)
        lost = np.flatnonzero(norm == 0)
        total[lost] = vectors[np.argsort(sims.max(axis=1))[: len(lost)]]
        centres = total / np.linalg.norm(total, axis=1, keepdims=True).clip(1e-300)
    return centres


def _angles(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ centres.T, -1.0, 1.0))


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _sample(chunks: DataFrame, col: str, id_col: str, sample: int) -> np.ndarray:
    rows = chunks.filter(F.col(col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).select(F.col(col).cast("array<double>").alias("v")).limit(sample).toArrow()
    if not rows.num_rows:
        return np.zeros((0, 1))
    column = _one(rows.column("v"))
    return V._matrix(column, len(column[0]))[0]


def build_index(chunks: DataFrame, folder: str, views: dict[str, str] | None = None, id_col: str = "chunk_id", code: Column | None = None,
                cells: int | None = None, sample: int = 20_000, block_rows: int = 1024) -> CellIndex:
    """Writes the index of a collection. ``code``: what queries may be restricted to. ``cells``: 64, or one for each 256 sampled vectors if that is less."""
    views = views or V.VIEWS
    samples = {v: _sample(chunks, c, id_col, sample) for v, c in views.items()}
    centres = {v: fit_centres(x, cells or max(1, min(64, len(x) // 256))) for v, x in samples.items()}
    id_type = chunks.schema[id_col].dataType
    flat = chunks.select(F.col(id_col).alias("id"), (F.lit("") if code is None else F.coalesce(code.cast("string"), F.lit(""))).alias("code"), *[F.col(c).cast("array<double>").alias(v) for v, c in views.items()])
    names = ["view", "cell", "angle", "code", "id", "vector"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, view in enumerate(views):
                if not len(centres[view]):
                    continue
                mat, valid = V._matrix(b.column(k + 2), centres[view].shape[1])
                if not len(valid):
                    continue
                angle = _angles(mat, centres[view])
                cell = angle.argmin(axis=1)
                at = pa.array(valid)
                yield pa.RecordBatch.from_arrays([pa.array([view] * len(valid)), pa.array(cell, pa.int32()), pa.array(angle[np.arange(len(cell)), cell]), b.column(1).take(at), b.column(0).take(at),
                                                  pa.ListArray.from_arrays(pa.array(np.arange(len(mat) + 1) * mat.shape[1], pa.int32()), pa.array(mat.ravel()))], names)

    own = T.StructType([T.StructField("view", T.StringType()), T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType()), T.StructField("code", T.StringType()),
                        T.StructField("id", id_type), T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of neighbours of one view, cell and code, numbered within the partition."""
        block, size, last = TaskContext.get().partitionId() << 32, 0, None
        for b in batches:
            out = []
            for key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
                if last is not None and (key != last or size == block_rows):
                    block, size = block + 1, 0
                last, size = key, size + 1
                out.append(block)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*names, "block"])

    order = ["view", "cell", "code", "angle", "id"]
    placed = flat.mapInArrow(assign, own).repartitionByRange(*order).sortWithinPartitions(*order)
    spark = chunks.sparkSession
    placed.mapInArrow(number, own.add("block", "long")).write.partitionBy("view", "cell").parquet(f"{folder}/vectors")
    index = CellIndex(folder, id_col, id_type.simpleString(), centres)
    index.vectors(spark).groupBy("view", "cell", "code", "block").agg(F.count("*").alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most")).write.parquet(f"{folder}/blocks")
    return index


def _bounds(queries: DataFrame, index: CellIndex) -> DataFrame:
    """``query_id, view, block, n, bound`` of all blocks that a query may see. ``queries``: query_id, vector, code (null: all)."""
    centres = index.centres

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for view, c in centres.items():
                mat, valid = V._matrix(b.column(1), c.shape[1])
                angle = _angles(mat, c)
                at = pa.array(np.repeat(valid, len(c)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array([view] * len(at)), pa.array(np.tile(np.arange(len(c)), len(valid)), pa.int32()), pa.array(angle.ravel())],
                                                 ["query_id", "wanted", "view", "cell", "t"])

    schema = T.StructType([queries.schema["query_id"], T.StructField("wanted", T.StringType()), T.StructField("view", T.StringType()), T.StructField("cell", T.IntegerType()), T.StructField("t", T.DoubleType())])
    near = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), "code").mapInArrow(run, schema)
    met = near.join(index.blocks(queries.sparkSession), ["view", "cell"]).filter("wanted is null or wanted = code")
    away = F.greatest(F.lit(0.0), F.col("t") - F.col("most"), F.col("least") - F.col("t"))
    return met.select("query_id", "view", "cell", "block", "n", F.cos(F.least(away, F.lit(float(np.pi)))).alias("bound"))


def _score(pairs: DataFrame, queries: DataFrame, index: CellIndex, k: int, floor: float | None) -> DataFrame:
    """``query_id, view, id, score``: the best k of each query in each of its blocks. ``pairs``: query_id, view, cell, block."""
    spark = queries.sparkSession
    id_type = index.vectors(spark).schema["id"].dataType
    arrow = pa.schema([("query_id", V._arrow(queries.schema["query_id"].dataType)), ("view", pa.string()), ("id", V._arrow(id_type)), ("score", pa.float64())])
    schema = T.StructType([queries.schema["query_id"], T.StructField("view", T.StringType()), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])
    tiles = max(1, -(-queries.count() // QUERY_TILE))
    asked = pairs.join(queries.select("query_id", "vector"), "query_id").withColumn("tile", F.pmod(F.xxhash64("query_id"), F.lit(tiles)).cast("int"))
    wanted = asked.select("view", "cell", "block", "tile").distinct()
    # cells and views are few (a parameter of the index); naming them lets Spark read their folders only
    named = [F.struct(F.lit(r.view).alias("view"), F.lit(r.cell).alias("cell")) for r in wanted.select("view", "cell").distinct().collect()]
    if not named:
        return spark.createDataFrame([], schema)
    data = index.vectors(spark).filter(F.struct("view", F.col("cell").cast("int").alias("cell")).isin(named)).select(F.col("block").alias("held"), "id", "vector")
    data = data.join(wanted.select(F.col("block").alias("held"), F.col("tile").alias("for_tile")), "held")

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            column = _one(right.column("vector"))
            mat, _ = V._matrix(column, len(column[0]))
            qmat = np.array(left.column("vector").to_pylist(), np.float64)
            qmat /= np.where((norm := np.linalg.norm(qmat, axis=1, keepdims=True)) == 0, 1, norm)
            top = V._TopK(len(qmat), k, floor)
            ids = right.column("id").to_numpy()
            top.add(np.round(qmat @ mat.T, 9), ids.astype(str) if ids.dtype == object else ids)
            qids, views = left.column("query_id").to_pylist(), left.column("view").to_pylist()
            rows = [(qids[q], views[q], V._plain(i), float(s)) for q, ss, ii in top.rows() for s, i in zip(ss, ii)]
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(cols, arrow.types)], schema=arrow)

    return asked.select("query_id", "view", "vector", "block", "tile").groupBy("block", "tile").cogroup(data.groupBy("held", "for_tile")).applyInArrow(tile, schema)


@dataclass
class Found:
    """``hits``: query_id, view, rank, id, score. ``read``: query_id, view, scored and all vectors that the query may see."""

    hits: DataFrame
    read: DataFrame


def pruned_search(queries: DataFrame, index: CellIndex, k: int = X.TOP_K_VIEW, floor: float | None = X.SCORE_FLOOR, code_col: str | None = None) -> Found:
    """The same hits as ``similarity_hits``. ``queries``: query_id, vector, and where given the code column (null: no restriction)."""
    asked = queries.filter("vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector"), (F.lit(None) if code_col is None else F.col(code_col)).cast("string").alias("code"))
    asked = cut_lineage(asked)
    bounds = _bounds(asked, index)
    if floor is not None:
        bounds = bounds.filter(F.col("bound") >= floor - _SLACK)
    best = Window.partitionBy("query_id", "view").orderBy(F.desc("bound"), "block")
    bounds = cut_lineage(bounds.withColumn("before", F.coalesce(F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    first = cut_lineage(_score(bounds.filter(F.col("before") < k), asked, index, k, floor))
    placed = first.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "view").orderBy(F.desc("score"), "id")))
    bar = placed.filter(F.col("r") == k).select("query_id", "view", F.col("score").alias("bar"))
    more = bounds.filter(F.col("before") >= k).join(bar, ["query_id", "view"], "left").filter("bar is null or bound >= bar - 2e-9").drop("bar")
    more = cut_lineage(more)
    hits = top_per_key(first.unionByName(_score(more, asked, index, k, floor)), ["query_id", "view"], [F.desc("score"), F.asc("id")], k)
    scored = bounds.filter(F.col("before") < k).select("query_id", "view", "n").unionByName(more.select("query_id", "view", "n"))
    sizes = index.blocks(queries.sparkSession).groupBy("view", "code").agg(F.sum("n").alias("m")).withColumnRenamed("code", "held")
    total = asked.join(sizes, asked.code.isNull() | (asked.code == sizes.held)).groupBy("query_id", "view").agg(F.sum("m").alias("all_vectors"))
    read = total.join(scored.groupBy("query_id", "view").agg(F.sum("n").alias("scored")), ["query_id", "view"], "left").select("query_id", "view", F.coalesce("scored", F.lit(0)).alias("scored"), "all_vectors")
    return Found(hits.withColumnRenamed("id", index.id_col), read)


def zone_search(queries: DataFrame, index: CellIndex, k: int = X.TOP_K_SERVICE, code: str = "ordinance_code", fallback_vector: str | None = None) -> DataFrame:
    """Hits in the zone of each query; only the queries without any are searched again, in the whole collection, by the plain question."""
    alt = fallback_vector or "vector"
    wanted = F.when(F.coalesce(F.col(code), F.lit("")) == "", F.lit(None)).otherwise(FE.alias_ordinance(code))
    q = cut_lineage(queries.select("query_id", "vector", F.col(alt).alias("_alt"), wanted.alias("_code")))
    fused = lambda d: V.rerank(V.rank_fusion(d, index.id_col), k, id_col=index.id_col)
    first = cut_lineage(fused(pruned_search(q, index, code_col="_code").hits))
    rest = q.join(first.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.col("_alt").alias("vector"))
    return first.withColumn("used_fallback", F.lit(False)).unionByName(fused(pruned_search(rest, index).hits).withColumn("used_fallback", F.lit(True)))
