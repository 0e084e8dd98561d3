"""Ordered operators that survive a group holding a large share of all rows.

A window over ``PARTITION BY key ORDER BY pos`` puts a whole group into one task. Here the positions of a
group are cut into blocks of ``width`` values; the window runs per (key, block), one summary row per
block carries the state across block borders, and the two are joined back. Blocks depend only on the
position value, so recomputed tasks after an executor loss give the same rows. The plan is the same for every
input, and no job runs while it is built. Joins need no such help: Spark's adaptive skew join splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536


def _blocked(df: DataFrame, pos: str, width: int) -> DataFrame:
    return df.withColumn("_blk", F.floor(F.col(pos) / F.lit(width)).cast("long"))


def carry_last(df: DataFrame, keys: list[str], pos: str, cols: list[str], width: int = BLOCK, inclusive: bool = False) -> DataFrame:
    """Replace each of ``cols`` by its last non-null value before (or at) the row, per key."""
    frame = (Window.unboundedPreceding, 0 if inclusive else -1)
    d = _blocked(df, pos, width)
    local = Window.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(*frame)
    summary = d.groupBy(*keys, "_blk").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(pos))).alias(c) for c in cols])
    across = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(*keys, "_blk", *[F.last(c, ignorenulls=True).over(across).alias("_in_" + c) for c in cols])
    out = d.select(*[c for c in d.columns if c not in cols],
                   *[F.last(c, ignorenulls=True).over(local).alias("_lo_" + c) for c in cols])
    out = out.join(carried, [*keys, "_blk"], "left")
    return out.select(*[F.coalesce("_lo_" + c, "_in_" + c).alias(c) if c in cols else F.col(c) for c in df.columns])


def running_sum(df: DataFrame, keys: list[str], pos: str, value: Column, name: str, width: int = BLOCK) -> DataFrame:
    """Sum of ``value`` over all rows up to and including this one, per key."""
    d = _blocked(df.withColumn("_v", value.cast("long")), pos, width)
    local = Window.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = d.groupBy(*keys, "_blk").agg(F.sum("_v").alias("_t")).select(
        *keys, "_blk", F.coalesce(F.sum("_t").over(across), F.lit(0)).alias("_off"))
    out = d.withColumn("_lo", F.sum("_v").over(local)).join(offsets, [*keys, "_blk"], "left")
    return out.select(*df.columns, (F.col("_lo") + F.coalesce("_off", F.lit(0))).cast("long").alias(name))


def row_numbers(df: DataFrame, keys: list[str], pos: str, name: str = "row_no", width: int = BLOCK) -> DataFrame:
    """1-based row number per key; ``pos`` is unique within a key."""
    return running_sum(df, keys, pos, F.lit(1), name, width)


def neighbour(df: DataFrame, keys: list[str], pos: str, cols: dict[str, str], step: int = 1,
              width: int = BLOCK) -> DataFrame:
    """Add the values of the next (``step=1``) or previous (``step=-1``) row of the same key; NULL at the ends."""
    assert step in (1, -1)
    d = _blocked(df, pos, width).withColumn("_s", F.struct(*cols))
    local = Window.partitionBy(*keys, "_blk").orderBy(pos)
    edge = (F.min_by if step == 1 else F.max_by)("_s", F.col(pos)).alias("_e")
    across = Window.partitionBy(*keys).orderBy("_blk")
    edges = d.groupBy(*keys, "_blk").agg(edge).select(*keys, "_blk", F.lead("_e", step).over(across).alias("_far"))
    out = d.withColumn("_near", F.lead("_s", step).over(local)).join(edges, [*keys, "_blk"], "left")
    pick = F.coalesce("_near", "_far")
    return out.select(*df.columns, *[pick[c].alias(name) for c, name in cols.items()])


def preceding(df: DataFrame, keys: list[str], pos: str, value: Column, n: int, name: str,
              width: int = BLOCK) -> DataFrame:
    """Array of ``value`` over the ``n`` rows before this one, oldest first, per key."""
    d = _blocked(df.withColumn("_v", value), pos, width)
    local = Window.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(-n, -1)
    newest = Window.partitionBy(*keys, "_blk").orderBy(F.desc(pos))
    tails = (
        d.select(*keys, "_blk", pos, "_v").withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n)
        .groupBy(*keys, "_blk").agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("_v").alias("v")))).alias("_t"))
    )
    # every block has at least one row, so the n blocks before always hold the n rows before
    across = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(-n, -1)
    before = tails.select(*keys, "_blk", F.transform(
        F.array_sort(F.flatten(F.collect_list("_t").over(across))), lambda s: s["v"]).alias("_prev"))
    out = d.withColumn("_lo", F.collect_list("_v").over(local)).join(before, [*keys, "_blk"], "left")
    both = F.concat(F.coalesce("_prev", F.array().cast(out.schema["_lo"].dataType)), F.col("_lo"))
    return out.select(*df.columns, F.slice(both, F.greatest(F.size(both) - n + 1, F.lit(1)), n).alias(name))


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """First row per key (W8); partial aggregation keeps one candidate per key and task."""
    return _edge_by(F.min_by, df, keys, order)


def last_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Last row per key."""
    return _edge_by(F.max_by, df, keys, order)


def _edge_by(fn, df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o.alias(f"_o{i}") for i, o in enumerate(order)])
    out = df.groupBy(*keys).agg(fn(F.struct(*rest), rank).alias("_row"))
    return out.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """At most ``k`` rows per key (W7); Spark cuts each task's share to ``k`` before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
