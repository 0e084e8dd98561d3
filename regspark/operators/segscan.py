"""Running values along ordered groups, in one pass over ranges of rows.

Rows are put into ranges of (keys, position), so a group of any size is spread over as many tasks as it needs, and positions may lie any
distance apart: only their order counts. Each range is read in one Arrow pass that starts as if nothing stood before it. A second pass
gives one edge row for each range (its last group so far), the edges are carried on in order, and the rows of a range's first group take up
what the ranges before leave them. Edges are as many as ranges, each with at most ``n`` values a column, whatever the number of rows.

The input is evaluated once (``cut_lineage``); sampling the bounds and both passes read what was written. Both passes share one exchange
with one number of ranges, which grows with the rows, so they see the same rows in a range, also after a lost executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark.session import cut_lineage

RANGE_ROWS = 20_000  # a range holds about so many rows, so what a task sorts does not grow with the input


def _differs(col: pa.Array, before: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before; null equals null."""
    values = pc.fill_null(pc.not_equal(col, before), False).to_numpy(zero_copy_only=False)
    return values | pc.not_equal(col.is_null(), before.is_null()).to_numpy(zero_copy_only=False)


class _Pass:
    """State of one range while its batches go by. ``tails``: column and count; ``sums``: columns; ``run``: column or None."""

    def __init__(self, keys: list[str], tails: dict[str, int], sums: list[str], run: str | None):
        self.keys, self.tails, self.sums, self.run = keys, tails, sums, run
        self.last: dict[str, pa.Array] | None = None  # values of the row before
        self.first: dict | None = None  # keys and run value of the range's first row
        self.seen_group = self.seen_run = False  # a second group, a second run of the first group
        self.total = dict.fromkeys(sums, 0)
        self.runs = 0
        self.tail: dict[str, pa.Array] = {}

    def step(self, b: pa.RecordBatch) -> dict[str, pa.Array]:
        n = b.num_rows
        watched = [*self.keys, *([self.run] if self.run else [])]
        if self.last is None:
            self.last = {c: b.column(c).slice(0, 1) for c in watched}
            self.first = {c: b.column(c)[0].as_py() for c in watched}
            self.tail = {c: b.column(c).slice(0, 0) for c in self.tails}
        before = {c: pa.concat_arrays([self.last[c], b.column(c).slice(0, n - 1)]) for c in watched}
        new = np.zeros(n, bool)
        for k in self.keys:
            new |= _differs(b.column(k), before[k])
        cut = np.zeros(n, bool)
        if self.run:  # a run ends between two known, different values
            cut = pc.fill_null(pc.not_equal(b.column(self.run), before[self.run]), False).to_numpy(zero_copy_only=False) & ~new
        at = np.arange(n)
        group = np.maximum.accumulate(np.where(new, at, -1))
        start = np.maximum.accumulate(np.where(new | cut, at, -1))
        in_first = (group < 0) & (not self.seen_group)
        out = {"_first": pa.array(in_first), "_first_run": pa.array(in_first & (start < 0) & (not self.seen_run))}

        def since_start(values: np.ndarray, open_total: int) -> np.ndarray:
            run = np.cumsum(values)
            return np.where(group < 0, run + open_total, run - np.where(group < 0, 0, (run - values)[group]))

        if self.run:
            runs = since_start(cut.astype(np.int64), self.runs)
            out["_runs"], self.runs = pa.array(runs), int(runs[-1])
        for c in self.sums:
            sums = since_start(pc.fill_null(b.column(c), 0).to_numpy(zero_copy_only=False).astype(np.int64), self.total[c])
            out[c], self.total[c] = pa.array(sums), int(sums[-1])
        for c, size in self.tails.items():
            m = len(self.tail[c])
            values = pa.concat_arrays([self.tail[c], b.column(c)])
            low = np.maximum(np.where(start < 0, 0, start + m), at + m - size)
            count = at + m - low
            offsets = np.concatenate([[0], np.cumsum(count)])
            places = np.repeat(low - offsets[:-1], count) + np.arange(offsets[-1])
            out[c] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values.take(pa.array(places)))
            keep = max(m + start[-1] if start[-1] >= 0 else 0, m + n - size)
            self.tail[c] = values.slice(keep)
        self.last = {c: b.column(c).slice(n - 1, 1) for c in watched}
        self.seen_group |= bool(new.any())
        self.seen_run |= bool((new | cut).any())
        return out


def _carry(edges: list[dict], tails: dict[str, int], sums: list[str], run: str | None) -> list[dict]:
    """What the ranges before leave to each range, for those whose first row goes on with the group before. ``edges``: in order."""
    out, open_ = [], None
    for e in edges:
        goes_on = open_ is not None and open_["last_keys"] == e["first_keys"]
        step = 0
        if goes_on:
            step = int(run is not None and None not in (open_["last_run"], e["first_run"]) and open_["last_run"] != e["first_run"])
            given = {c: [] if step else open_[c] for c in tails}
            out.append({"_part": e["_part"], "_runs": open_["_runs"] + step, **{c: open_[c] for c in sums}, **given})
        if goes_on and not e["seen_group"]:
            e = {**e, "_runs": open_["_runs"] + step + e["_runs"], **{c: open_[c] + e[c] for c in sums}}
            if not e["seen_run"]:
                e = {**e, **{c: (given[c] + e[c])[-n:] for c, n in tails.items()}}
        open_ = e
    return out


def scan(df: DataFrame, keys: list[str], pos: str, tails: dict[str, tuple[Column, int]] | None = None,
         sums: dict[str, Column] | None = None, run: tuple[str, Column] | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with values that run along the rows of each key in the order of ``pos``.

    ``tails``: name -> (value, n), the array of the ``n`` values before the row, oldest first. ``sums``: name -> long, sum up to and with
    the row; nulls add nothing. ``run``: (name, value), the number from 0 of the run, which goes up where two neighbours hold known,
    different values; with it, tails hold only rows of the same run. Rows that are equal in keys and position stand in any order, so
    positions should be unique. Null keys are one group, null positions come first; an empty input gives no row. New names must be free.
    """
    tails, sums = tails or {}, sums or {}
    names = [*sums, *([run[0]] if run else []), *tails]
    if set(names) & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(set(names) & set(df.columns))}")
    helper = {n: f"_v{i}" for i, n in enumerate(names)}
    values = {**{n: c.cast("long") for n, c in sums.items()}, **({run[0]: run[1]} if run else {}), **{n: c for n, (c, _) in tails.items()}}
    held = cut_lineage(df.select("*", *[values[n].alias(helper[n]) for n in names]))
    ranges = ranges or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), held.count() // RANGE_ROWS + 1)
    placed = held.repartitionByRange(ranges, *keys, pos).sortWithinPartitions(*keys, pos).withColumn("_part", F.spark_partition_id())
    sized = {helper[n]: k for n, (_, k) in tails.items()}
    added, watched = [helper[n] for n in sums], helper[run[0]] if run else None
    of = {f.name: f.dataType for f in held.schema}
    lists = [T.StructField(c, T.ArrayType(of[c])) for c in sized]
    longs = [T.StructField(c, T.LongType()) for c in [*(["_runs"] if run else []), *added]]
    flags = [T.StructField(c, T.BooleanType()) for c in ("_first", "_first_run")]
    kept = [f for f in placed.schema if f.name in df.columns or f.name == "_part"]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _Pass(keys, sized, added, watched)
        for b in batches:
            if b.num_rows:
                new = p.step(b)
                cols = {**{f.name: b.column(f.name) for f in kept}, **{f.name: new[f.name] for f in [*flags, *longs, *lists]}}
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    of_keys = T.StructType([T.StructField(k, of[k]) for k in keys])
    of_run = [T.StructField(c, of[watched]) for c in ("first_run", "last_run")] if run else []
    edge_type = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("first_keys", of_keys), T.StructField("last_keys", of_keys), *of_run,
                              *[T.StructField(c, T.BooleanType()) for c in ("seen_group", "seen_run")], *longs, *lists])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, part, kind = _Pass(keys, sized, added, watched), None, {}
        for b in batches:
            if b.num_rows:
                p.step(b)
                part = b.column("_part")[0]
                kind = {f.name: f.type for f in b.schema}
        if part is None:
            return
        struct = pa.struct([(k, kind[k]) for k in keys])
        row = {"_part": pa.array([part.as_py()], pa.int32()), "first_keys": pa.array([{k: p.first[k] for k in keys}], struct),
               "last_keys": pa.array([{k: p.last[k][0].as_py() for k in keys}], struct)}
        if watched:
            row |= {"first_run": pa.array([p.first[watched]], kind[watched]), "last_run": p.last[watched]}
        row |= {"seen_group": pa.array([p.seen_group]), "seen_run": pa.array([p.seen_run])}
        row |= {"_runs": pa.array([p.runs], pa.int64())} if watched else {}
        row |= {c: pa.array([p.total[c]], pa.int64()) for c in added}
        row |= {c: pa.ListArray.from_arrays(pa.array([0, len(p.tail[c])], pa.int32()), p.tail[c]) for c in sized}
        yield pa.RecordBatch.from_arrays(list(row.values()), names=list(row))

    carry_type = T.StructType([edge_type["_part"], *longs, *lists])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        left = _carry(sorted(table.to_pylist(), key=lambda e: e["_part"]) if watched else
                      [{**e, "_runs": 0} for e in sorted(table.to_pylist(), key=lambda e: e["_part"])], sized, added, watched)
        cols = {f.name: pa.array([r[f.name] for r in left], table.schema.field(f.name).type) for f in carry_type}
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    # one row a range, so the carrying task and the broadcast are as large as the number of ranges
    given = placed.mapInArrow(edges, edge_type).coalesce(1).mapInArrow(carry, carry_type)
    given = given.select("_part", *[F.col(f.name).alias("_in" + f.name) for f in [*longs, *lists]])
    rows = placed.mapInArrow(local, T.StructType([*kept, *flags, *longs, *lists])).join(F.broadcast(given), "_part", "left")

    def total(c: str) -> Column:
        return F.col(c) + F.when(F.col("_first"), F.coalesce("_in" + c, F.lit(0))).otherwise(0)

    def tail(c: str, n: int) -> Column:
        both = F.concat("_in" + c, c)
        whole = F.slice(both, F.greatest(F.size(both) - n + 1, F.lit(1)), n)
        return F.when(F.col("_first_run") & F.col("_in" + c).isNotNull() & (F.size(c) < n), whole).otherwise(F.col(c))

    return rows.select(*df.columns, *[total(helper[n]).alias(n) for n in sums], *([total("_runs").alias(run[0])] if run else []),
                       *[tail(helper[n], k).alias(n) for n, (_, k) in tails.items()])
