"""Batches by count or idle time for each source of a stream, with ``transformWithState`` and timers.

Rows of a source are held in state until ``most`` are there, or until no row of the source has come for ``idle_seconds``; then
they leave as one flush with a number. State and timers are in the query's checkpoint: a restart goes on with what was held, and a
flush whose write failed is made again with the same rows and the same number, as the micro-batch runs again from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Flush(StatefulProcessor):
    def __init__(self, columns: list[str], schema: T.StructType, key: str, most: int, idle_ms: int):
        self.columns, self.schema, self.key, self.most, self.idle_ms = columns, schema, key, most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)
        self.count = handle.getValueState("count", "held int, flushes long")

    def _out(self, rows: list[tuple], number: int, reason: str) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=self.columns)
        out.insert(0, "flush", number)
        out.insert(1, "reason", reason)
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, flushes = self.count.get() if self.count.exists() else (0, 0)
        kept = list(map(tuple, self.held.get())) if held else []
        for part in rows:
            kept += list(part[self.columns].itertuples(index=False, name=None))
            while len(kept) >= self.most:
                yield self._out(kept[: self.most], flushes, "count")
                kept, flushes = kept[self.most:], flushes + 1
        self._keep(kept, flushes)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if kept:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, flushes = self.count.get() if self.count.exists() else (0, 0)
        if held:
            rows = list(map(tuple, self.held.get()))
            self._keep([], flushes + 1)
            yield self._out(rows, flushes, "idle")

    def _keep(self, rows: list[tuple], flushes: int) -> None:
        if rows:
            self.held.put(rows)
        else:
            self.held.clear()
        self.count.update((len(rows), flushes))

    def close(self) -> None:
        pass


def flushes(stream: DataFrame, source_col: str = "source", most: int = 10, idle_seconds: float = 1.0) -> DataFrame:
    """The rows with ``flush`` (number within the source) and ``reason`` (count or idle), as they leave."""
    schema = stream.schema
    out = T.StructType([T.StructField("flush", T.LongType()), T.StructField("reason", T.StringType()), *schema.fields])
    return stream.groupBy(source_col).transformWithStateInPandas(
        _Flush(stream.columns, schema, source_col, most, int(idle_seconds * 1000)), outputStructType=out, outputMode="Append", timeMode="ProcessingTime")


def flush_stream(stream: DataFrame, write: Callable[[DataFrame], None], checkpoint: str, source_col: str = "source", most: int = 10,
                 idle_seconds: float = 1.0, trigger_seconds: float = 0.5) -> StreamingQuery:
    """M1: writes the flushes of all sources that became due in a micro-batch; ``write`` must bear the same rows again after a failure, as
    ``jobs.index_batch`` does, which replaces by key and marks last.

    The session's state store must be RocksDB (``STATE_STORE`` in ``spark.sql.streaming.stateStore.providerClass``).
    """
    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            write(df)

    due = flushes(stream, source_col, most, idle_seconds)
    return due.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=f"{trigger_seconds} seconds").start()
