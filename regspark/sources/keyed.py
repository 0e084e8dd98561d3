"""A table with one current row a key: bucketed base and delta folders behind a pointer that is replaced in one step.

Layout of a store::

    <path>/data/<name>/bucket=<n>/…   rows whose key hashes to the bucket; a base, or the rows of one merge
    <path>/pointer/<generation>.json  which folders count, in order

A merge writes its own folder and then the next pointer; nothing that a reader may hold is changed. The pointer file is
written under another name and renamed to its number, which fails if another writer was first, so the highest number is always whole. A
merge that names its ``writer`` and number is applied once: a micro-batch that runs again finds its number in the pointer.

A row of a later folder replaces an earlier one of its key, or the one with the larger ``version`` columns where the store
has any. Removed keys are rows that say so, until a compaction. ``read`` for some keys reads the buckets of these keys only. ``compact`` writes
a new base from all folders; ``vacuum`` deletes folders that no recent pointer names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark.operators.ordered import last_by


class Conflict(RuntimeError):
    """Another writer replaced the pointer first."""


@dataclass(frozen=True)
class Pointer:
    generation: int = 0
    folders: tuple[str, ...] = ()
    applied: dict = field(default_factory=dict)
    schema: T.StructType | None = None


class KeyedStore:
    """``schema`` is what an empty store has; a merge adds the columns that are new to it."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, key: str = "chunk_id", version: tuple[str, ...] = (), buckets: int = 16, compact_after: int = 20):
        self.spark, self.path, self.key, self.version, self.buckets, self.compact_after = spark, path.rstrip("/"), key, tuple(version), buckets, compact_after
        self.empty = spark.createDataFrame([], schema).schema

    # ---------------------------------------------------------------- pointer

    def _files(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _generations(self) -> list[int]:
        fs, folder = self._files("pointer")
        if not fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def _pointer(self, generation: int) -> Pointer:
        fs, p = self._files(f"pointer/{generation:012d}.json")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        d = json.loads(text)
        return Pointer(generation, tuple(d["folders"]), d["applied"], T.StructType.fromJson(d["schema"]))

    def pointer(self) -> Pointer:
        known = self._generations()
        return self._pointer(known[-1]) if known else Pointer(schema=self.empty)

    def _commit(self, seen: Pointer, folders: tuple[str, ...], applied: dict, schema: T.StructType) -> None:
        fs, target = self._files(f"pointer/{seen.generation + 1:012d}.json")
        _, draft = self._files(f"pointer/.{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps({"folders": list(folders), "applied": applied, "schema": schema.jsonValue()}).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise Conflict(f"{self.path} has a generation {seen.generation + 1} already")

    # ---------------------------------------------------------------- rows

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, name: str) -> None:
        placed = rows.withColumn("bucket", self._bucket())
        # a bucket is split over several tasks where it is large; its rows have distinct keys
        placed.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", self.key).write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")

    def _rows(self, pointer: Pointer, buckets: list[int] | None = None) -> DataFrame:
        out = None
        schema = T.StructType([*pointer.schema.fields, T.StructField("_removed", T.BooleanType()), T.StructField("bucket", T.IntegerType())])
        for k, name in enumerate(pointer.folders):
            d = self.spark.read.schema(schema).parquet(f"{self.path}/data/{name}")
            d = d if buckets is None else d.filter(F.col("bucket").isin(buckets))
            d = d.withColumn("_age", F.lit(k))
            out = d if out is None else out.union(d)
        return out if out is not None else self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("_age", T.IntegerType())]))

    def merge(self, rows: DataFrame, removed: DataFrame | None = None, writer: str | None = None, number: int | None = None) -> bool:
        """Adds or replaces rows by key; keys of ``removed`` go. Of rows with one key the last by the version columns counts (without any:
        one of them). False, and nothing done, if ``writer`` has applied ``number`` before."""
        seen = self.pointer()
        if writer is not None and seen.applied.get(writer, -1) >= number:
            return False
        had = {f.name: f for f in seen.schema}
        schema = T.StructType([*seen.schema.fields, *[T.StructField(f.name, f.dataType) for f in rows.schema if f.name not in had]])
        fields = [F.col(f"`{f.name}`").cast(had[f.name].dataType if f.name in had else f.dataType).alias(f.name) for f in rows.schema]
        new = rows.select(*fields).filter(F.col(self.key).isNotNull())
        tie = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
        new = last_by(new.withColumn("_tie", tie), [self.key], [*self.version, "_tie"]).drop("_tie").withColumn("_removed", F.lit(False))
        if removed is not None:
            gone = removed.select(self.key).filter(F.col(self.key).isNotNull()).distinct().join(new.select(self.key), self.key, "left_anti")
            new = new.unionByName(gone.withColumn("_removed", F.lit(True)), allowMissingColumns=True)
        name = f"m{seen.generation + 1:012d}-{uuid.uuid4().hex[:8]}"
        self._write(new, name)
        self._commit(seen, (*seen.folders, name), seen.applied | ({writer: number} if writer is not None else {}), schema)
        if len(seen.folders) + 1 > self.compact_after:
            self.compact()
        return True

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """The current rows; with ``keys`` those of its keys, from their buckets only (at most ``buckets`` numbers come to the driver)."""
        pointer = self.pointer()
        if keys is None:
            rows = self._rows(pointer)
        else:
            asked = keys.select(self.key).distinct()
            rows = self._rows(pointer, [r.b for r in asked.select(self._bucket().alias("b")).distinct().collect()]).join(asked, self.key, "left_semi")
        if len(pointer.folders) > 1:
            rows = self._by_version(rows) if self.version else last_by(rows, [self.key], ["_age"])
        return rows.filter(~F.col("_removed")).select(*[f"`{c}`" for c in pointer.schema.names])

    def _by_version(self, rows: DataFrame) -> DataFrame:
        """The largest version since the last removal of the key, or the removal."""
        dropped = rows.filter("_removed").groupBy(self.key).agg(F.max("_age").alias("_gone"))
        live = rows.join(dropped, self.key, "left").filter(F.col("_removed") | F.col("_gone").isNull() | (F.col("_age") > F.col("_gone")))
        return last_by(live.withColumn("_live", ~F.col("_removed")).drop("_gone"), [self.key], ["_live", *self.version, "_age"])

    def compact(self) -> None:
        """One base with the current rows; readers of older pointers are not disturbed."""
        seen = self.pointer()
        if len(seen.folders) < 2:
            return
        name = f"b{seen.generation + 1:012d}-{uuid.uuid4().hex[:8]}"
        self._write(self.read().withColumn("_removed", F.lit(False)), name)
        self._commit(seen, (name,), seen.applied, seen.schema)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes the folders that the last ``keep`` pointers do not name, and older pointers; returns their names. Run it when no reader holds an
        older pointer and no merge is under way."""
        known = self._generations()
        kept = {f for g in known[-keep:] for f in self._pointer(g).folders}
        fs, folder = self._files("data")
        gone = [s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName() not in kept] if fs.exists(folder) else []
        for name in gone:
            fs.delete(self._files(f"data/{name}")[1], True)
        for g in known[:-keep]:
            fs.delete(self._files(f"pointer/{g:012d}.json")[1], False)
        return sorted(gone)
