"""Tables of plain files that are replaced part by part, as versions with pointers.

A part is what has one value of the key columns, such as one snapshot of one source. Its rows in every table are written to new
version folders that nothing reads yet. Then one small pointer file names the version; it is the commit. Readers take the
newest whole pointer of each part and only the rows of the version that it names, so they never see half of a part, and
a part that is rewritten with no rows has none. Pointers are numbered, and a number is created once: of two writers that started from the same
number one fails. A rewrite that would leave rows of other tables without what they refer to is refused before its pointer is
written. Keys of rows are always met by a sort-merge join: compressed they look small enough to broadcast, and the driver would
build their table.

What a failed or refused writer left is read by nobody; `vacuum` deletes it, and versions that have been replaced.
Defined cases: key columns are never null; a part that never was has no pointer and no rows, one that was written empty has
a pointer and counts of zero; rows outside the parts that are replaced are an error; an unfinished pointer does not count.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class WouldOrphan(RuntimeError):
    """A rewrite would leave rows of other tables behind; counts has how many of each."""

    def __init__(self, counts: dict[str, int]):
        super().__init__("rows would be left without what they refer to: " + ", ".join(f"{k} {n}" for k, n in sorted(counts.items()) if n))
        self.counts = counts


class Conflict(RuntimeError):
    """Another writer has replaced the same part meanwhile."""


class Versions:
    """The tables (name to schema) under one path, replaced by the parts that `by` names."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, T.StructType | str], by: tuple[str, ...] = ("source", "snapshot_ts")):
        self.spark, self.path, self.by = spark, path.rstrip("/"), list(by)
        self.tables = {k: v if isinstance(v, T.StructType) else T.StructType.fromDDL(v) for k, v in tables.items()}
        kinds = [{f.name: f.dataType for f in s.fields} for s in self.tables.values()]
        if any(not set(by) <= set(k) for k in kinds):
            raise ValueError(f"every table has the columns {', '.join(by)}")
        self.kinds = {c: kinds[0][c] for c in by}
        for folder in ("pointers", *(f"data/{t}" for t in self.tables)):
            fs, at = self._at(folder)
            fs.mkdirs(at)

    def _at(self, inner: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{inner}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _text(self, c: str) -> Column:
        """A key column as text that does not hang on the session's time zone."""
        return (F.unix_micros(c) if isinstance(self.kinds[c], T.TimestampType) else F.col(c)).cast("string")

    def _reader(self, schema: T.StructType) -> DataFrameReader:
        """A reader whose scans differ from earlier ones of the same folder; else a plan that has both would use one for the
        other, though files came in between."""
        return self.spark.read.schema(schema).option("tideglass.read", uuid.uuid4().hex)

    def pointers(self) -> DataFrame:
        """The newest whole pointer of each part: its key columns, generation, version, rows by table."""
        key = T.StructType([T.StructField(c, T.StringType()) for c in self.by])
        schema = T.StructType([T.StructField("key", key), T.StructField("generation", T.LongType()), T.StructField("version", T.StringType()), T.StructField("rows", T.MapType(T.StringType(), T.LongType())), T.StructField("whole", T.BooleanType())])
        own = self._reader(schema).option("recursiveFileLookup", True).json(f"{self.path}/pointers").where("whole")
        newest = own.groupBy("key").agg(F.max_by(F.struct("generation", "version", "rows"), "generation").alias("p"))
        back = [(F.timestamp_micros(F.col(f"key.{c}").cast("long")) if isinstance(self.kinds[c], T.TimestampType) else F.col(f"key.{c}").cast(self.kinds[c])).alias(c) for c in self.by]
        return newest.select(*back, "p.*")

    def read(self, table: str) -> DataFrame:
        """The committed rows of a table."""
        schema = T.StructType([*self.tables[table].fields, T.StructField("version", T.StringType())])
        own = self._reader(schema).parquet(f"{self.path}/data/{table}")
        return own.join(self.pointers().select(*self.by, "version"), [*self.by, "version"], "left_semi").drop("version")

    def orphans(self, version: str, parts: DataFrame, table: str, key: str, dependants: dict[str, DataFrame], refers: str) -> dict[str, int]:
        """Rows of each dependant that refer to keys of the committed parts which the version no longer has."""
        new = self.spark.read.schema(self.tables[table]).parquet(f"{self.path}/data/{table}/version={version}")
        lost = self.read(table).join(parts, self.by, "left_semi").select(key).join(new.select(key).hint("merge"), key, "left_anti").distinct()
        rows = reduce(DataFrame.unionByName, [d.select(F.lit(name).alias("name"), refers) for name, d in dependants.items()])
        counts = rows.join(lost.withColumnRenamed(key, refers).hint("merge"), refers, "left_semi").groupBy("name").count().collect()
        return dict.fromkeys(dependants, 0) | {r["name"]: r["count"] for r in counts}

    def replace(
        self, parts: DataFrame, frames: dict[str, DataFrame], dependants: dict[str, DataFrame] | None = None, table: str = "", key: str = "id", refers: str = "cluster_id", allow: bool = False,
    ) -> str:
        """Replace all rows of the parts (the key columns, one row each; as many as the driver can hold) by frames; a table
        without a frame has none. dependants refer by `refers` to `key` of `table`; if they would lose it, nothing changes
        unless allowed. The new version's name."""
        parts = parts.select(*self.by).distinct()
        keys = [r.asDict() for r in parts.select(*(self._text(c).alias(c) for c in self.by)).collect()]
        if any(v is None for k in keys for v in k.values()):
            raise ValueError("a part's key is never null")
        before = [self._last(k) for k in keys]
        version = uuid.uuid4().hex
        rows: dict[tuple, dict[str, int]] = {tuple(k.values()): dict.fromkeys(self.tables, 0) for k in keys}
        for name, schema in self.tables.items():
            at = f"{self.path}/data/{name}/version={version}"
            frame = frames[name].select(*schema.names) if name in frames else self.spark.createDataFrame([], schema)
            frame.select(*(F.col(f.name).cast(f.dataType) for f in schema.fields)).write.parquet(at)
            written = self.spark.read.schema(schema).parquet(at)
            for r in written.groupBy(*(self._text(c).alias(c) for c in self.by)).count().collect():
                own = tuple(r[c] for c in self.by)
                if own not in rows:
                    self._drop(version)
                    raise ValueError(f"{name} has rows of a part that is not replaced: {own}")
                rows[own][name] = r["count"]
        if dependants and not allow:
            counts = self.orphans(version, parts, table, key, dependants, refers)
            if any(counts.values()):
                self._drop(version)
                raise WouldOrphan(counts)
        for k, last in zip(keys, before, strict=True):
            self._point({"key": k, "generation": last + 1, "version": version, "rows": rows[tuple(k.values())], "whole": True})
        return version

    def _folder(self, key: dict) -> str:
        return "pointers/" + hashlib.sha1(json.dumps(key, sort_keys=True).encode()).hexdigest()

    def _last(self, key: dict) -> int:
        """The number of a part's last pointer, whole or not; -1 without any."""
        fs, at = self._at(self._folder(key))
        return max((int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(at)), default=-1) if fs.exists(at) else -1

    def _point(self, pointer: dict) -> None:
        fs, at = self._at(f"{self._folder(pointer['key'])}/{pointer['generation']:012d}.json")
        try:
            out = fs.create(at, False)
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                raise Conflict(str(pointer["key"])) from e
            raise
        out.write(json.dumps(pointer).encode())
        out.close()

    def _drop(self, version: str) -> None:
        for name in self.tables:
            fs, at = self._at(f"data/{name}/version={version}")
            fs.delete(at, True)

    def vacuum(self, older_than: float = 86_400) -> list[str]:
        """Delete versions that no part points at and that are older than so many seconds, which is longer than any reader
        or writer takes; their names."""
        now, live, gone = time.time(), {r.version for r in self.pointers().select("version").distinct().collect()}, []
        for name in self.tables:
            fs, at = self._at(f"data/{name}")
            for s in fs.listStatus(at):
                version = s.getPath().getName().removeprefix("version=")
                if version not in live and now - s.getModificationTime() / 1000 >= older_than:
                    fs.delete(s.getPath(), True)
                    gone.append(version)
        return sorted(set(gone))

    def kept(self, dependant: DataFrame, table: str, key: str = "id", refers: str = "cluster_id") -> DataFrame:
        """The rows of a dependant whose key is still there, after an allowed rewrite."""
        return dependant.join(self.read(table).select(F.col(key).alias(refers)).hint("merge"), refers, "left_semi")
