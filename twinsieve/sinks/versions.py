"""Tables that change as a whole: new data folders are written, then one log entry makes them current.

A catalogue holds tables in buckets of one of their columns. A transaction reads the newest version,
rewrites only the buckets its changes touch, and commits by creating the log entry of the next
version, which exists completely or not at all; several tables change together. Two transactions on
one version conflict: the later commit raises, and is run again. A transaction that fails leaves
folders that nothing names; `vacuum` removes them. Earlier versions stay readable until then.

A log entry is written aside and renamed into its place, which a store must refuse where a file is
there already (HDFS does so atomically).
Rows of one bucket are shuffled by a rebalance, which can split a hot one. A table's metadata is a few bytes a
bucket, whatever its rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16


class Conflict(RuntimeError):
    """Another transaction has committed this version."""


class _Store:
    """Files of a folder through Spark's own file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway, self.root = spark._jvm, spark.sparkContext._gateway, root.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def create(self, name: str, text: str) -> None:
        """Appears with its content, or raises Conflict where it is there already."""
        whole, there = self.path(f"_log/.{uuid.uuid4().hex}"), self.path(name)
        out = self.fs.create(whole, False)
        out.write(bytearray(text.encode()))
        out.close()
        options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)  # none: not over a file that is there
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(there.toUri(), self.conf).rename(whole, there, options)
        except Exception as e:
            self.fs.delete(whole, False)
            if self.fs.exists(there):
                raise Conflict(name) from e
            raise

    def text(self, name: str) -> str:
        p = self.path(name)
        stream = self.fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Catalogue:
    """Tables under one folder, versioned together."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.store, self.buckets = spark, _Store(spark, path), buckets

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.store.names("_log") if n.endswith(".json") and n[:-5].isdigit()]

    def state(self, version: int | None = None) -> tuple[int, dict]:
        """The number and the tables of a version, the newest by default; 0 and none of an empty catalogue."""
        version = max(self.versions(), default=0) if version is None else version
        return version, json.loads(self.store.text(f"_log/{version:012d}.json")) if version else {}

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self._rows(self.state(version)[1][name])

    def begin(self) -> Transaction:
        return Transaction(self, *self.state())

    def vacuum(self, keep: int = 1) -> int:
        """Remove data that none of the newest `keep` versions names, and older log entries; returns how many folders went."""
        found = self.versions()
        kept, gone = found[-keep:], found[:-keep]
        named = {f for v in kept for t in self.state(v)[1].values() for f in t["parts"].values()}
        for v in gone:
            self.store.remove(f"_log/{v:012d}.json")
        folders = [f for f in self.store.names("data") if f not in named]
        for f in folders:
            self.store.remove(f"data/{f}")
        return len(folders)

    def _rows(self, table: dict, parts: Iterable[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(table["schema"])
        held = [f"{self.store.root}/data/{f}/_part={p}" for p, f in table["parts"].items() if parts is None or p in parts]
        held = [h for h in held if self.store.fs.exists(self.store.jvm.org.apache.hadoop.fs.Path(h))]  # a bucket may be empty
        return self.spark.read.schema(schema).parquet(*held) if held else self.spark.createDataFrame([], schema)

    def _part(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets))


class Transaction:
    """Changes on top of one version; `read` shows them, `commit` makes them current."""

    def __init__(self, catalogue: Catalogue, version: int, tables: dict):
        self.of, self.version, self.tables = catalogue, version, json.loads(json.dumps(tables))

    def read(self, name: str) -> DataFrame:
        return self.of._rows(self.tables[name])

    def create(self, name: str, rows: DataFrame, by: str) -> None:
        """A new table, or all rows of an old one anew, in buckets of column `by`."""
        self.tables[name] = {"schema": rows.schema.jsonValue(), "by": by, "parts": {}}
        self._write(name, rows, map(str, range(self.of.buckets)))

    def _touched(self, name: str, rows: DataFrame) -> set[str]:
        by = self.tables[name]["by"]
        if by not in rows.columns:
            return set(map(str, range(self.of.buckets)))
        return {str(r[0]) for r in rows.select(self.of._part(by)).distinct().collect()}  # a row a bucket

    def _write(self, name: str, rows: DataFrame, parts: Iterable[str]) -> None:
        table, folder = self.tables[name], uuid.uuid4().hex
        rows = rows.select(*T.StructType.fromJson(table["schema"]).fieldNames(), self.of._part(table["by"]).alias("_part"))
        rows.hint("rebalance", "_part").write.option("compression", "zstd").partitionBy("_part").parquet(f"{self.of.store.root}/data/{folder}")
        table["parts"].update(dict.fromkeys(parts, folder))

    def upsert(self, name: str, new: DataFrame, keys: list[str], update: list[str] | None = None) -> None:
        """Rows of new are added; where a key is there already, its `update` columns (all of new's by default) are set and the others stay.

        new has one row a key. A null in a key equals nothing, so such rows are added. Columns that new lacks are null in added rows.
        """
        table = self.tables[name]
        parts = self._touched(name, new)
        sets = set(new.columns if update is None else update) - set(keys)
        o = self.of._rows(table, parts).withColumn("_o", F.lit(True)).alias("o")
        n = new.withColumn("_n", F.lit(True)).alias("n")
        on = F.lit(True)
        for k in keys:
            on = on & (F.col(f"o.{k}") == F.col(f"n.{k}"))

        def column(f: T.StructField):
            old = F.col(f"o.{f.name}")
            if f.name not in new.columns:
                return old.alias(f.name)
            fresh = F.col(f"n.{f.name}").cast(f.dataType)
            takes_new = F.col("_o").isNull() | (F.col("_n").isNotNull() if f.name in sets else F.lit(False))
            return F.when(takes_new, fresh).otherwise(old).alias(f.name)

        self._write(name, o.join(n, on, "full_outer").select(*[column(f) for f in T.StructType.fromJson(table["schema"])]), parts)

    def delete(self, name: str, gone: DataFrame, keys: list[str]) -> None:
        """Rows whose key is among gone's leave."""
        parts = self._touched(name, gone.select(*keys))
        self._write(name, self.of._rows(self.tables[name], parts).join(gone.select(*keys).distinct(), keys, "left_anti"), parts)

    def commit(self) -> int:
        self.of.store.create(f"_log/{self.version + 1:012d}.json", json.dumps(self.tables))
        return self.version + 1
