"""Session helpers: shared scratch tables that cut lineage, and bounded prefilters."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the bitmap of `maybe_in`: 2^18 longs, 2 MB of bits, whatever the input.
BITMAP_BITS = 24


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in spark.checkpoint.dir.

    Only where that is unset and the master is local (tests, a laptop) a local folder is made and
    set; on a cluster executors could not see it, so an unset folder is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="twinsieve-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{scratch_root(spark)}/twinsieve/{label}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(jvm_path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


class Scratch:
    """Tables written to the shared folder; `drop` removes those that are not read any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def cut(self, df: DataFrame, label: str, release: bool = False) -> DataFrame:
        """Write df as a table and read it back: later plans start from files, not from lineage.

        release: the shuffle files behind the table are large and nothing reads them again; a
        collection of the driver's garbage lets Spark's cleaner remove them now.
        """
        path = scratch_path(self.spark, label)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        if release:
            del df
            gc.collect()
            self.spark._jvm.System.gc()
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _, path = self.paths.pop(id(t), (None, None))
            if path:
                drop_path(self.spark, path)


def row_key() -> Column:
    """Tells rows of equal or null doc_id apart by their texts; only exact repeats share it."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def has_rows(df: DataFrame) -> bool:
    return bool(df.take(1))


def maybe_in(df: DataFrame, key: str, ids: DataFrame, id_col: str, bits: int = BITMAP_BITS) -> DataFrame:
    """Rows of df whose key may be among ids: none that is gets lost, a few others pass.

    A one-hash Bloom filter of 2^bits bits, built by a grouped bit_or. The broadcast side has at
    most 2^(bits-6) rows of two longs, however many ids there are, so it is a safe prefilter in
    front of a join that would otherwise shuffle wide rows.
    """
    slot = lambda c: F.xxhash64(F.lit(7), c)
    word = lambda c: F.shiftrightunsigned(slot(c), 64 - bits + 6).cast("int")
    bit = lambda c: slot(c).bitwiseAND(F.lit(63)).cast("int")
    words = ids.groupBy(word(F.col(id_col)).alias("_word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col(id_col)))).alias("_bits")
    )
    hit = F.call_function("shiftrightunsigned", F.col("_bits"), bit(F.col(key))).bitwiseAND(F.lit(1)) == 1
    return df.withColumn("_word", word(F.col(key))).join(F.broadcast(words), "_word").filter(hit).drop("_word", "_bits")
