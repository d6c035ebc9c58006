"""Delete plans and worker plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MODES = ("rename", "recycle_bin", "permanent")
MARK = ".z_dele"


def delete_plan(targets: DataFrame, paths: DataFrame, mode: str) -> DataFrame:
    """file_id, mode, source, target, error of targets(file_id, path); an error leaves the other rows as they are.

    paths(path) are taken: a renamed file gets the mark, or the first number behind it that is free;
    targets of one path (which share it) take numbers in order of file_id.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}, not {mode}")
    number = F.regexp_extract("path", r"\.z_dele(?:\.(\d+))?$", 1)
    base = F.regexp_extract("path", r"^(.*)\.z_dele(?:\.\d+)?$", 1)
    used = paths.select(base.alias("base"), F.when(number == "", F.lit(0)).otherwise(number.try_cast("int")).alias("n")).filter("base <> '' and n is not null")
    used = used.groupBy("base").agg(F.collect_set("n").alias("used"))  # the numbers one file name has had
    nth = F.row_number().over(Window.partitionBy("path").orderBy("file_id"))
    rows = targets.select("file_id", "path").withColumn("nth", nth).join(used, F.col("path") == F.col("base"), "left")
    taken = F.coalesce("used", F.array().cast("array<int>"))
    free = F.array_except(F.sequence(F.lit(0), F.size(taken) + F.col("nth")), taken)
    spare = F.try_element_at(F.array_sort(free), F.col("nth"))
    renamed = F.concat("path", F.lit(MARK), F.when(spare == 0, "").otherwise(F.concat(F.lit("."), spare.cast("string"))))
    bad = F.col("file_id").isNull() | (F.col("file_id") <= 0)
    target = F.when(~bad & (F.lit(mode) == "rename"), renamed)
    error = F.when(bad, "Delete target is missing a valid file_id").otherwise("")
    return rows.select("file_id", F.lit(mode).alias("mode"), F.col("path").alias("source"), target.alias("target"), error.alias("error"))


def worker_plan(roots: DataFrame, max_workers: int) -> DataFrame:
    """lane, roots, cap (least override, 1 at least), requested and effective workers of roots(lane, override)."""
    lanes = roots.groupBy("lane").agg(F.count("*").alias("roots"), F.greatest(F.lit(1), F.coalesce(F.min("override"), F.lit(1))).alias("cap"))
    total = lanes.agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("effective"))  # one row
    return lanes.join(F.broadcast(total)).withColumn("requested", F.greatest(F.lit(max_workers), F.col("effective")))
