"""Numbers over a whole order, and orders of dispatch, without a task that holds all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch


def numbered(df: DataFrame, *order: Column | str, name: str = "position", start: int = 1) -> DataFrame:
    """df with each row's place in the order, from start.

    Rows are sorted by ranges of the order and written once; the counts of the ranges (one number
    each) are added up and put in front of the places within them. End the order with what tells
    rows apart: rows equal in all of it lie in one range, and their places are any.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = Scratch(spark).cut(placed, "numbered").withColumn("_range", F.shiftright("_at", 33))
    counts = sorted((r["_range"], r["n"]) for r in rows.groupBy("_range").agg(F.count("*").alias("n")).collect())  # a row a range
    before = accumulate((n for _, n in counts), initial=start)
    offsets = spark.createDataFrame([(k, b) for (k, _), b in zip(counts, before, strict=False)], "_range long, _before long")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(offsets), "_range").withColumn(name, place).drop("_range", "_at", "_before")


def turns(files: DataFrame, lane: str, order: list, cap: str | None = None) -> DataFrame:
    """files with in_lane (from 1) and turn: in every turn a lane gives as many files as its cap (a column, 1 by default), in order."""
    w = Window.partitionBy(lane).orderBy(*order)  # a lane is one drive: its files are read one after another anyway
    held = F.greatest(F.lit(1), F.coalesce(F.col(cap), F.lit(1))) if cap else F.lit(1)
    rows = files.withColumn("in_lane", F.row_number().over(w))
    return rows.withColumn("turn", F.floor((F.col("in_lane") - 1) / held))


def dispatch_order(files: DataFrame, lane: str, order: list, cap: str | None = None) -> DataFrame:
    """files in the order a round-robin dispatcher takes them: turn by turn, lane by lane."""
    return numbered(turns(files, lane, order, cap), "turn", lane, "in_lane", name="dispatched", start=0)


def lane_tasks(files: DataFrame, lane: str, order: list, caps: DataFrame, default: int = 1) -> DataFrame:
    """files dealt so that each lane has tasks of its own, as many as its cap(lane, cap) says; task tells which.

    A task reads one drive only, and no more tasks than its cap read a drive; within a task files stay in
    order. Lanes are drives: their list, and one number each, goes through the driver.
    """
    spark = files.sparkSession
    known = files.select(lane).distinct().join(caps.select(lane, "cap"), lane, "left")
    lanes = sorted((r[0], max(1, r[1] or default)) for r in known.collect())
    first = accumulate((c for _, c in lanes), initial=0)
    plan = spark.createDataFrame([(k, c, f) for (k, c), f in zip(lanes, first, strict=False)], f"{lane} {dict(files.dtypes)[lane]}, _cap int, _first int")
    total = max(1, sum(c for _, c in lanes))
    rows = turns(files, lane, order).join(F.broadcast(plan), lane)
    rows = rows.withColumn("task", (F.col("_first") + F.pmod(F.col("in_lane") - 1, F.col("_cap"))).cast("int")).drop("_cap", "_first", "turn")
    return rows.repartitionById(total, F.col("task")).sortWithinPartitions("in_lane")
