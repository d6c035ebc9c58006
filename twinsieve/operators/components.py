"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """node, component: the least node reachable from each node that has an edge.

    Every round contracts the edges towards least neighbours (two grouped minima and two joins,
    whose hot keys AQE can split) and writes the new edges as a table; a chain of n nodes takes
    O(log^2 n) rounds, a star two; not to converge within `rounds` is an error. Loops and repeated
    edges are fine; no edges give no rows.
    """
    scratch = Scratch(edges.sparkSession)
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u > v").distinct()
    e = scratch.cut(e, "components")
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.cut(new, "components")
        mark = tuple(new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        scratch.drop(e)
        e = new
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
