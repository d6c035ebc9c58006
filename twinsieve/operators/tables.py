"""Exact matches, caches, incremental diffs, catalogue queries, and table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def sampled_digest(rows: DataFrame, text: str, size: str, block: int, a: int = 23, b: int = 78) -> DataFrame:
    """SHA-256 of the size and of sampled blocks with their offsets and lengths, big-endian."""
    be = lambda n: F.lpad(F.hex(n.cast("bigint")), 16, "0")
    offsets = X.sample_offsets(F.col(size).cast("bigint"), block, a, b)
    piece = lambda o: F.substring(F.col(text), o.cast("int") + 1, F.lit(block))
    parts = F.array_join(F.transform(offsets, lambda o: F.concat(be(o), be(F.length(piece(o))), F.hex(F.encode(piece(o), "UTF-8")))), "")
    return rows.withColumn("offsets", offsets).withColumn("digest", F.sha2(F.unhex(F.concat(be(F.col(size)), parts)), 256))


def exact_clusters(rows: DataFrame, path: str, group: str = "group_id") -> DataFrame:
    """Rows of one group and of equal (size, digest), two or more, with a label by order of first path within the group."""
    keys = [group, "size", "digest"]
    c = rows.groupBy(*keys).agg(F.count("*").alias("members"), F.min(F.lower(path)).alias("first_path")).filter("members >= 2")
    n = F.row_number().over(Window.partitionBy(group).orderBy("first_path", "digest", "size")) - 1
    marks = F.array(*[F.lit(m) for m in "●■♥♦"])
    label = F.when(n < 4, F.try_element_at(marks, n + 1)).otherwise(X.alpha_label(n - 4))
    return c.select(*keys, "members", "first_path", n.alias("cluster"), label.alias("label"))


def cluster_members(rows: DataFrame, path: str, group: str = "group_id") -> DataFrame:
    """rows with the label of their exact cluster; rows that equal no other one are left out."""
    labels = exact_clusters(rows, path, group).select(group, "size", "digest", "label")
    return rows.join(labels, [group, "size", "digest"])


def latest(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key under the order: upserts, cache picks, latest scans."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def incremental(baseline: DataFrame, current: DataFrame, keys: list[str], versions: list[str]) -> DataFrame:
    """unchanged, modified, new or deleted for every key of either side."""
    b = baseline.select(*[F.col(k).alias(f"b_{k}") for k in keys], *[F.col(v).alias(f"b_{v}") for v in versions], F.lit(True).alias("b_there"))
    c = current.select(*keys, *versions, F.lit(True).alias("c_there"))
    on = [F.col(k) == F.col(f"b_{k}") for k in keys]
    same = F.lit(True)
    for v in versions:
        same = same & F.col(v).eqNullSafe(F.col(f"b_{v}"))
    state = F.when(F.col("b_there").isNull(), "new").when(F.col("c_there").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    return c.join(b, on, "full_outer").select(*[F.coalesce(F.col(k), F.col(f"b_{k}")).alias(k) for k in keys], state.alias("state"))


def cache_lookup(requested: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Each artifact from the newest cache row that has one, and what is left to do."""
    from functools import reduce

    picks = []
    for kind in ("meta", "fingerprint", "audio"):
        newest = latest(cache.filter(F.col(kind).isNotNull()), keys, F.desc("scan_id"), F.desc("row_id"))
        picks.append(newest.select(*keys, kind))
    out = reduce(lambda a, b: a.join(b, keys, "left"), picks, requested)
    decision = F.when(F.col("meta").isNotNull() & F.col("fingerprint").isNotNull(), "cache_hit").when(F.col("meta").isNotNull(), "fingerprint_only")
    return out.withColumn("decision", decision.otherwise("probe_and_fingerprint"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and the rows of old whose key new has not."""
    return old.join(new, keys, "left_anti").unionByName(new)


def missing(known: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return known.join(present, keys, "left_anti")


def hardlinks(files: DataFrame, identity: list[str], path: str) -> DataFrame:
    """kind: canonical for the first path of an identity, hardlink for the others; target is the canonical path.

    An identity with a part that is null or 0 tells nothing: such files stay on their own.
    """
    told = F.lit(True)
    for c in identity:
        told = told & F.coalesce(F.col(c).cast("string") != "0", F.lit(False))
    w = Window.partitionBy(*identity).orderBy(F.lower(path), path)
    known = files.filter(told).withColumn("kind", F.when(F.row_number().over(w) == 1, "canonical").otherwise("hardlink")).withColumn("target", F.first(path).over(w))
    return known.unionByName(files.filter(~told).withColumn("kind", F.lit("canonical")).withColumn("target", F.col(path)))


def lane_metrics(results: DataFrame, lane: str = "lane") -> DataFrame:
    ok = F.col("status") == "success"
    return results.groupBy(lane).agg(
        F.count("*").alias("files"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), F.sum("fallback_count").alias("fallbacks"),
        F.sum("timeout_count").alias("timeouts"), F.round(F.avg("elapsed_s"), 6).alias("avg_service_s"), F.max("elapsed_s").alias("peak_service_s"),
    )


def guidance(metrics: DataFrame, worker_limit: int) -> DataFrame:
    m = metrics.agg(F.greatest(F.lit(1), F.count("*")).alias("lanes"), F.sum("failures").alias("failures"), F.sum("timeouts").alias("timeouts"), F.sum("fallbacks").alias("fallbacks"))
    held = F.least(F.lit(worker_limit), F.col("lanes"))
    slow = (F.col("timeouts") > 0) | (F.col("fallbacks") >= F.col("lanes"))
    reason = F.when(F.col("failures") > 0, "failures").when(slow, "pressure").otherwise("healthy")
    return m.withColumn("workers", F.when((F.col("failures") > 0) | slow, held).otherwise(F.lit(worker_limit))).withColumn("reason", reason)


def quota_sample(files: DataFrame, root: str, path: str, risky: int = 80, normal: int = 40, total: int = 240) -> DataFrame:
    """Up to so many risky and normal files a root, cut at total and filled up in path order."""
    is_risky = X.suffix(F.col(path)).isin(*X.RISKY_SUFFIXES)
    w = Window.partitionBy(root, "risky").orderBy(F.lower(path), path)  # a root's files lie on one drive
    f = files.withColumn("risky", is_risky).withColumn("in_root", F.row_number().over(w))
    tier = F.when(F.col("risky") & (F.col("in_root") <= risky), 0).when(~F.col("risky") & (F.col("in_root") <= normal), 1).otherwise(2)
    order = ["tier", F.lower(root), F.lower(path), path]
    first = f.withColumn("tier", tier).orderBy(*order).limit(total)  # the sample is the feature; only its rows are numbered
    return first.withColumn("position", F.row_number().over(Window.orderBy(*order)))
