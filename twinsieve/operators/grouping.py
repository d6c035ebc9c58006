"""Components, group members with keep choice, group metrics, filters, sorts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .components import connected_components
from .numbering import numbered


def member_scores(edges: DataFrame) -> DataFrame:
    """Per item: mean score over its own edges, reason by precedence, least gap of its trimmed edges."""
    return met_scores(_met(edges))


def _met(edges: DataFrame) -> DataFrame:
    """A row for each item of each edge, as `matching.met_items` tells of many."""
    rank = F.when(F.col("match_reason") == "trimmed_match", 3).when(F.col("match_reason") == "audio_match", 2).otherwise(1)
    ends = edges.select("file_a", F.explode(F.array("file_a", "file_b")).alias("file_id"), "score", rank.alias("rank"), "gap_s")
    return ends.select("file_id", F.col("file_a").alias("root"), F.lit(1).cast("bigint").alias("edges"), "score", "rank", "gap_s")


def met_scores(met: DataFrame) -> DataFrame:
    """The scores of items out of `matching.met_items`."""
    return met.groupBy("file_id").agg(
        (F.sum("score") / F.sum("edges")).alias("similarity_score"), F.max("rank").alias("rank"),
        F.coalesce(F.min(F.when(F.col("rank") == 3, F.col("gap_s"))), F.lit(0.0)).alias("match_duration_delta_s"),
    ).withColumn("match_reason", F.element_at(F.array(F.lit("perceptual"), F.lit("audio_match"), F.lit("trimmed_match")), F.col("rank"))).drop("rank")


def keep_order(strategy: str = "best") -> list[Column]:
    """The order whose first row is kept."""
    score, low = F.col("quality"), F.lower("path")
    level, interlaced = F.col("level"), F.col("is_interlaced").cast("int")
    return {
        "best": [score.desc(), level.desc(), interlaced.asc(), F.col("mtime_ns").asc(), low.asc()],
        "worst": [score.asc(), level.asc(), interlaced.desc(), F.col("mtime_ns").asc(), low.asc()],
        "larger": [F.col("size").desc(), score.desc(), low.asc()],
        "smaller": [F.col("size").asc(), score.desc(), low.asc()],
        "newer": [F.col("mtime_ns").desc(), score.desc(), low.asc()],
        "older": [F.col("mtime_ns").asc(), score.desc(), low.asc()],
    }[strategy]


def with_quality(items: DataFrame) -> DataFrame:
    q = X.quality_score(*[F.col(c) for c in ("width", "height", "bitrate", "codec", "bit_depth", "codec_profile", "is_interlaced")])
    return items.withColumn("quality", q).withColumn("level", X.codec_level(F.col("codec_level")))


def group_items(items: DataFrame, edges: DataFrame, strategy: str = "best") -> DataFrame:
    """Members of components of two or more, with scores and the keeper of each group."""
    return group_met(items, _met(edges), strategy)


def group_met(items: DataFrame, met: DataFrame, strategy: str = "best") -> DataFrame:
    """group_items out of what `matching.met_items` tells of the edges."""
    comps = connected_components(met, "file_id", "root").select(F.col("node").alias("file_id"), F.col("component").alias("group_id"))
    m = with_quality(items).join(comps, "file_id").join(met_scores(met), "file_id")
    w = Window.partitionBy("group_id").orderBy(*keep_order(strategy), F.col("file_id"))
    return m.withColumn("keep_default", F.row_number().over(w) == 1).drop("hashes").withColumn(
        "selected_action", F.when(F.col("keep_default"), "keep").otherwise("rename")
    )


def group_metrics(members: DataFrame) -> DataFrame:
    g = members.groupBy("group_id").agg(
        F.count("*").alias("members"), F.sum("size").alias("total_size_bytes"), F.sum(F.when(F.col("keep_default"), F.col("size")).otherwise(0)).alias("keep_size"),
        F.avg("similarity_score").alias("average_confidence"), F.max("size").alias("largest"), F.min("size").alias("smallest"), F.min(F.lower("path")).alias("tie"),
    )
    return g.withColumn("reclaimable_bytes", F.greatest(F.lit(0).cast("bigint"), F.col("total_size_bytes") - F.col("keep_size")))


def group_report(members: DataFrame) -> DataFrame:
    """One row a group, in the default order."""
    keeper = members.filter("keep_default").select("group_id", F.col("file_id").alias("keep_file_id"), F.col("path").alias("keep_path"))
    g = group_metrics(members).join(keeper, "group_id")
    return numbered(g, F.desc("members"), F.desc("reclaimable_bytes"), "group_id").select(
        "position", F.format_string("G%04d", "position").alias("label"), "group_id", "members", "total_size_bytes", "reclaimable_bytes",
        F.round("average_confidence", 6).alias("average_confidence"), "keep_file_id", "keep_path",
    )


def filtered(members: DataFrame, include: Column | None = None, exclude: Column | None = None, match_all: bool = False) -> DataFrame:
    """Excluded items go; groups under two go; a group with one item (all items) included stays whole."""
    g = Window.partitionBy("group_id")
    m = members if exclude is None else members.filter(~exclude)
    m = m.withColumn("_n", F.count("*").over(g)).filter("_n >= 2").drop("_n")
    if include is None:
        return m
    hit = (F.bool_and(include) if match_all else F.bool_or(include)).over(g)
    return m.withColumn("_hit", hit).filter("_hit").drop("_hit")


def has_term(column: Column, text: str) -> Column:
    return F.exists(X.terms(F.lit(text)), lambda t: F.contains(F.lower(column), t))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def sorted_groups(members: DataFrame, mode: str) -> DataFrame:
    """group_id and its position under total, count or spread, up or down."""
    by, down = mode.rsplit("_", 1)
    m = group_metrics(members).withColumn("spread", F.col("largest") - F.col("smallest"))
    sign = F.desc if down == "down" else F.asc
    keys = {"total": ["total_size_bytes", "members"], "count": ["members", "total_size_bytes"], "spread": ["spread", "members", "total_size_bytes"]}[by]
    return numbered(m, *[sign(k) for k in keys], "tie", "group_id").select("group_id", "position", "members", "total_size_bytes", "spread")


def sorted_rows(members: DataFrame, down: bool) -> DataFrame:
    size = F.desc("size") if down else F.asc("size")
    w = Window.partitionBy("group_id").orderBy(size, F.desc("quality"), "mtime_ns", F.lower("path"), "file_id")
    return members.select("group_id", "file_id", "size", F.row_number().over(w).alias("row_position"))


def summary(members: DataFrame) -> DataFrame:
    """Numbers of the whole view; savings if the least, or the largest, of each group is kept."""
    g = group_metrics(members)
    return g.agg(
        F.count("*").alias("groups"), F.coalesce(F.sum("members"), F.lit(0)).alias("files"), F.coalesce(F.sum("total_size_bytes"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum(F.col("total_size_bytes") - F.col("smallest")), F.lit(0)).alias("save_max"),
        F.coalesce(F.sum(F.col("total_size_bytes") - F.col("largest")), F.lit(0)).alias("save_min"), F.max("members").alias("largest_group"),
        F.round(F.avg("members"), 6).alias("mean_group"), F.median("members").alias("median_group"), F.coalesce(F.sum(F.col("members") - 1), F.lit(0)).alias("extra_files"),
    )
