"""Blocking, the cascade of predicates, edges and counters.

Pairs meet where their duration buckets share an occupied centre. All such pairs have to be judged, which
tiles do (see `tiles`): they carry what the judgement needs, so no pair fetches anything afterwards. Equal
audio prints are few and found by an equi-join on the print and the centre: every item is dealt to the bucket
centres within reach, and a pair comes out at the least centre that both reach.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import tiles as B


def bucketed(items: DataFrame) -> DataFrame:
    return items.withColumn("bucket", X.duration_bucket(F.col("duration_s"))).withColumn("aspect", X.aspect_bin(F.col("width"), F.col("height")))


def _reach(tolerance: float) -> int:
    return max(0, math.ceil(tolerance / X.BUCKET_SECONDS) - 1)


def _aspect(mode: str) -> float | None:
    """How far the logarithms of aspect ratios may be apart."""
    return None if mode == "any_aspect" else X.ASPECT_SAME if mode == "same_aspect" else X.ASPECT_OFF


def _sides(items: DataFrame, *more: str) -> DataFrame:
    return bucketed(items).select("file_id", "bucket", "aspect", F.col("duration_s").cast("double").alias("duration_s"), B.ratio(F.col("width"), F.col("height")).alias("ratio"), *more)


def block_pairs(items: DataFrame, tolerance: float = 8.0, mode: str = "off", gated: bool = False) -> DataFrame:
    """file_a < file_b of all pairs that share an occupied bucket centre (and, in mode off, the aspect bin); gated: that pass the gate too."""
    aspect = _aspect(mode)

    def judge(a, b):
        return B.gated_pairs(a, b, tolerance, aspect) if gated else B.all_pairs(a, b)

    rows = _sides(items) if gated else bucketed(items).select("file_id", "bucket", "aspect")
    met = B.judged(rows, _reach(tolerance), mode, judge, "file_id long, others array<long>", whole=True)
    pairs = met.select("file_id", F.explode("others").alias("other")).filter("file_id <> other")
    return pairs.select(F.least("file_id", "other").alias("file_a"), F.greatest("file_id", "other").alias("file_b"))


def pair_distances(items: DataFrame, tolerance: float, mode: str = "off") -> DataFrame:
    """Every pair that shares an occupied centre with the bits of its first hashes, both distances and both prefilters."""

    def judge(a, b):
        a, b = B.at(a, b, B.once_all(a, b))
        if len(a.id) and min(a.n[0], b.n[0]):
            one = np.ones(len(a.id))
            first = np.bitwise_count(a.hashes[:, 0] ^ b.hashes[:, 0]).astype("i4")
            yield (*B.ends(a, b), first, *[one * B.distance(a, b, inner) for inner in (False, True)], *[one * B.prefilter(a, b, inner) / 2 for inner in (False, True)])
        elif len(a.id):
            raise ValueError("an item has no hashes")

    schema = "file_a long, file_b long, first_bits int, full_distance double, inner_distance double, prefilter_full double, prefilter_inner double"
    return B.judged(_sides(items, "hashes"), _reach(tolerance), mode, judge, schema)


def gate(tolerance: float, mode: str) -> Column:
    da, db = F.col("a.duration_s"), F.col("b.duration_s")
    longest, shortest = F.greatest(da, db), F.least(da, db)
    ratio = F.greatest(F.lit(0.70), 1 - tolerance / F.greatest(F.lit(1.0), longest))
    ra, rb = (B.ratio(F.col(f"{s}.width"), F.col(f"{s}.height")) for s in ("a", "b"))
    ok = (F.abs(da - db) <= tolerance) & (longest > 0) & (F.try_divide(shortest, longest) >= ratio) & (ra > 0) & (rb > 0)
    aspect = _aspect(mode)
    return ok if aspect is None else ok & (F.abs(F.log2(F.try_divide(ra, rb))) <= aspect)


def close_edges(items: DataFrame, profile: str = "balanced", custom: float = 0.18, tolerance: float = 8.0, mode: str = "off") -> DataFrame:
    """Edges of near hashes."""
    limit, aspect = X.threshold(profile, custom), _aspect(mode)

    def judge(a, b):
        return B.close_pairs(B.near_pairs(a, b, tolerance, aspect), limit)

    return B.judged(_sides(items, "hashes"), _reach(tolerance), mode, judge, "file_a long, file_b long, score double, match_reason string, gap_s double", whole=True)


def audio_edges(items: DataFrame, profile: str = "balanced", custom: float = 0.18, tolerance: float = 8.0, mode: str = "off") -> DataFrame:
    """Edges of equal audio prints whose hashes are not near: a join on the print, so their number is all that grows."""
    limit, reach, keys = X.threshold(profile, custom), _reach(tolerance), ["centre", "aspect"] if mode == "off" else ["centre"]
    every = bucketed(items)
    # every occupied centre with the nearest occupied one before it, as far as two items can share it
    taken = every.select(F.col("bucket").alias("of"), "aspect").distinct()
    near = taken.withColumn("centre", F.explode(F.sequence(F.col("of"), F.col("of") + 2 * reach)))
    occupied = near.groupBy(*keys).agg(F.max(F.when(F.col("of") < F.col("centre"), F.col("of"))).alias("before"), F.bool_or(F.col("of") == F.col("centre")).alias("here"))
    occupied = occupied.filter("here").drop("here")
    heard = every.filter("audio_fingerprint <> ''").select("file_id", "bucket", "aspect", "duration_s", "width", "height", "hashes", "audio_fingerprint")
    dealt = heard.withColumn("centre", F.explode(F.sequence(F.col("bucket") - reach, F.col("bucket") + reach))).join(occupied, keys)
    first = F.coalesce(F.col("a.before") < F.greatest("a.bucket", "b.bucket") - reach, F.lit(True))
    on = (F.col("a.file_id") < F.col("b.file_id")) & first & gate(tolerance, mode)
    for k in [*keys, "audio_fingerprint"]:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    p, ha, hb = dealt.alias("a").join(dealt.alias("b"), on), F.col("a.hashes"), F.col("b.hashes")
    gap = F.abs(F.col("a.duration_s") - F.col("b.duration_s"))
    p = p.select(F.col("a.file_id").alias("file_a"), F.col("b.file_id").alias("file_b"), gap.alias("gap_s"), (gap > X.INNER_GAP).alias("inner"), ha.alias("ha"), hb.alias("hb"))
    ha, hb, inner = F.col("ha"), F.col("hb"), F.col("inner")
    rejected = F.when(inner, X.prefilter_inner(ha, hb)).otherwise(X.prefilter_full(ha, hb)) > X.PREFILTER_BITS
    distance = F.when(~rejected, F.when(inner, X.inner_distance(ha, hb)).otherwise(X.full_distance(ha, hb)))
    close = F.coalesce(distance <= F.when(inner, F.lit(limit * X.INNER_FACTOR)).otherwise(F.lit(limit)), F.lit(False))
    return p.filter(~close).select("file_a", "file_b", F.lit(1.0).alias("score"), F.lit("audio_match").alias("match_reason"), "gap_s")


def edges(items: DataFrame, audio: bool = True, **options) -> DataFrame:
    close = close_edges(items, **options)
    return close.unionByName(audio_edges(items, **options)) if audio else close


def met_items(items: DataFrame, audio: bool = True, profile: str = "balanced", custom: float = 0.18, tolerance: float = 8.0, mode: str = "off") -> DataFrame:
    """What edges tell of their items: file_id, root (an item of the same component, or itself), edges (their number), score
    (their sum), rank (3: one is trimmed, 2: audio, 1), gap_s (least of trimmed ones).

    A tile gathers its close edges, which grow with the square of a group of near copies, into a row an item.
    """
    limit, aspect = X.threshold(profile, custom), _aspect(mode)

    def judge(a, b):
        yield from B.gathered(a, b, B.close_pairs(B.near_pairs(a, b, tolerance, aspect), limit))

    met = B.judged(_sides(items, "hashes"), _reach(tolerance), mode, judge, "file_id long, root long, edges long, score double, rank int, gap_s double", whole=True)
    if not audio:
        return met
    heard = audio_edges(items, profile, custom, tolerance, mode).select("file_a", F.explode(F.array("file_a", "file_b")).alias("file_id"))
    return met.unionByName(heard.select("file_id", F.col("file_a").alias("root"), F.lit(1).cast("bigint").alias("edges"), F.lit(1.0).alias("score"), F.lit(2).alias("rank"), F.lit(0.0).alias("gap_s")))


def match_stats(items: DataFrame, tolerance: float = 8.0, mode: str = "off", profile: str = "balanced", custom: float = 0.18, audio: bool = True) -> DataFrame:
    """Counters of the cascade, added up by tiles, which tell them twice (see `tiles.counted`). Each side is one row."""
    limit, aspect = X.threshold(profile, custom), _aspect(mode)

    def judge(a, b):
        passed = close = trimmed = 0
        for near in B.near_pairs(a, b, tolerance, aspect):
            passed += len(near[0].id)
            n = sum(len(got[0]) for got in B.close_pairs([near], limit))
            close, trimmed = close + n, trimmed + n * near[2]
        pairs, gated, inner = B.counted(a, b, tolerance, aspect)
        yield tuple(np.array([int(n)]) for n in (pairs, gated, gated - 2 * passed, inner, 2 * trimmed, 2 * close))

    names = ["candidate_pairs", "prefilter_pairs", "prefilter_rejected", "inner_mode_pairs", "inner_mode_accepted", "close"]
    told = B.judged(_sides(items, "hashes"), _reach(tolerance), mode, judge, ", ".join(f"{n} long" for n in names), whole=True)
    told = told.agg(*[F.coalesce(F.shiftright(F.sum(n), 1), F.lit(0)).alias(n) for n in names])
    heard = audio_edges(items, profile, custom, tolerance, mode) if audio else items.limit(0)
    told = told.join(heard.agg(F.count("*").alias("heard")))
    of = bucketed(items).agg(F.count("*").alias("items"), F.count_distinct("bucket", "aspect").alias("buckets"))
    return told.join(of).select(
        "candidate_pairs", "prefilter_pairs", "prefilter_rejected", (F.col("prefilter_pairs") - F.col("prefilter_rejected")).alias("full_distance_pairs"),
        "inner_mode_pairs", "inner_mode_accepted", (F.col("close") + F.col("heard")).alias("accepted_pairs"), "items", "buckets",
    )
