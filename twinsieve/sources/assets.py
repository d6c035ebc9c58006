"""Media assets derived from the `documents` table, and their variants.

A document stands for a video: its length for size and duration, twelve runs of 65 characters
for frames, and arithmetic on its id for what a probe would tell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


def pick(index, *values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def frame_hashes() -> Column:
    return F.transform("frames", X.adjacent_hash)


def assets(documents: DataFrame, hashes: Column | None = None) -> DataFrame:
    """An asset for every document; an empty text has frames of zeros, a null text and null n_chars count as empty."""
    documents = documents.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("n_chars", F.coalesce("n_chars", F.lit(0)))
    i = F.col("doc_id")
    div = lambda n: F.floor(i / n)
    frames = F.transform(F.array(*[F.lit(p) for p in X.SAMPLE_PERCENTS]), lambda p: F.substring(F.col("text"), F.floor(F.col("n_chars") * p).cast("int") + 1, F.lit(65)))
    d = documents.withColumn("frames", frames)
    ext = pick(i % 5, "mp4", "mkv", "avi", "mov", "webm")
    return d.select(
        i.alias("file_id"), F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang", F.lit("/doc_"), i.cast("string"), F.lit("."), ext).alias("path"),
        F.col("n_chars").alias("size"), (F.col("n_chars") / 10.0).alias("duration_s"), ext.alias("ext"), "source",
        F.when(i % 29 == 0, 0).otherwise(pick(i % 4, 1920, 1280, 1920, 640)).alias("width"), pick(i % 4, 1080, 720, 800, 480).alias("height"),
        pick(div(4) % 4, "hevc", "h264", "vp9", "mpeg4").alias("codec"), pick(div(16) % 4, "Main", "High", "Main 10", "").alias("codec_profile"),
        pick(div(2) % 4, "4.1", "5.1", "", "x").alias("codec_level"), pick(i % 3, 8, 10, 12).alias("bit_depth"), (i % 13 == 0).alias("is_interlaced"),
        pick(div(3) % 5, "", "HDR10", "", "HLG", "DV").alias("hdr_format"), (500000 + (i * 7919 % 7500) * 1000).alias("bitrate"),
        (F.lit(1700000000000000000) + (i * 104729 % 1000003) * 1000).alias("mtime_ns"),
        F.when(i % 2 == 0, F.sha2(F.col("text"), 256)).otherwise(F.lit("")).alias("audio_fingerprint"),
        (frame_hashes() if hashes is None else hashes).alias("hashes"), pick(i % 3, 24.0, 25.0, 29.97).alias("fps"), pick(i % 5, "mov", "matroska", "avi", "mov", "matroska").alias("container"),
        (i % 3).cast("int").alias("audio_stream_count"), F.when(i % 3 > 0, pick(i % 2, "aac", "opus")).otherwise("").alias("audio_codec"),
        (i % 3 * 96000).cast("bigint").alias("audio_bitrate"),
    )


def items(documents: DataFrame) -> DataFrame:
    """Assets of which a frame was decoded, with trimmed, audio and blurred variants, so that every kind of match occurs.

    Blurred ones differ in 4 to 20 bits of every frame, which tells the profiles' thresholds apart.
    """
    d = F.col("doc_id")
    every, ends = F.lit(-1).cast("bigint"), lambda k: F.when(k.isin(0, 1, 10, 11), F.lit(-1)).otherwise(F.lit(0)).cast("bigint")
    bits = F.call_function("shiftleft", F.lit(1).cast("bigint"), (d % 17 + 4).cast("int")) - 1
    kinds = {1: (d % 7 == 3, ends), 2: (d % 11 == 5, lambda k: every), 3: (d % 5 == 2, lambda k: bits)}

    def variants(hashes):
        flipped = lambda mask: F.transform(hashes, lambda x, k: x.bitwiseXOR(mask(k)))
        own = F.struct(F.lit(0).alias("kind"), hashes.alias("hashes"))
        made = [F.when(when, F.struct(F.lit(kind).alias("kind"), flipped(mask).alias("hashes"))) for kind, (when, mask) in kinds.items()]
        return F.when(X.hashes_valid(hashes), F.array_compact(F.array(own, *made))).otherwise(F.array().cast("array<struct<kind:int,hashes:array<bigint>>>"))

    # a filter on what a generator makes stays above it, so hashes are computed once a document (explode would have filters below it)
    rows = assets(documents, X.bound(frame_hashes(), variants)).withColumn("variant", F.explode_outer("hashes")).filter("variant IS NOT NULL")
    kind = F.col("variant.kind")
    return rows.select(*[
        (F.col(c) + kind * 10_000_000).alias("file_id") if c == "file_id" else (F.col(c) + F.when(kind == 1, 5.0).otherwise(0.0)).alias(c) if c == "duration_s"
        else F.when(kind == 3, "").otherwise(F.col(c)).alias(c) if c == "audio_fingerprint" else F.col("variant.hashes").alias(c) if c == "hashes" else c
        for c in rows.columns if c != "variant"
    ])
