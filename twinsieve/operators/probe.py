"""Probe output (JSON) to metadata columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

#: Every field as text: probes write numbers both bare and quoted. A nested value is its JSON.
STREAM = "struct<codec_type:string,codec_name:string,width:string,height:string,r_frame_rate:string,bit_rate:string,pix_fmt:string,bits_per_raw_sample:string,profile:string,level:string,field_order:string,color_transfer:string,color_primaries:string,tags:struct<language:string>>"
SCHEMA = "struct<format:struct<duration:string,bit_rate:string,format_name:string>,streams:array<string>>"
# Names by which probes tell interlaced fields, and profiles that say nothing.
INTERLACED = ("tt", "bb", "tb", "bt", "tff", "bff", "top_field_first", "bottom_field_first", "interlaced")
NO_PROFILE = ("unknown", "n/a", "none")


def hdr_label(text: Column, transfer: Column, primaries: Column) -> Column:
    """text: keys and values of the video stream in lower case, one space between them."""
    told = lambda *parts: F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(text, p))
    by, wide = F.lower(F.trim(transfer)), F.lower(F.trim(primaries)).isin("bt2020", "bt2020nc", "bt2020c")
    return (
        F.when(told("dolby vision", "dovi", "dv_profile", "side_data_type dv"), "DV").when(told("hdr10+", "dynamic hdr plus"), "HDR10+")
        .when(by == "smpte2084", "HDR10").when(by == "arib-std-b67", "HLG").when(by == "bt2020-10", "HDR10")
        .when(wide & told("mastering display metadata", "content light level metadata"), "HDR10").otherwise("")
    )


def parse_probe(rows: DataFrame, column: str) -> DataFrame:
    """rows with the metadata of a probe's JSON; probe_error tells why a row's metadata is of no use."""
    p = rows.withColumn("_p", F.from_json(column, SCHEMA))
    texts = F.coalesce("_p.streams", F.array().cast("array<string>"))
    p = p.withColumn("_streams", F.transform(texts, lambda t: F.struct(t.alias("text"), F.from_json(t, STREAM).alias("s"))))
    of = lambda kind: F.filter("_streams", lambda x: x["s"]["codec_type"] == kind)
    p = p.withColumn("_v", F.try_element_at(of("video"), F.lit(1))).withColumn("_a", of("audio")).withColumn("_t", of("subtitle"))
    v = lambda name: F.coalesce(F.col(f"_v.s.{name}"), F.lit(""))
    told = F.regexp_replace(F.lower(F.coalesce("_v.text", F.lit(""))), r'["{}\[\]:,\s]+', " ")
    sound = F.try_element_at("_a", F.lit(1))["s"]
    langs = lambda c: X.languages(F.transform(c, lambda x: F.coalesce(x["s"]["tags"]["language"], F.lit(""))))
    rate = F.aggregate("_a", F.lit(0.0), lambda sum_, x: sum_ + X.positive(x["s"]["bit_rate"]))
    profile = F.trim(v("profile"))
    out = p.select(
        *rows.columns, X.positive(F.col("_p.format.duration")).alias("duration_s"), X.positive(v("width")).cast("int").alias("width"), X.positive(v("height")).cast("int").alias("height"),
        X.rational(v("r_frame_rate")).alias("fps"), F.lower(v("codec_name")).alias("codec"), X.positive(F.col("_p.format.bit_rate")).cast("bigint").alias("bitrate"),
        F.size("_a").alias("audio_stream_count"), F.lower(F.coalesce(sound["codec_name"], F.lit(""))).alias("audio_codec"), rate.cast("bigint").alias("audio_bitrate"),
        langs("_a").alias("audio_languages"), langs("_t").alias("subtitle_languages"), X.bit_depth(v("bits_per_raw_sample"), v("pix_fmt")).alias("bit_depth"),
        hdr_label(told, v("color_transfer"), v("color_primaries")).alias("hdr_format"),
        F.trim(F.lower(F.coalesce(F.split("_p.format.format_name", ",")[0], F.lit("")))).alias("container"),
        F.when(F.lower(profile).isin(*NO_PROFILE), "").otherwise(profile).alias("codec_profile"), X.level_text(v("level")).alias("codec_level"),
        F.lower(F.trim(v("field_order"))).isin(*INTERLACED).alias("is_interlaced"),
    )
    good = (F.col("duration_s") > 0) & (F.col("width") > 0) & (F.col("height") > 0)
    return out.withColumn("probe_error", F.when(good, "").otherwise("Invalid video metadata"))
