"""Exports of groups and links. Folders of part files: nothing is gathered in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of the exported tables and the item fields they come from.
DUPLICATES = {
    "group_id": "group_id", "file_path": "path", "duration": "duration_s", "container": "container", "width": "width", "height": "height", "fps": "fps",
    "interlaced": "is_interlaced", "bit_depth": "bit_depth", "hdr_format": "hdr_format", "bitrate": "bitrate", "codec": "codec", "codec_profile": "codec_profile",
    "codec_level": "codec_level", "audio_stream_count": "audio_stream_count", "audio_codec": "audio_codec", "audio_bitrate": "audio_bitrate",
    "similarity_score": "similarity_score", "is_keep_default": "keep_default", "selected_action": "selected_action",
}
LINKS = ("scan_id", "link_kind", "link_path", "target_original_path", "target_exists", "source_root")


def _flag(c: Column) -> Column:
    return c.cast("int")


def duplicate_rows(members: DataFrame) -> DataFrame:
    """The 20 columns of duplicates.csv; flags as 1 and 0, the score to six places."""
    kinds = {"is_interlaced": _flag, "keep_default": _flag, "similarity_score": lambda c: F.round(c, 6)}
    return members.select(*[kinds.get(f, lambda c: c)(F.col(f)).alias(name) for name, f in DUPLICATES.items()])


def duplicate_documents(members: DataFrame, scan: dict[str, object]) -> DataFrame:
    """group_id and a JSON document a group: scan_id, created_at, profile, sums, and items in order (keeper, pixels, bit rate)."""
    fields = {"file_id": F.col("file_id")} | {("is_interlaced" if n == "interlaced" else n): F.col(f) for n, f in DUPLICATES.items() if n != "group_id"}
    place = [(~F.col("keep_default")).alias("_1"), (-F.col("width") * F.col("height")).alias("_2"), (-F.col("bitrate")).alias("_3"), F.col("file_id").alias("_4")]
    item = F.struct(*place, F.struct(*[c.alias(n) for n, c in fields.items()]).alias("item"))
    kept = F.sum(F.when(F.col("keep_default"), F.col("size")).otherwise(0))
    g = members.groupBy("group_id").agg(
        F.sum("size").alias("total_size_bytes"), F.avg("similarity_score").alias("average_confidence"),
        F.greatest(F.lit(0), F.sum("size") - kept).cast("bigint").alias("reclaimable_bytes"), F.sort_array(F.collect_list(item)).alias("_items"),
    )
    head = [F.lit(v).alias(k) for k, v in scan.items()]
    body = ["group_id", "total_size_bytes", "average_confidence", "reclaimable_bytes", F.transform("_items", lambda x: x["item"]).alias("items")]
    return g.select("group_id", F.to_json(F.struct(*head, *body)).alias("json"))


def link_rows(links: DataFrame) -> DataFrame:
    return links.select(*[_flag(F.col(c)).alias(c) if c == "target_exists" else c for c in LINKS])


def write_csv(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(folder)


def write_documents(rows: DataFrame, folder: str) -> None:
    """A JSON document a line."""
    rows.select("json").write.mode("overwrite").text(folder)


def write_exports(members: DataFrame, links: DataFrame, scan: dict[str, object], folder: str) -> None:
    """duplicates.csv, duplicates.json, links.csv and links.json under folder."""
    write_csv(duplicate_rows(members), f"{folder}/duplicates.csv")
    write_documents(duplicate_documents(members, scan), f"{folder}/duplicates.json")
    write_csv(link_rows(links), f"{folder}/links.csv")
    head = [F.lit(v).alias(k) for k, v in scan.items() if k not in LINKS]
    write_documents(links.select(F.to_json(F.struct(*head, *LINKS)).alias("json")), f"{folder}/links.json")
