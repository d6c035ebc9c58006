"""What a scan's stored rows are read as: match items, listings in stored order, infos, counts, run documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .numbering import numbered

MAX_RECENT_ROOTS = 20


def match_items(t: dict[str, DataFrame], algo_version: int) -> DataFrame:
    """scan_id and the 24 columns of the files of each scan that can be matched.

    Files that exist, with metadata of a duration and hashes by the scan's own back-end (and this version of the
    algorithm), not marked failed in the scan; the sound's print where there is one. Nulls get their defaults.
    Tables stored in buckets of the file meet without an exchange: a file's hashes are gathered by back-end first (two or
    three), as a join on both columns would be dealt anew, and the marks are a left join, as an anti join would be
    moved below the others.
    """
    scans = t["scans"].select(F.col("id").alias("scan_id"), F.col("probe_backend").alias("wanted"))
    files = t["files"].filter("exists_flag").select("id", "path", "normalized_path", "size", "mtime_ns", "ctime_ns", "scan_id")
    meta = t["video_meta"].filter("duration_s > 0").drop("probed_at", "source_size", "source_mtime_ns", "probe_error")
    prints = t["fingerprints"].filter(F.col("algo_version") == algo_version).groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("probe_backend", "hash_blob"))).alias("blobs"))
    sounds = t["audio_fingerprints"].select("file_id", "fingerprint_text")
    m, p, a = meta.alias("m"), prints.alias("p"), sounds.alias("a")
    rows = files.join(m, F.col("id") == F.col("m.file_id")).join(p, F.col("id") == F.col("p.file_id")).join(a, F.col("id") == F.col("a.file_id"), "left")
    rows = rows.withColumn("hash_blob", F.try_element_at("blobs", F.col("probe_backend"))).filter("hash_blob IS NOT NULL")
    marks = t["scan_failed_files"].select("scan_id", "normalized_path", F.lit(True).alias("failed"))
    rows = rows.join(scans, "scan_id").filter(F.col("wanted") == F.col("probe_backend")).join(marks, ["scan_id", "normalized_path"], "left").filter("failed IS NULL")
    text = lambda *names: [F.coalesce(n, F.lit("")).alias(n) for n in names]
    number = lambda name, other, kind: F.coalesce(F.when(F.col(name) != 0, F.col(name)), F.lit(other)).cast(kind).alias(name)
    return rows.select(
        "scan_id", F.col("id").alias("file_id"), "path", "size", "mtime_ns", "ctime_ns", "duration_s", "width", "height", "fps", number("bit_depth", 8, "int"),
        *text("hdr_format", "container", "codec_profile", "codec_level"), F.coalesce("is_interlaced", F.lit(False)).alias("is_interlaced"), "codec", "bitrate",
        number("audio_stream_count", 0, "int"), *text("audio_codec"), number("audio_bitrate", 0, "bigint"), *text("audio_languages", "subtitle_languages"),
        X.decode_hashes(F.hex("hash_blob")).alias("hashes"), F.coalesce("fingerprint_text", F.lit("")).alias("audio_fingerprint"),
    )


def scan_info(scans: DataFrame) -> DataFrame:
    """scans with the lists that their JSON holds and settings by name, in place of what is stored."""
    backend = F.coalesce(F.when(F.col("probe_backend") != "", F.col("probe_backend")), F.lit("pyav"))
    roots = F.array_distinct(X.text_list(F.col("roots_json")))
    return scans.select(
        "id", "created_at", "profile", roots.alias("roots"), X.extension_list(X.text_list(F.col("extensions_json"))).alias("extensions"),
        X.custom_threshold(F.col("custom_similarity_threshold")).alias("custom_similarity_threshold"), F.coalesce("scene_aware_sampling", F.lit(False)).alias("scene_aware_sampling"),
        F.coalesce("audio_fingerprint_enabled", F.lit(False)).alias("audio_fingerprint_enabled"), X.setting("mode", F.col("cross_resolution_mode")).alias("cross_resolution_mode"),
        backend.alias("probe_backend"), F.coalesce("scan_set_key", F.lit("")).alias("scan_set_key"), "status",
    )


def in_stored_order(rows: DataFrame, *order: str) -> DataFrame:
    """rows(scan_id, ...) with position, from 1 within each scan, and sorted by both; the numbers come from ranges of the whole
    order, so a scan of any size is spread over tasks."""
    placed = numbered(rows, "scan_id", *order, name="_all", start=0)
    first = placed.groupBy(F.col("scan_id").alias("_of")).agg(F.min("_all").alias("_first"))
    told = placed.join(first, F.col("scan_id").eqNullSafe(F.col("_of"))).withColumn("position", F.col("_all") - F.col("_first") + 1)
    return told.drop("_of", "_first").orderBy("_all").drop("_all")


def issue_rows(t: dict[str, DataFrame]) -> DataFrame:
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return in_stored_order(t["scan_issues"].select("scan_id", "id", empty("stage"), empty("path"), empty("message")), "id").drop("id")


def failed_rows(t: dict[str, DataFrame]) -> DataFrame:
    columns = ["normalized_path", "display_path", "stage", "message", "created_at", "updated_at"]
    return in_stored_order(t["scan_failed_files"].select("scan_id", *[F.coalesce(c, F.lit("")).alias(c) for c in columns]), "normalized_path")


def link_rows(t: dict[str, DataFrame]) -> DataFrame:
    kind = F.when(F.lower(F.trim("link_kind")) == "symlink", "symlink").otherwise("hardlink")
    rows = t["scan_links"].select("scan_id", kind.alias("link_kind"), "link_path", "target_original_path", F.coalesce("target_exists_flag", F.lit(False)).alias("target_exists"), F.coalesce("source_root", F.lit("")).alias("source_root"))
    return in_stored_order(rows, "link_path")


def snapshot(t: dict[str, DataFrame]) -> DataFrame:
    """The live files of each scan by path key: what the next scan is compared with."""
    rows = t["files"].filter("exists_flag").select("scan_id", F.col("id").alias("file_id"), "path", "normalized_path", "size", "mtime_ns", "ctime_ns", F.coalesce("ext", F.lit("")).alias("ext"))
    return in_stored_order(rows, "normalized_path", "file_id")


def group_paths(t: dict[str, DataFrame]) -> DataFrame:
    files = t["files"].select(F.col("id").alias("file_id"), "path")
    return t["duplicate_group_items"].select("group_id", "file_id").join(files, "file_id").select("group_id", "file_id", "path")


def scan_counts(t: dict[str, DataFrame]) -> DataFrame:
    """Of each scan its groups, the live files that are members of them, and its failed files."""
    groups = t["duplicate_groups"].select(F.col("id").alias("group_id"), "scan_id")
    live = t["files"].filter("exists_flag").select(F.col("id").alias("file_id"))
    items = t["duplicate_group_items"].select("group_id", "file_id").join(live, "file_id").join(groups, "group_id").groupBy("scan_id").agg(F.count("*").alias("files"))
    counted = lambda rows, name: rows.groupBy("scan_id").agg(F.count("*").alias(name))
    out = t["scans"].select(F.col("id").alias("scan_id"), "status")
    for part in (counted(groups, "groups"), items, counted(t["scan_failed_files"], "failed")):
        out = out.join(part, "scan_id", "left")
    return out.select("scan_id", "status", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("groups", "files", "failed")])


def newest(scans: DataFrame, key: str | None = None, status: str | None = None) -> DataFrame:
    """The id of the newest scan, of a set and of a status where they are given; a blank set has none."""
    rows = scans.filter(F.col("scan_set_key") == key.strip()).filter(F.lit(bool(key.strip()))) if key is not None else scans
    rows = rows.filter(F.col("status") == status) if status else rows
    return rows.agg(F.max("id").alias("id")).filter("id is not null")


def filter_lists(members: DataFrame) -> DataFrame:
    """The extensions and the codecs to choose from: each distinct, in order without regard to case."""

    def of(name: str) -> DataFrame:
        values = members.select(F.trim(F.coalesce(name, F.lit(""))).alias("value")).filter("value <> ''").distinct()
        w = Window.partitionBy("kind").orderBy(F.lower("value"), "value")  # as many values as there are formats
        return values.withColumn("kind", F.lit(name)).withColumn("position", F.row_number().over(w))

    return of("ext").unionByName(of("codec")).select("kind", "position", "value")


def structured(*, min_mib: float | None = None, max_mib: float | None = None, min_s: float | None = None, max_s: float | None = None, similarity: float | None = None,
               width: int | None = None, height: int | None = None, ext: str = "", codec: str = "", hdr: str = "any") -> Column:
    """The condition of structured filters; what is not given does not count. Sizes are cut to whole bytes. hdr: any, only, exclude."""
    tests = [
        (min_mib, lambda v: F.col("size") >= int(v * 1048576)), (max_mib, lambda v: F.col("size") <= int(v * 1048576)), (min_s, lambda v: F.col("duration_s") >= v), (max_s, lambda v: F.col("duration_s") <= v),
        (similarity, lambda v: F.col("similarity_score") >= v), (width, lambda v: F.col("width") >= v), (height, lambda v: F.col("height") >= v),
        (ext or None, lambda v: F.lower("ext") == v.lower()), (codec or None, lambda v: F.lower("codec") == v.lower()),
    ]
    out = F.lit(True)
    for value, test in tests:
        out = out if value is None else out & test(value)
    labelled = F.coalesce("hdr_format", F.lit("")) != ""
    return out & labelled if hdr == "only" else out & ~labelled if hdr == "exclude" else out


def recent_roots(entries: DataFrame, limit: int = MAX_RECENT_ROOTS) -> DataFrame:
    """entries(owner, at, root): of each owner the first `limit` roots in order of `at`, each once without regard to case, blank ones left out."""
    clean = entries.select("owner", "at", F.trim(F.coalesce("root", F.lit(""))).alias("root")).filter("root <> ''")
    first = clean.groupBy("owner", F.lower("root").alias("_key")).agg(F.min(F.struct("at", "root")).alias("_f"))
    w = Window.partitionBy("owner").orderBy("_f.at", "_f.root")
    return first.select("owner", F.col("_f.root").alias("root"), F.row_number().over(w).alias("position")).filter(F.col("position") <= limit)


def run_document(results: DataFrame, lanes: DataFrame, mix: DataFrame, guidance: DataFrame, told: dict) -> DataFrame:
    """One JSON document of a benchmark run: its counters, lanes in order with their decoders, guidance, and what is told of it; keys in order."""
    by_lane = mix.groupBy("lane").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("decoder", "files")))).alias("decoder_mix"))  # a few decoders a lane
    rows = lanes.join(by_lane, "lane", "left")
    lane = F.struct(
        "lane", F.col("avg_service_s").alias("average_service_s"), F.coalesce("decoder_mix", F.create_map().cast("map<string,bigint>")).alias("decoder_mix"), F.col("timeouts").alias("decoder_timeout_count"),
        "failures", F.col("fallbacks").alias("fallback_count"), "files", F.col("peak_service_s"), "successes",
    )
    by_number = lambda a, b: F.when(a["lane"] < b["lane"], -1).when(a["lane"] > b["lane"], 1).otherwise(0)
    all_lanes = rows.agg(F.array_sort(F.collect_list(lane), by_number).alias("lane_metrics"))  # a lane a drive
    one = results.join(all_lanes).join(guidance.select(F.struct("reason", F.col("workers").alias("recommended_workers")).alias("guidance")))  # one row each
    columns = {
        "analyzed_files": F.col("analyzed"), "decoder_timeout_count": F.col("timeouts"), "failure_count": F.col("failures"), "fallback_count": F.col("fallbacks"), "guidance": F.col("guidance"),
        "lane_metrics": F.col("lane_metrics"), "success_count": F.col("successes"), **{k: F.lit(v) for k, v in told.items()},
    }
    return one.select(F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)])).alias("json"))


def action_history(runs: DataFrame, items: DataFrame) -> DataFrame:
    """Runs with how many of their items ended in each result, and the first error in order of the items."""
    of = items.groupBy("run_id").agg(
        F.count("*").alias("items"), F.count_if(F.col("result") == "ok").alias("done"), F.count_if(F.coalesce("error_text", F.lit("")) != "").alias("failed"),
        F.min(F.when(F.coalesce("error_text", F.lit("")) != "", F.struct("id", "error_text")))["error_text"].alias("first_error"),
    )
    rows = runs.join(of, runs["id"] == of["run_id"], "left").drop("run_id")
    return rows.select(*runs.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("items", "done", "failed")], "first_error")


def run_counters(decisions: DataFrame, groups: DataFrame, issues: DataFrame, stage_seconds: dict[str, float] | None = None) -> DataFrame:
    """The row that a finished scan prints: decisions(decision) of its files, its groups and issues; stages(in order) as name:seconds."""
    d = F.col("decision")
    files = decisions.agg(
        F.count("*").alias("scanned_files"), F.count_if(d == "cache_hit").alias("cached_files"), F.count_if(d != "cache_hit").alias("fingerprinted_files"),
        F.count_if(d == "fingerprint_only").alias("fingerprint_only_files"),
    )
    out = files.join(groups.agg(F.count("*").alias("duplicate_groups"))).join(issues.agg(F.count("*").alias("issues")))  # one row each
    return out.withColumn("timings_s", F.lit(",".join(f"{k}:{v:.3f}" for k, v in (stage_seconds or {}).items())))
