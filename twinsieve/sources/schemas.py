"""The stored tables: typed schemas, keys, and a bucketed layout whose joins on file_id need no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of tables and columns must equal the stored ones.
SCHEMAS = {
    "scans": "id long, created_at string, profile string, roots_json string, extensions_json string, custom_similarity_threshold double, scene_aware_sampling boolean, "
             "audio_fingerprint_enabled boolean, cross_resolution_mode string, probe_backend string, scan_set_key string, status string",
    "files": "id long, path string, normalized_path string, size long, mtime_ns long, ctime_ns long, ext string, scan_id long, exists_flag boolean",
    "video_meta": "file_id long, probe_backend string, probed_at string, source_size long, source_mtime_ns long, duration_s double, width int, height int, fps double, bit_depth int, "
                  "hdr_format string, container string, codec_profile string, codec_level string, is_interlaced boolean, codec string, bitrate long, audio_stream_count int, "
                  "audio_codec string, audio_bitrate long, audio_languages string, subtitle_languages string, probe_error string",
    "fingerprints": "file_id long, probe_backend string, algo_version int, source_size long, source_mtime_ns long, frame_count int, hash_blob binary, created_at string",
    "fingerprint_decoder_provenance": "file_id long, probe_backend string, algo_version int, decoder_backend string, attempts_json string, created_at string",
    "audio_fingerprints": "file_id long, source_size long, source_mtime_ns long, fingerprint_text string, created_at string",
    "duplicate_groups": "id long, scan_id long, profile string, created_at string, total_size_bytes long",
    "duplicate_group_items": "group_id long, file_id long, similarity_score double, keep_default boolean, match_reason string, match_duration_delta_s double, selected_action string",
    "action_runs": "id long, scan_id long, mode string, created_at string, status string",
    "action_items": "id long, run_id long, file_id long, source_path string, target_path string, result string, error_text string",
    "scan_issues": "id long, scan_id long, created_at string, stage string, path string, message string",
    "scan_failed_files": "scan_id long, normalized_path string, display_path string, stage string, message string, created_at string, updated_at string",
    "scan_links": "scan_id long, link_kind string, link_path string, target_original_path string, target_exists_flag boolean, source_root string",
}
KEYS = {
    "scans": ["id"], "files": ["id"], "video_meta": ["file_id", "probe_backend"], "fingerprints": ["file_id", "probe_backend", "algo_version"],
    "fingerprint_decoder_provenance": ["file_id", "probe_backend", "algo_version"], "audio_fingerprints": ["file_id"], "duplicate_groups": ["id"],
    "duplicate_group_items": ["group_id", "file_id"], "action_runs": ["id"], "action_items": ["id"], "scan_issues": ["id"],
    "scan_failed_files": ["scan_id", "normalized_path"], "scan_links": ["scan_id", "link_path"],
}
#: The column that says which file a row is about: tables that have it are laid out in buckets of it.
FILE_COLUMN = {"files": "id", "video_meta": "file_id", "fingerprints": "file_id", "fingerprint_decoder_provenance": "file_id", "audio_fingerprints": "file_id", "duplicate_group_items": "file_id"}


def typed(name: str, rows: DataFrame) -> DataFrame:
    """rows as the table `name`: its columns in order and of its types; missing ones are null, others left out."""
    kind = T._parse_datatype_string(SCHEMAS[name])
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind])


def broken_keys(name: str, rows: DataFrame) -> DataFrame:
    """Keys of a table with how many rows hold them, where that is not one, or a part of them is null."""
    missing = F.lit(False)
    for k in KEYS[name]:
        missing = missing | F.col(k).isNull()
    return rows.groupBy(*KEYS[name]).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | missing)


def store_bucketed(spark: SparkSession, name: str, rows: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Write rows as `table` at path, in sorted buckets of the file, and read it: joins of such tables on the file need no exchange.

    The number of buckets is fixed once: about the size of all such tables at their largest over 128 MB.
    """
    key = FILE_COLUMN[name]
    dealt = typed(name, rows).repartition(buckets, key)  # a file a bucket
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return spark.table(table)
