"""Changes of the stored catalogue, each within a transaction: artifacts, scans, members, purges, prunes and clones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sinks.versions import Transaction
from .catalogue import pruned, purged_scans

META_KEYS = ["file_id", "probe_backend"]
STAMPS = ["probed_at", "source_size", "source_mtime_ns"]
ERROR_CHARS = 500


def save_meta(tx: Transaction, rows: DataFrame) -> None:
    """Metadata of good probes: every column is set, and an earlier error is cleared."""
    tx.upsert("video_meta", rows.withColumn("probe_error", F.lit(None).cast("string")), META_KEYS)


def save_probe_errors(tx: Transaction, rows: DataFrame) -> None:
    """Failed probes: error and stamps are set, metadata of an earlier good probe stays; a file seen first has zeros and empty texts."""
    new = rows.withColumn("probe_error", F.left("probe_error", F.lit(ERROR_CHARS)))
    for f in tx.read("video_meta").schema:
        if f.name not in new.columns:
            new = new.withColumn(f.name, F.lit(8 if f.name == "bit_depth" else "" if f.dataType.typeName() == "string" else False if f.dataType.typeName() == "boolean" else 0).cast(f.dataType))
    tx.upsert("video_meta", new, META_KEYS, update=[*STAMPS, "probe_error"])


def add_scans(tx: Transaction, scans: DataFrame) -> None:
    tx.upsert("scans", scans, ["scan_id"], update=[])


def set_status(tx: Transaction, changes: DataFrame) -> None:
    """changes(scan_id, status): of scans that are there."""
    known = changes.join(tx.read("scans").select("scan_id"), "scan_id", "left_semi")
    tx.upsert("scans", known, ["scan_id"])


def rename_files(tx: Transaction, renamed: DataFrame) -> None:
    """renamed(scan_id, file_id, path, size, mtime_ns): path, stats and extension as they are now; the file is there."""
    known = renamed.join(tx.read("files").select("scan_id", "file_id"), ["scan_id", "file_id"], "left_semi")
    told = known.withColumn("ext", F.regexp_replace(X.suffix(F.col("path")), r"^\.", "")).withColumn("alive", F.lit(True))
    tx.upsert("files", told, ["scan_id", "file_id"])


def mark_missing(tx: Transaction, files: DataFrame) -> None:
    known = files.select("scan_id", "file_id").join(tx.read("files"), ["scan_id", "file_id"], "left_semi")
    tx.upsert("files", known.withColumn("alive", F.lit(False)), ["scan_id", "file_id"])


def remove_members(tx: Transaction, files: DataFrame) -> None:
    """Files leave every group they are in."""
    tx.delete("group_items", files.select("file_id"), ["file_id"])


def prune(tx: Transaction) -> DataFrame:
    """Groups of which fewer than two files are there go, with their items; returns them with alive."""
    items, files = tx.read("group_items"), tx.read("files").select("file_id", "alive")
    gone = pruned(tx.read("groups"), items, files)
    tx.delete("group_items", gone.select("group_id"), ["group_id"])
    tx.delete("groups", gone.select("group_id"), ["group_id"])
    return gone


def purge(tx: Transaction, key: str, roots: list[str], owned: list[str]) -> DataFrame:
    """Scans of a set, or with files under the roots, go with the rows that tables `owned` have of them; returns their ids."""
    gone = purged_scans(tx.read("scans"), tx.read("files"), key, roots)
    for name in [*owned, "scans"]:
        tx.delete(name, gone, ["scan_id"])
    return gone


def same_version(a: str, b: str) -> Column:
    """Whether two sides hold the same state of a file: equal size and modification time."""
    return (F.col(f"{a}.size") == F.col(f"{b}.size")) & (F.col(f"{a}.mtime_ns") == F.col(f"{b}.mtime_ns"))


def clone_artifacts(source: DataFrame, artifacts: DataFrame, target: DataFrame, backend: str | None = None) -> DataFrame:
    """Artifacts of source files carried over to target files of the same path key that are unchanged.

    source, target: file_id, path, size, mtime_ns; artifacts: file_id, source_size, source_mtime_ns and what they hold, of one
    probe back-end if it is named. An artifact made of another state of the file stays behind.
    """
    held = artifacts if backend is None else artifacts.filter(F.col("probe_backend") == backend)
    s = source.select("file_id", "size", "mtime_ns", X.path_key(F.col("path")).alias("_key")).alias("s")
    t = target.select(F.col("file_id").alias("_to"), "size", "mtime_ns", X.path_key(F.col("path")).alias("_to_key")).alias("t")
    pairs = s.join(t, (F.col("_key") == F.col("_to_key")) & same_version("s", "t")).select(F.col("s.file_id"), "_to", F.col("s.size").alias("_size"), F.col("s.mtime_ns").alias("_mtime"))
    kept = held.join(pairs, "file_id").filter((F.col("source_size") == F.col("_size")) & (F.col("source_mtime_ns") == F.col("_mtime")))
    return kept.select(*[F.col("_to").alias(c) if c == "file_id" else c for c in artifacts.columns])
