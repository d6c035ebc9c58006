"""Listing of files under roots as a data source: a partition a root, so that one drive is read by one task.

Rows: kind (file, symlink or issue), path, size, mtime_ns, device, inode, target, target_exists,
source_root, message. Symlinked folders are not entered. A root that is missing, no folder or a
network path gives an issue row, and so does a folder that cannot be read.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "kind string, path string, size long, mtime_ns long, device long, inode long, target string, target_exists boolean, source_root string, message string"


class _Root(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.roots = [r for r in options.get("roots", "").split("\n") if r]
        self.suffixes = tuple(f".{e}" for e in options.get("extensions", "").split(",") if e)

    def partitions(self):
        return [_Root(r) for r in self.roots] or [_Root("")]

    def read(self, partition):
        root = partition.value
        if not root:
            return
        issue = lambda path, message: ("issue", path, None, None, None, None, None, None, root, message)
        if root.startswith(("\\\\", "//")):
            yield issue(root, "Network paths are not scanned")
            return
        if not os.path.exists(root):
            yield issue(root, "Path does not exist")
            return
        if not os.path.isdir(root):
            yield issue(root, "Path is not a folder")
            return
        open_folders = [root]
        while open_folders:
            folder = open_folders.pop()
            try:
                entries = sorted(os.scandir(folder), key=lambda e: (e.name.lower(), e.name))
            except OSError as e:
                yield issue(folder, str(e))
                continue
            for e in entries:
                wanted = not self.suffixes or os.path.splitext(e.name)[1].lower() in self.suffixes
                try:
                    if e.is_symlink():
                        if wanted and not os.path.isdir(e.path):
                            yield ("symlink", e.path, None, None, None, None, os.path.realpath(e.path), os.path.exists(e.path), root, None)
                    elif e.is_dir(follow_symlinks=False):
                        open_folders.append(e.path)
                    elif wanted and e.is_file(follow_symlinks=False):
                        s = e.stat(follow_symlinks=False)
                        yield ("file", e.path, s.st_size, s.st_mtime_ns, s.st_dev, s.st_ino, None, None, root, None)
                except OSError as error:
                    yield issue(e.path, str(error))


class FileListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def list_files(spark: SparkSession, roots: list[str], extensions: list[str], min_mib: float = 0, max_mib: float = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files within the size limits (max_mib 0: none), links (symlinks and further hard links), and issues."""
    from ..operators.tables import hardlinks

    spark.dataSource.register(FileListing)
    clean = ",".join(dict.fromkeys(e.strip().lower().lstrip(".") for e in extensions))
    rows = spark.read.format("file_listing").option("roots", "\n".join(roots)).option("extensions", clean).load()
    fits = F.col("size") >= F.lit(min_mib) * 1048576
    if max_mib > 0:
        fits = fits & (F.col("size") <= F.lit(max_mib) * 1048576)
    told = hardlinks(rows.filter((F.col("kind") == "file") & fits).drop("kind", "target"), ["device", "inode"], "path")
    files = told.filter("kind = 'canonical'").select("path", "size", "mtime_ns", "source_root")
    hard = told.filter("kind = 'hardlink'").select(F.lit("hardlink").alias("link_kind"), F.col("path").alias("link_path"), F.col("target").alias("target_original_path"), F.lit(True).alias("target_exists"), "source_root")
    soft = rows.filter("kind = 'symlink'").select(F.lit("symlink").alias("link_kind"), F.col("path").alias("link_path"), F.col("target").alias("target_original_path"), "target_exists", "source_root")
    return files, soft.unionByName(hard), rows.filter("kind = 'issue'").select("path", "source_root", "message")
