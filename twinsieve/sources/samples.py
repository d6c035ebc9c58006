"""Sampled digests of files: executors read the sampled blocks at their places, never the whole file."""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X

#: Other names of stores that Arrow reads.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}


def open_store(uri: str):
    """The store and the path in it of a URI or a plain path."""
    from pyarrow import fs

    scheme, mark, rest = uri.partition("://")
    if not mark and uri.startswith("file:"):
        scheme, mark, rest = "file", "://", uri[5:]
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}") if mark else fs.FileSystem.from_uri(uri)


def file_digests(files: DataFrame, path: str = "path", size: str = "size", block: int = 1 << 20, a: int = 23, b: int = 78) -> DataFrame:
    """files with offsets, digest and error: SHA-256 over the size and the sampled blocks with their offsets and lengths, big-endian.

    Blocks lie at the start, the end and two percentages in between. A file that is missing, is no file, has
    another size than told or ends early has a null digest and an error; a null path or size too.
    """
    rows = files.withColumn("offsets", X.sample_offsets(F.col(size).cast("bigint"), block, a, b))
    columns = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("digest", T.StringType()), T.StructField("error", T.StringType())])

    def digest(uri: str | None, told: int | None, offsets: list[int] | None) -> str:
        if uri is None or told is None:
            raise ValueError("path or size is missing")
        store, at = open_store(uri)
        info = store.get_file_info(at)
        if info.type.name == "NotFound":
            raise FileNotFoundError("file is missing")
        if not info.is_file:
            raise OSError("path is not a file")
        if info.size != told:
            raise OSError(f"size is {info.size}, not {told}")
        out = hashlib.sha256(struct.pack(">Q", told))
        with store.open_input_file(at) as f:
            for o in offsets:
                n = max(0, min(block, told - o))
                out.update(struct.pack(">QQ", o, n))
                f.seek(o)
                data = f.read(n)
                if len(data) != n:
                    raise OSError("file ends early")
                out.update(data)
        return out.hexdigest()

    def read(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        for batch in batches:
            found, errors = [], []
            for r in batch.select([path, size, "offsets"]).to_pylist():
                try:
                    found.append(digest(r[path], r[size], r["offsets"]))
                    errors.append(None)
                except (OSError, ValueError) as e:  # pyarrow's errors are of these kinds
                    found.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).cast(kind.field(c).type) for c in columns], pa.array(found, pa.string()), pa.array(errors, pa.string())], schema=kind)

    return rows.mapInArrow(read, schema)


def write_files(rows: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """rows with path and size (bytes) of the files that hold their contents, written under folder; empty for null.

    A task that is run again writes the same bytes to the same names.
    """
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != content], T.StructField("path", T.StringType()), T.StructField("size", T.LongType())])

    def write(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        store, top = open_store(folder)
        store.create_dir(top, recursive=True)
        for batch in batches:
            paths, sizes = [], []
            for n, c in zip(batch.column(name).to_pylist(), batch.column(content).to_pylist(), strict=True):
                raw = c.encode() if isinstance(c, str) else bytes(c or b"")
                with store.open_output_stream(f"{top}/{n}") as f:
                    f.write(raw)
                paths.append(f"{folder}/{n}")
                sizes.append(len(raw))
            kept = [batch.column(f.name) for f in kind if f.name not in ("path", "size")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(paths), pa.array(sizes, pa.int64())], schema=kind)

    return rows.mapInArrow(write, schema)
