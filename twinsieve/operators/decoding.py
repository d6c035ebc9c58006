"""The boundary to decoders and probes: functions plugged in by name, ordered fallbacks, time limits, a record of every attempt.

A back-end is a function of a row (a dict of the columns given) that returns what it read or raises.
Attempts run in a child process of the task, which is killed and started anew where one exceeds its
limit or takes the process down, so that a stuck or crashing library costs one attempt and no task.
Rows keep their order and nothing is shuffled. Null contents, unknown back-ends and empty chains are
failed attempts or none, never errors of the job.
"""

from __future__ import annotations

import json
import multiprocessing
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X

#: Seconds an attempt may take, how much longer for risky formats, and the decoders in order.
LIMIT_S, RISKY_FACTOR, LEAST_LIMIT_S = 15.0, 4.0, 0.1
CHAIN, RISKY_CHAIN = ("opencv", "pyav", "ffmpeg"), ("ffmpeg", "pyav")
FRAME_WIDTH, FRAME_HEIGHT = 9, 8

Backend = Callable[[dict], object]
_TRIES = "array<struct<backend:string,status:string,message:string>>"


class _Child:
    """A process that runs attempts one after another."""

    def __init__(self, backends: dict[str, Backend]):
        self.backends, self.process, self.pipe = backends, None, None

    def _serve(self, pipe, other) -> None:
        other.close()
        while True:
            try:
                name, row = pipe.recv()
            except EOFError:
                return
            try:
                pipe.send(("success", "", self.backends[name](row)))
            except Exception as e:  # what a back-end raises is its answer
                pipe.send(("error", str(e) or type(e).__name__, None))

    def run(self, name: str, row: dict, limit_s: float) -> tuple[str, str, object]:
        if name not in self.backends:
            return "error", f"no back-end {name}", None
        if self.process is None:
            fork = multiprocessing.get_context("fork")
            self.pipe, far = fork.Pipe()
            self.process = fork.Process(target=self._serve, args=(far, self.pipe), daemon=True)
            self.process.start()
            far.close()
        self.pipe.send((name, row))
        if not self.pipe.poll(limit_s):
            self.close()
            return "timeout", f"{name} took more than {limit_s:g} s", None
        try:
            return self.pipe.recv()
        except EOFError:
            self.close()
            return "error", f"{name} ended its process", None

    def close(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.pipe.close()
            self.process = None


def attempt_chain(rows: DataFrame, backends: dict[str, Backend], chain: Column, limit_s: Column, given: list[str], result: T.DataType, name: str = "read") -> DataFrame:
    """rows with attempts, backend (the one that succeeded, else null) and `name`, its result.

    The back-ends of chain are tried in order, each for at most limit_s, until one succeeds.
    """
    columns = rows.columns
    d = rows.withColumn("_chain", chain).withColumn("_limit", limit_s.cast("double"))
    schema = T.StructType([*rows.schema.fields, T.StructField("attempts", T._parse_datatype_string(_TRIES)), T.StructField("backend", T.StringType()), T.StructField(name, result)])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        told = to_arrow_schema(schema)
        child = _Child(backends)
        try:
            for batch in batches:
                tries, used, found = [], [], []
                for row in batch.select([*given, "_chain", "_limit"]).to_pylist():
                    names, limit = row.pop("_chain") or [], row.pop("_limit") or LIMIT_S
                    made, good, read = [], None, None
                    for b in names:
                        status, message, answer = child.run(b, row, limit)
                        made.append({"backend": b, "status": status, "message": message})
                        if status == "success":
                            good, read = b, answer
                            break
                    tries.append(made)
                    used.append(good)
                    found.append(read)
                new = [pa.array(v, told.field(c).type) for c, v in (("attempts", tries), ("backend", used), (name, found))]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).cast(told.field(c).type) for c in columns], *new], schema=told)
        finally:
            child.close()

    return d.mapInArrow(run, schema)


def decoder_chain(path: Column) -> Column:
    risky = X.suffix(path).isin(*X.RISKY_SUFFIXES)
    return F.when(risky, F.array(*map(F.lit, RISKY_CHAIN))).otherwise(F.array(*map(F.lit, CHAIN)))


def decoder_limit(path: Column, limit_s: float = LIMIT_S) -> Column:
    factor = F.when(X.suffix(path).isin(*X.RISKY_SUFFIXES), RISKY_FACTOR).otherwise(1.0)
    return F.greatest(F.lit(LEAST_LIMIT_S), F.lit(float(limit_s)) * factor)


def _checked(decoder: Backend) -> Backend:
    """A decoder whose frames are arrays of FRAME_WIDTH x FRAME_HEIGHT grey pixels, or null; none at all is an error."""

    def run(row):
        frames = decoder(row)
        cells = FRAME_WIDTH * FRAME_HEIGHT
        told = [None if f is None or not len(f) else [int(p) for p in f] for f in frames]
        if any(f is not None and len(f) != cells for f in told):
            raise ValueError(f"a frame has not {FRAME_WIDTH} x {FRAME_HEIGHT} pixels")
        flat = lambda f: all(f[i] <= f[i - 1] for i in range(1, cells) if i % FRAME_WIDTH)
        if all(f is None or flat(f) for f in told):
            raise ValueError("no sample frame could be decoded")
        return told

    return run


def decode_frames(files: DataFrame, decoders: dict[str, Backend], path: str = "path", duration: str = "duration_s", content: str | None = None, times: Column | None = None, limit_s: float = LIMIT_S) -> DataFrame:
    """files with times (the sampled seconds), attempts, backend, fallback, hashes, provenance and error.

    A decoder gets path, times and, where named, the content, and returns a grey frame of 9 x 8 pixels
    per time, or None. fallback is the back-end used if it was not the first one tried; files that
    no decoder read have null hashes and all messages as error.
    """
    given = ["path", "times", *([content] if content else [])]
    rows = files if path == "path" else files.withColumn("path", F.col(path))
    rows = rows.withColumn("times", X.sample_times(F.col(duration)) if times is None else times)
    frames = T.ArrayType(T.ArrayType(T.IntegerType()))
    d = attempt_chain(rows, {k: _checked(f) for k, f in decoders.items()}, decoder_chain(F.col("path")), decoder_limit(F.col("path"), limit_s), given, frames, "frames")
    zero = F.lit(0).cast("bigint")
    hashes = F.transform("frames", lambda f: F.when(f.isNotNull(), X.grid_hash(f, FRAME_WIDTH, FRAME_HEIGHT)).otherwise(zero))
    first = F.try_element_at("attempts", F.lit(1))["backend"]
    messages = F.array_join(F.filter(F.transform("attempts", lambda t: t["message"]), lambda m: m != ""), " | ")
    bypass = F.try_element_at("attempts", F.lit(1))["backend"] != CHAIN[0]
    told = F.to_json(F.struct(
        F.transform("attempts", lambda t: F.struct(t["backend"].alias("decoder_backend"), t["message"].alias("message"), t["status"].alias("status"))).alias("attempts"),
        F.col("backend").alias("decoder_backend"), F.coalesce(bypass, F.lit(False)).alias("risky_format_bypass"),
    ))
    return d.select(
        *files.columns, "times", "attempts", "backend", F.when(F.col("backend") != first, F.col("backend")).alias("fallback"), hashes.alias("hashes"),
        F.when(F.col("backend").isNotNull(), told).alias("provenance"), F.when(F.col("backend").isNull(), F.when(messages != "", messages).otherwise("no sample frame could be decoded")).alias("error"),
    )


def probe_files(files: DataFrame, probes: dict[str, Backend], wanted: Column, given: list[str], limit_s: float = LIMIT_S) -> DataFrame:
    """files with attempts, backend and probe_json, from the one probe that wanted names (else the default one).

    A probe returns the document of container and streams, as a dict or as JSON, which `parse_probe` reads.
    """
    as_text = lambda f: lambda row: v if isinstance(v := f(row), str) else json.dumps(v)
    return attempt_chain(files, {k: as_text(f) for k, f in probes.items()}, F.array(X.setting("backend", wanted)), F.lit(limit_s), given, T.StringType(), "probe_json")
