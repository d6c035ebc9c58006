"""Decoders and probes plugged in, sampled files, versioned tables and their changes, on small cases."""

import hashlib
import os
import struct
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsieve.functions import exprs as X
from twinsieve.operators import changes as D
from twinsieve.operators.decoding import attempt_chain, decode_frames, probe_files
from twinsieve.operators.probe import parse_probe
from twinsieve.sinks.versions import Catalogue, Conflict
from twinsieve.sources.samples import file_digests, write_files

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the back-ends below travel to the workers


def fails(row):
    raise OSError("cannot open")


def sleeps(row):
    time.sleep(30)


def dies(row):
    os._exit(1)


def ramp(row):
    """Frames that grow brighter to the right where the time is even, none elsewhere."""
    return [[i % 9 for i in range(72)] if int(t) % 2 == 0 else None for t in row["times"]]


def dark(row):
    return [[0] * 72 for _ in row["times"]]


FILES = "path string, duration_s double, attempts string"


def test_first_success_wins(spark):
    rows = spark.createDataFrame([("/a/x.mp4", 10.0, "own"), ("/a/y.avi", 10.0, "own"), (None, None, None)], FILES)
    got = {r.path: r for r in decode_frames(rows.drop("attempts"), {"opencv": fails, "pyav": ramp, "ffmpeg": dark}, limit_s=5).collect()}
    x, y, none = got["/a/x.mp4"], got["/a/y.avi"], got[None]
    assert [(t.backend, t.status, t.message) for t in x.attempts] == [("opencv", "error", "cannot open"), ("pyav", "success", "")]
    assert x.backend == x.fallback == "pyav" and x.error is None and len(x.times) == 12 and x.times == pytest.approx([p * 10 for p in X.SAMPLE_PERCENTS])
    assert x.hashes == [-1 if int(t) % 2 == 0 else 0 for t in x.times]  # every pixel brighter than the one before it: all bits set
    assert '"risky_format_bypass":false' in x.provenance and '"decoder_backend":"pyav"' in x.provenance
    assert [t.backend for t in y.attempts] == ["ffmpeg", "pyav"] and y.attempts[0].message == "no sample frame could be decoded" and '"risky_format_bypass":true' in y.provenance
    assert none.times == [0.0] * 12 and none.backend == "pyav"  # no duration: all samples at the start
    (lost,) = decode_frames(rows.drop("attempts").limit(1), {"opencv": fails, "pyav": dark}, limit_s=5).collect()
    assert lost.backend is None and lost.hashes is None and lost.provenance is None and lost.error == "cannot open | no sample frame could be decoded | no back-end ffmpeg"


def test_limits_and_crashes_cost_one_attempt(spark):
    rows = spark.range(6).select(F.col("id"))
    chain = F.when(F.col("id") % 3 == 0, F.array(F.lit("sleeps"), F.lit("ramp"))).when(F.col("id") % 3 == 1, F.array(F.lit("dies"), F.lit("ramp"))).otherwise(F.array(F.lit("gone")))
    began = time.time()
    got = attempt_chain(rows.coalesce(1), {"sleeps": sleeps, "dies": dies, "ramp": lambda r: r["id"] * 2}, chain, F.lit(0.3), ["id"], T.LongType()).orderBy("id").collect()
    assert time.time() - began < 25
    assert [[t.status for t in r.attempts] for r in got] == [["timeout", "success"], ["error", "success"], ["error"]] * 2
    assert [r.read for r in got] == [0, 2, None, 6, 8, None] and got[2].attempts[0].message == "no back-end gone"


def test_empty_chain_and_table(spark):
    none = F.array().cast("array<string>")
    assert attempt_chain(spark.range(1), {}, none, F.lit(1), ["id"], T.LongType()).first().attempts == []
    assert attempt_chain(spark.range(0), {"a": fails}, none, F.lit(1), ["id"], T.LongType()).count() == 0


def test_probe_is_chosen_by_name(spark):
    probes = {"pyav": lambda r: {"format": {"duration": 2.5}, "streams": [{"codec_type": "video", "codec_name": "VP9", "width": 4, "height": 3}]}, "ffprobe": fails}
    rows = spark.createDataFrame([(1, "PYAV"), (2, "ffprobe "), (3, None)], "k int, wanted string")
    got = {r.k: r for r in parse_probe(probe_files(rows, probes, F.col("wanted"), ["k"]), "probe_json").collect()}
    assert (got[1].backend, got[1].duration_s, got[1].codec, got[1].width) == ("pyav", 2.5, "vp9", 4) and got[3].backend == "pyav"
    assert got[2].backend is None and got[2].attempts[0].message == "cannot open" and got[2].probe_error


def test_digests_equal_hashlib(spark, tmp_path):
    rows = [(f"f{n}", bytes((i * 7 + n) % 256 for i in range(n))) for n in (0, 1, 63, 64, 65, 200, 5000, 70_000)]
    files = write_files(spark.createDataFrame(rows, "name string, content binary"), str(tmp_path), "name", "content").cache()
    got = {r.name: r for r in file_digests(files, block=64).collect()}
    for name, raw in rows:
        n, span = len(raw), max(0, len(raw) - 64)
        out = hashlib.sha256(struct.pack(">Q", n))
        for o in sorted({0, span, round(span * 0.23), round(span * 0.78)}):
            part = (tmp_path / name).read_bytes()[o : o + 64]
            out.update(struct.pack(">QQ", o, len(part)) + part)
        assert (got[name].size, got[name].digest, got[name].error) == (n, out.hexdigest(), None)
    odd = spark.createDataFrame([(f"{tmp_path}/f64", 65), (f"{tmp_path}/none", 3), (str(tmp_path), 3), (None, 3), (f"file://{tmp_path}/f64", 64), ("nostore://x/y", 1), (f"{tmp_path}/f1", None)], "path string, size long")
    got = file_digests(odd, block=64).collect()
    assert [r.digest is None for r in got] == [True, True, True, True, False, True, True] and [r.error is None for r in got] == [False, False, False, False, True, False, False]


def test_versions(spark, tmp_path):
    c = Catalogue(spark, str(tmp_path), buckets=3)
    df = lambda rows: spark.createDataFrame(rows, "k long, a string, b long")
    tx = c.begin()
    tx.create("t", df([(1, "x", 1), (2, "y", 2), (3, "z", 3), (None, "n", 0)]), "k")
    tx.create("u", df([]), "k")
    assert tx.commit() == 1
    tx, late = c.begin(), c.begin()
    tx.upsert("t", df([(2, "Y", None), (9, "w", 9)]), ["k"], update=["b"])
    assert sorted(map(str, tx.read("t").collect())) != sorted(map(str, c.read("t").collect()))
    tx.delete("t", df([(3, "", 0)]), ["k"])
    tx.upsert("u", df([(5, "e", 5)]).select("k", "b"), ["k"])
    assert tx.commit() == 2
    rows = lambda name, v=None: sorted(map(tuple, c.read(name, v).collect()), key=str)
    assert rows("t") == sorted([(1, "x", 1), (2, "y", None), (9, "w", 9), (None, "n", 0)], key=str) and rows("u") == [(5, None, 5)]
    assert (3, "z", 3) in rows("t", 1) and rows("u", 1) == []
    late.delete("t", df([(1, "", 0)]), ["k"])
    with pytest.raises(Conflict):
        late.commit()
    assert rows("t")[0] == (1, "x", 1) and c.versions() == [1, 2]
    assert c.vacuum() >= 1 and c.versions() == [2] and len(rows("t")) == 4
    again = c.begin()  # a rerun of the late one
    again.delete("t", df([(1, "", 0)]), ["k"])
    assert again.commit() == 3 and len(rows("t")) == 3


def test_untouched_buckets_stay(spark, tmp_path):
    c = Catalogue(spark, str(tmp_path), buckets=4)
    tx = c.begin()
    tx.create("t", spark.range(100).withColumnRenamed("id", "k"), "k")
    tx.commit()
    before = c.state()[1]["t"]["parts"]
    tx = c.begin()
    tx.delete("t", spark.range(1).withColumnRenamed("id", "k"), ["k"])
    tx.commit()
    after = c.state()[1]["t"]["parts"]
    assert sum(before[p] != after[p] for p in before) == 1 and c.read("t").count() == 99


def test_a_later_error_keeps_metadata(spark, tmp_path):
    kind = "file_id long, probe_backend string, probed_at string, source_size long, source_mtime_ns long, duration_s double, width int, bit_depth int, codec string, is_interlaced boolean, probe_error string"
    c = Catalogue(spark, str(tmp_path))
    tx = c.begin()
    tx.create("video_meta", spark.createDataFrame([(1, "pyav", "t1", 5, 5, 9.0, 640, 10, "vp9", True, None)], kind), "file_id")
    D.save_probe_errors(tx, spark.createDataFrame([(1, "pyav", "t2", 6, 6, "e" * 900), (1, "ffprobe", "t2", 6, 6, "bad")], "file_id long, probe_backend string, probed_at string, source_size long, source_mtime_ns long, probe_error string"))
    tx.commit()
    got = {r.probe_backend: r for r in c.read("video_meta").collect()}
    assert tuple(got["pyav"]) == (1, "pyav", "t2", 6, 6, 9.0, 640, 10, "vp9", True, "e" * 500)
    assert tuple(got["ffprobe"]) == (1, "ffprobe", "t2", 6, 6, 0.0, 0, 8, "", False, "bad")
    tx = c.begin()
    D.save_meta(tx, c.read("video_meta").filter("probe_backend = 'pyav'").drop("probe_error").withColumn("probed_at", F.lit("t3")))
    tx.commit()
    assert {r.probe_backend: r.probe_error for r in c.read("video_meta").collect()} == {"pyav": None, "ffprobe": "bad"}
