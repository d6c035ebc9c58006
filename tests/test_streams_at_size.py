"""Streams of many keys: what is told, and that no Python runs a key."""

import pytest
from pyspark.sql import functions as F

from twinsieve.streaming.state import failure_stream, incremental_stream, run_to_table


def written(spark, tmp_path, make, batches, mode):
    for rows in batches:
        rows.write.mode("append").parquet(f"{tmp_path}/in")
        run_to_table(make(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/checkpoint", mode)
    return spark.read.parquet(f"{tmp_path}/out")


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("make", [
    lambda f: incremental_stream(f.select("scan_id", F.timestamp_seconds("scan_id").alias("at"), "version", "path"), ["path"]),
    lambda f: failure_stream(f.select("path", F.col("scan_id").alias("at"), F.lit(1).alias("bad")), ["path"]),
])
def test_no_python_runs_a_key(spark, tmp_path, make):
    spark.createDataFrame([(1, "a", "/p")], "scan_id long, version string, path string").write.parquet(f"{tmp_path}/in")
    told = plan(make(spark.readStream.schema("scan_id long, version string, path string").parquet(f"{tmp_path}/in")))
    assert "Pandas" not in told and "transformWithState" not in told


def test_scans_of_one_batch_are_told_one_by_one(spark, tmp_path):
    """A file of the first and the third scan is deleted in the second, though all three come in one batch."""
    rows = [(0, "a", "/p"), (0, "a", "/q"), (1, "a", "/q"), (2, "a", "/p"), (2, None, "/q")]
    more = [(3, None, "/q")]
    df = lambda r: spark.createDataFrame(r, "scan_id long, version string, path string").coalesce(1)
    make = lambda f: incremental_stream(f.select("scan_id", F.timestamp_seconds("scan_id").alias("at"), "version", "path"), ["path"])
    got = written(spark, tmp_path, make, [df(rows), df(more)], "append")
    assert sorted((r.scan_id, r.path, r.state) for r in got.collect()) == [
        (0, "/p", "new"), (0, "/q", "new"), (1, "/p", "deleted"), (1, "/q", "unchanged"), (2, "/p", "new"), (2, "/q", "modified"), (3, "/p", "deleted"), (3, "/q", "unchanged"),
    ]


def test_marks_told_again_change_nothing(spark, tmp_path):
    df = lambda r: spark.createDataFrame(r, "path string, at long, bad int").coalesce(1)
    got = written(spark, tmp_path, lambda f: failure_stream(f, ["path"]), [df([("/a", 5, 1), ("/b", 5, 1)]), df([("/a", 5, 1), ("/b", 5, 0)])], "update")
    assert sorted((r.path, r.at, r.bad, r.batch) for r in got.collect()) == [("/a", 5, 1, 0), ("/b", 5, 0, 1), ("/b", 5, 1, 0)]
