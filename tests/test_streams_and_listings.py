"""Streams with keyed state, progress, numbering, lanes, stored tables and listings, on small cases."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from twinsieve.operators import listings as L
from twinsieve.operators.catalogue import cached_artifacts
from twinsieve.operators.numbering import dispatch_order, lane_tasks, numbered
from twinsieve.operators.tables import incremental
from twinsieve.sources import schemas as H
from twinsieve.streaming import progress as S
from twinsieve.streaming.state import failure_stream, incremental_stream, ordered_stream, run_to_table


def feed(spark, tmp_path, schema, make, batches, mode="append", **options):
    """The rows written after all batches, the stream stopped and started again for each."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).options(**options).parquet(f"{tmp_path}/in")
        run_to_table(make(source), f"{tmp_path}/out", f"{tmp_path}/checkpoint", mode)
    return spark.read.parquet(f"{tmp_path}/out")


def test_incremental_stream_equals_the_batch(spark, tmp_path):
    g = random.Random(2)
    scans = [{f"/f{i}": g.choice("ab") for i in range(40) if g.random() < 0.7} for _ in range(4)]
    scans[2]["/null"] = None
    rows = [[(n, 1000 * n, v, p) for p, v in files.items()] for n, files in enumerate(scans, 1)]
    rows[1] += rows[1][:3]  # told twice
    schema = "scan_id long, sec long, version string, path string"
    make = lambda f: incremental_stream(f.select("scan_id", F.timestamp_seconds("sec").alias("at"), "version", "path"), ["path"])
    got = feed(spark, tmp_path, schema, make, rows).collect()
    df = lambda n: spark.createDataFrame([(v, p) for p, v in scans[n - 1].items()], "version string, path string")
    assert {(r.path, r.state) for r in got if r.scan_id == 1} == {(p, "new") for p in scans[0]}
    for n in (2, 3, 4):
        said = sorted(tuple(r) for r in incremental(df(n - 1), df(n), ["path"], ["version"]).collect())
        assert sorted((r.path, r.state) for r in got if r.scan_id == n) == said


def test_failure_stream_restores_its_state(spark, tmp_path):
    schema = "path string, at long, bad int"
    batches = [[("/a", 5, 1), ("/b", 5, 1), ("/b", 5, 0), ("/c", 1, 0)], [("/a", 4, 0), ("/c", 9, 1)], [("/a", 6, 0)]]
    out = feed(spark, tmp_path, schema, lambda f: failure_stream(f, ["path"]), batches, mode="update")
    newest = {}
    for r in sorted(out.collect(), key=lambda r: r.batch):
        newest[r.path] = (r.at, r.bad)
    assert newest == {"/a": (6, 0), "/b": (5, 0), "/c": (9, 1)}
    assert sum(r.path == "/a" for r in out.collect()) == 2  # the late success of the second batch changed nothing


def test_ordered_release(spark, tmp_path):
    schema = "lane int, seq long, payload string"
    batches = [[(1, 2, "c"), (1, 0, "a"), (2, 1, "y")], [(1, 1, "b"), (1, 0, "a"), (1, 4, "e")], [(2, 0, "x"), (1, 3, "d"), (1, 2, "c")]]
    out = feed(spark, tmp_path, schema, lambda f: ordered_stream(f, "lane"), batches).collect()
    assert sorted((r.lane, r.seq, r.payload) for r in out) == [(1, i, p) for i, p in enumerate("abcde")] + [(2, 0, "x"), (2, 1, "y")]
    when = {(r.lane, r.seq): r.batch for r in out}
    assert [when[1, i] for i in range(5)] == [0, 1, 1, 2, 2] and when[2, 0] == when[2, 1] == 2


def test_listener_counts_the_input(spark, tmp_path):
    spark.range(90).repartition(4).write.parquet(f"{tmp_path}/in")
    with S.ProgressLog.on(spark, most=2) as log:
        q = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        log.wait(q.id)
    assert len(log.rows) == 2 and log.left >= 2 and log.table(spark).agg(F.sum("rows")).first()[0] <= 90
    seconds = {r.stage: r for r in S.stage_seconds(log.table(spark)).collect()}
    assert seconds["addBatch"].batches >= 1 and seconds["triggerExecution"].seconds > 0


def test_stage_clock():
    clock = S.StageClock()
    for n in (10, 30):
        with clock.stage("db_write") as add:
            add(n)
    with pytest.raises(KeyError), clock.stage("probe"):
        time.sleep(0.01)
        raise KeyError
    m = json.loads(clock.document())
    assert m["flush_count"] == 2 and m["avg_rows_per_flush"] == 20 and m["stage_seconds"]["probe"] >= 0.01 and S.StageClock().metrics()["avg_rows_per_flush"] == 0


def test_shown_progress(spark):
    rows = [("r", i, float(i), "a" if i < 6 else "b", i, i == 3) for i in range(12)] + [("q", 0, 0.0, None, 0, None)]
    got = S.emitted(spark.createDataFrame(rows, "run string, seq long, at double, stage string, counter long, forced boolean"), 4, 100.0).collect()
    assert sorted((r.run, r.seq) for r in got) == [("q", 0), ("r", 0), ("r", 3), ("r", 6), ("r", 10)]


def test_numbers_over_the_whole_order(spark):
    g = random.Random(3)
    rows = [(g.choice([None, 1, 1, 1, 2, 9]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, i long").repartition(7)
    got = {r.i: r.position for r in numbered(df, F.desc_nulls_last("k"), "i").collect()}
    said = [i for _, i in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))]
    assert [got[i] for i in said] == list(range(1, 501))
    assert numbered(df.filter("i < 0"), "i").count() == 0
    assert "Window" not in numbered(df, "i")._jdf.queryExecution().executedPlan().toString()


def test_turns_of_lanes(spark):
    files = spark.createDataFrame([(lane, i, 2 if lane == 1 else None) for lane, n in ((1, 5), (2, 2), (3, 1)) for i in range(n)], "lane int, i int, cap int")
    got = [(r.lane, r.i) for r in dispatch_order(files, "lane", ["i"], "cap").orderBy("dispatched").collect()]
    assert got == [(1, 0), (1, 1), (2, 0), (3, 0), (1, 2), (1, 3), (2, 1), (1, 4)]
    caps = spark.createDataFrame([(1, 2), (2, 0)], "lane int, cap int")
    dealt = lane_tasks(files.drop("cap"), "lane", ["i"], caps).withColumn("ran", F.spark_partition_id()).collect()
    assert all(r.ran == r.task for r in dealt) and {r.task for r in dealt if r.lane == 1} == {0, 1} and {r.task for r in dealt if r.lane == 2} == {2} and {r.task for r in dealt if r.lane == 3} == {3}
    assert lane_tasks(files.filter("lane > 5").drop("cap"), "lane", ["i"], caps).count() == 0


def stored(spark, **rows):
    t = {name: spark.createDataFrame([], kind) for name, kind in H.SCHEMAS.items()}
    for name, values in rows.items():
        t[name] = spark.createDataFrame([[v.get(f.name) for f in t[name].schema] for v in values], t[name].schema)
    return t


def test_match_items_need_no_exchange_on_files(spark, tmp_path):
    blob = bytes(range(8)) * 12
    meta = [{"file_id": i, "probe_backend": b, "duration_s": 0.0 if i == 4 else 5.0, "width": 1, "height": 1, "codec": "h264", "probe_error": "late" if i == 1 else None} for i in range(1, 7) for b in ("pyav", "ffprobe")]
    t = stored(
        spark, scans=[{"id": 1, "probe_backend": "pyav"}, {"id": 2, "probe_backend": "ffprobe"}], video_meta=meta,
        files=[{"id": i, "path": f"/{i}", "normalized_path": f"/{i}", "scan_id": 1 + i % 2, "exists_flag": i != 5} for i in range(1, 8)],
        fingerprints=[{"file_id": i, "probe_backend": b, "algo_version": v, "hash_blob": blob} for i, b, v in ((1, "ffprobe", 1), (2, "pyav", 1), (2, "pyav", 2), (3, "pyav", 1), (4, "pyav", 1), (5, "ffprobe", 1), (6, "pyav", 1), (7, "ffprobe", 1))],
        audio_fingerprints=[{"file_id": 2, "fingerprint_text": "sound"}], scan_failed_files=[{"scan_id": 1, "normalized_path": "/6"}, {"scan_id": 1, "normalized_path": "/1"}],
    )
    for name in ("files", "video_meta", "fingerprints", "audio_fingerprints"):
        t[name] = H.store_bucketed(spark, name, t[name], f"t_{name}", f"{tmp_path}/{name}", 4)
    out = L.match_items(t, 1)
    got = {r.file_id: r for r in out.collect()}
    assert set(got) == {1, 2} and len(out.columns) == 25  # 3: hashes of the other back-end; 4: no duration; 5: gone; 6: failed; 7: no metadata
    assert (got[2].audio_fingerprint, got[1].audio_fingerprint, got[1].bit_depth, got[1].hdr_format, len(got[1].hashes)) == ("sound", "", 8, "", 12)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = L.match_items(t, 1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    of_scans = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert of_scans and not [line for line in of_scans if "scan_id" not in line], plan
    for name in ("files", "video_meta", "fingerprints", "audio_fingerprints"):
        spark.sql(f"DROP TABLE t_{name}")


def test_broken_keys(spark):
    t = stored(spark, fingerprints=[{"file_id": 1, "probe_backend": "a", "algo_version": v} for v in (1, 1, 2, None)])
    assert sorted((r.algo_version or 0, r.n) for r in H.broken_keys("fingerprints", t["fingerprints"]).collect()) == [(0, 1), (1, 2)]
    assert all(set(H.KEYS[n]) <= set(t[n].columns) for n in H.SCHEMAS) and len(t) == 13


def test_listings(spark):
    t = stored(
        spark, scan_issues=[{"id": i, "scan_id": i % 2, "stage": None, "path": f"/{i}"} for i in (9, 3, 4, 7)], scan_links=[{"scan_id": 1, "link_kind": k, "link_path": p} for k, p in ((" SYMLINK ", "/b"), (None, "/a"))],
        scans=[{"id": 3, "roots_json": "no list", "extensions_json": None, "custom_similarity_threshold": 9.0, "cross_resolution_mode": None, "scan_set_key": "k", "status": "done"}, {"id": 8, "scan_set_key": "", "status": "done"}],
        files=[{"id": 1, "scan_id": 3, "exists_flag": True, "path": "/x"}, {"id": 2, "scan_id": 3, "exists_flag": False, "path": "/y"}], duplicate_groups=[{"id": 50, "scan_id": 3}],
        duplicate_group_items=[{"group_id": 50, "file_id": 1}, {"group_id": 50, "file_id": 2}],
    )
    assert sorted((r.scan_id, r.position, r.path, r.stage) for r in L.issue_rows(t).collect()) == [(0, 1, "/4", ""), (1, 1, "/3", ""), (1, 2, "/7", ""), (1, 3, "/9", "")]
    assert [(r.link_path, r.link_kind, r.target_exists) for r in L.link_rows(t).collect()] == [("/a", "hardlink", False), ("/b", "symlink", False)]
    info = {r.id: r for r in L.scan_info(t["scans"]).collect()}[3]
    assert (info.roots, info.extensions, info.custom_similarity_threshold, info.cross_resolution_mode, info.probe_backend) == ([], [], 0.30, "off", "pyav")
    assert {r.scan_id: (r.groups, r.files, r.failed) for r in L.scan_counts(t).collect()} == {3: (1, 1, 0), 8: (0, 0, 0)}
    newest = lambda **o: [r.id for r in L.newest(t["scans"], **o).collect()]
    assert (newest(), newest(key="k"), newest(key=""), newest(key="none"), newest(key="k", status="paused")) == ([8], [3], [], [], [])
    assert L.failed_rows(t).count() == 0 and L.group_paths(t).count() == 2


def test_recent_roots_and_filters(spark):
    rows = [("o", i, r) for i, r in enumerate([" /A", "/a", "", None, *[f"/r{k}" for k in range(30)]])]
    got = L.recent_roots(spark.createDataFrame(rows, "owner string, at long, root string")).orderBy("position").collect()
    assert [r.root for r in got] == ["/A", *[f"/r{k}" for k in range(19)]]
    items = spark.createDataFrame([(1, 1048576, 5.0, None), (2, 1048577, 5.0, "HDR10"), (3, 10, 9.0, "")], "i int, size long, duration_s double, hdr_format string")
    kept = lambda **o: [r.i for r in items.filter(L.structured(**o)).collect()]
    assert kept(max_mib=1.0) == [1, 3] and kept(min_mib=1.0, hdr="exclude") == [1] and kept(hdr="only") == [2] and kept(max_s=5) == [1, 2] and kept() == [1, 2, 3]


def test_cached_artifacts_are_of_the_file_as_it_is(spark):
    now = spark.createDataFrame([("/a", 5, 5), ("/b", 5, 5), ("/c", 1, 1)], "path string, size long, mtime_ns long")
    kind = "path string, scan_id int, row_id int, probe_error string, " + ", ".join(f"{k} string, {k}_size long, {k}_mtime_ns long" for k in ("meta", "hashes", "audio"))
    cache = [("/a", 1, 1, None, "m1", 5, 5, "h1", 5, 5, None, None, None), ("/a", 2, 2, None, "m2", 6, 5, "h2", 5, 5, None, None, None), ("/b", 1, 3, "bad", "m3", 5, 5, "h3", 5, 5, "s3", 5, 5)]
    got = {r.path: (r.meta, r.hashes, r.audio, r.decision) for r in cached_artifacts(now, spark.createDataFrame(cache, kind), ["path"]).collect()}
    assert got == {"/a": ("m1", "h2", None, "cache_hit"), "/b": (None, "h3", "s3", "probe_and_fingerprint"), "/c": (None, None, None, "probe_and_fingerprint")}
