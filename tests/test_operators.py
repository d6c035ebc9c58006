"""Scalar functions, probe parsing, catalogue operators, plans, sinks, listings and streams on small cases."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from twinsieve.functions import exprs as X
from twinsieve.operators import catalogue as C
from twinsieve.operators import tables as T
from twinsieve.operators.probe import parse_probe
from twinsieve.plans import actions as P
from twinsieve.sinks import exports as E
from twinsieve.sources.listing import list_files
from twinsieve.streaming.microbatch import run_available


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("a", "b", "full", "pre"), [([1] * 8, [1] * 8, 0.0, 0.0), ([0], [3], 2 / 64, 2.0), ([0, 0], [1, 7], 2 / 64, 2.0), ([], [], 1.0, 64.0), ([0] * 3, [0] * 4, 1.0, 0.0)])
def test_distances_of_any_length(spark, a, b, full, pre):
    x, y = (F.array(*[F.lit(v) for v in z]).cast("array<bigint>") for z in (a, b))
    assert value(spark, X.full_distance(x, y)) == full and value(spark, X.prefilter_full(x, y)) == pre


def test_alpha_labels(spark):
    names = {r.id: r.v for r in spark.range(0, 475_300).select("id", X.alpha_label(F.col("id")).alias("v")).filter("id in (0, 25, 26, 701, 702, 18277, 18278, 475253, 475254)").collect()}
    assert names == {0: "a", 25: "z", 26: "aa", 701: "zz", 702: "aaa", 18277: "zzz", 18278: "aaaa", 475253: "zzzz", 475254: "aaaaa"}


def test_thresholds():
    assert X.threshold(" Custom ", 0.5) == 0.30 and X.threshold("custom") == 0.18 and X.threshold("none") == 0.18


def test_probe(spark):
    plain = {"streams": [
        {"codec_type": "audio", "tags": {"language": " FRA"}, "codec_name": "Opus", "bit_rate": 96000}, {"codec_type": "data"},
        {"codec_type": "video", "height": 576, "width": 720, "codec_name": "MPEG2VIDEO", "r_frame_rate": "25", "pix_fmt": "yuv420p", "field_order": "tt"}], "format": {"bit_rate": "9000", "duration": "77.25", "format_name": "MPEG"}}
    hdr = {"format": {"duration": "1"}, "streams": [
        {"codec_type": "video", "codec_name": "HEVC", "width": 1, "height": 1, "pix_fmt": "yuv420p10le", "bits_per_raw_sample": "0", "color_transfer": "smpte2084"},
        {"codec_type": "audio", "tags": {"language": "ENG"}}, {"codec_type": "audio", "tags": {"language": "deu"}}, {"codec_type": "subtitle", "tags": {"language": "pol"}}]}
    dv = {"format": {"duration": "1"}, "streams": [{"codec_type": "video", "width": "1", "height": "1", "pix_fmt": "gray10le", "level": "4.1", "side_data_list": [{"dv_profile": 8}]}]}
    rows = [(i, json.dumps(p)) for i, p in enumerate([plain, hdr, dv, {}])] + [(4, "no json"), (5, None)]
    got = {r.id: r for r in parse_probe(spark.createDataFrame(rows, "id long, p string"), "p").collect()}
    a, b, c = got[0], got[1], got[2]
    assert (a.duration_s, a.bitrate, a.audio_stream_count, a.audio_codec, a.audio_bitrate, a.audio_languages, a.bit_depth, a.hdr_format) == (77.25, 9000, 1, "opus", 96000, "fra", 8, "")
    assert (a.fps, a.probe_error, a.codec, a.container, a.is_interlaced) == (25.0, "", "mpeg2video", "mpeg", True)
    assert (b.codec, b.bit_depth, b.audio_languages, b.subtitle_languages, b.hdr_format) == ("hevc", 10, "deu,eng", "pol", "HDR10")
    assert (c.bit_depth, c.codec_level, c.hdr_format) == (10, "4.1", "DV")
    assert all(got[i].probe_error == "Invalid video metadata" and got[i].width == 0 for i in (3, 4, 5))


def test_exact_clusters_are_of_one_group(spark):
    rows = [(1, "/a", 3, "x"), (1, "/B", 3, "x"), (2, "/c", 3, "x"), (1, "/d", 4, "x"), (2, "/e", 5, "y"), (2, "/f", 5, "y")]
    got = T.cluster_members(spark.createDataFrame(rows, "group_id int, path string, size int, digest string"), "path").collect()
    assert sorted((r.path, r.label) for r in got) == [("/B", "●"), ("/a", "●"), ("/e", "●"), ("/f", "●")]


def test_prune_counts_groups_without_items(spark):
    groups = spark.createDataFrame([(1,), (2,), (3,)], "group_id int")
    items = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (2, 13)], "group_id int, file_id int")
    files = spark.createDataFrame([(10, True), (11, True), (12, True), (13, False)], "file_id int, alive boolean")
    assert sorted(tuple(r) for r in C.pruned(groups, items, files).collect()) == [(2, 1), (3, 0)]


def test_delete_plan(spark):
    targets = spark.createDataFrame([(1, "/a/x.mp4"), (2, "/a/y.mp4"), (3, "/a/y.mp4"), (0, "/a/z.mp4")], "file_id long, path string")
    taken = spark.createDataFrame([("/a/y.mp4.z_dele",), ("/a/y.mp4.z_dele.2",)], "path string")
    got = {r.file_id: (r.target, bool(r.error)) for r in P.delete_plan(targets, taken, "rename").collect()}
    assert got == {1: ("/a/x.mp4.z_dele", False), 2: ("/a/y.mp4.z_dele.1", False), 3: ("/a/y.mp4.z_dele.3", False), 0: (None, True)}
    assert {r.target for r in P.delete_plan(targets, taken, "permanent").collect()} == {None}
    with pytest.raises(ValueError, match="mode"):
        P.delete_plan(targets, taken, "burn")


def test_links_and_documents_are_written(spark, tmp_path):
    members = spark.createDataFrame(
        [(1, 5, f"/v/{i}.mp4", 10 + i, 1.5, "mov", 10 * i, 10, 25.0, False, 8, "", 7, "h264", "", "", 1, "aac", 9, 1 / 3, i == 2, "keep") for i in (1, 2)],
        "group_id long, scan int, path string, size long, duration_s double, container string, width int, height int, fps double, is_interlaced boolean, bit_depth int, hdr_format string, bitrate int, codec string, codec_profile string, codec_level string, audio_stream_count int, audio_codec string, audio_bitrate int, similarity_score double, keep_default boolean, selected_action string",
    ).withColumn("file_id", F.col("size"))
    links = spark.createDataFrame([(7, "symlink", "/l", "/t", False, "/r")], "scan_id int, link_kind string, link_path string, target_original_path string, target_exists boolean, source_root string")
    E.write_exports(members, links, {"scan_id": 7, "created_at": "now", "profile": "balanced"}, str(tmp_path))
    rows = spark.read.option("header", True).csv(f"{tmp_path}/duplicates.csv").collect()
    assert len(rows) == 2 and len(rows[0]) == 20 and {r.similarity_score for r in rows} == {"0.333333"} and {r.is_keep_default for r in rows} == {"0", "1"}
    (doc,) = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/duplicates.json").collect()]
    assert (doc["scan_id"], doc["total_size_bytes"], doc["reclaimable_bytes"], [i["file_path"] for i in doc["items"]]) == (7, 23, 11, ["/v/2.mp4", "/v/1.mp4"])
    (link,) = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/links.json").collect()]
    assert link["link_path"] == "/l" and link["target_exists"] is False and link["profile"] == "balanced"


def test_listing(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, size in (("a.MP4", 3 << 20), ("b.mkv", 10), ("deep/c.mp4", 2 << 20), ("d.txt", 5)):
        (tmp_path / "in" / name).write_bytes(b"x" * size)
    os.link(tmp_path / "in/a.MP4", tmp_path / "in/z.mp4")
    os.symlink(tmp_path / "in/b.mkv", tmp_path / "in/s.mkv")
    os.symlink(tmp_path / "nowhere", tmp_path / "in/t.mkv")
    os.symlink(tmp_path / "in/deep", tmp_path / "in/loop")
    files, links, issues = list_files(spark, [f"{tmp_path}/in", f"{tmp_path}/none", "//server/share"], [" .MP4", "mkv"], 1, 3)
    assert sorted(r.path.removeprefix(str(tmp_path)) for r in files.collect()) == ["/in/a.MP4", "/in/deep/c.mp4"]
    assert sorted((r.link_kind, os.path.basename(r.link_path), r.target_exists) for r in links.collect()) == [("hardlink", "z.mp4", True), ("symlink", "s.mkv", True), ("symlink", "t.mkv", False)]
    assert sorted(r.source_root.removeprefix(str(tmp_path)) for r in issues.collect()) == ["//server/share", "/none"]


def test_stream_resumes(spark, tmp_path):
    row = lambda *x: spark.createDataFrame(list(x), "k long").write.mode("append").parquet(f"{tmp_path}/in")
    feed = lambda: spark.readStream.schema("k long").parquet(f"{tmp_path}/in")
    for batch in ([(1,), (1,), (2,)], [(2,), (3,)], []):
        if batch:
            row(*batch)
        run_available(spark, feed(), ["k"], f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]


def test_digits_as_printf(spark):
    g = random.Random(3)
    values = [0.0, -0.25, 244.25, 0.9615, 0.8125, 2.5, 1e-9, 0.05, 1e12 + 0.25, 3e15] + [g.randrange(1, 4000) / 2000 for _ in range(300)] + [g.uniform(0, 1e6) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for digits in (1, 3, 4):
        got = [r[0] for r in df.select(X.fixed(F.col("v"), digits)).collect()]
        assert got == [f"{v:.{digits}f}" for v in values] + [None]
    (size,) = spark.range(1).select(X.bytes_text(F.lit(65536 * 977 * 4))).first()
    assert size == "244.2 MB"
