"""Cases of the matcher: acceptance, tolerance, trimmed and audio matches, modes, and blocking against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from twinsieve.operators import grouping as G
from twinsieve.operators import matching as M
from twinsieve.operators.components import connected_components

ONES, FULL = 0x1111111111111111, -1
SCHEMA = """file_id long, path string, size long, duration_s double, width int, height int, codec string, codec_profile string, codec_level string,
    bit_depth int, is_interlaced boolean, hdr_format string, bitrate long, mtime_ns long, ext string, audio_fingerprint string, hashes array<long>"""


def item(i, hashes, duration=10.0, width=1920, height=1080, audio=""):
    return (i, f"/v/{i}.mp4", 1000 + i, duration, width, height, "h264", "", "", 8, False, "", 2_000_000, i, "mp4", audio, hashes)


def edges(spark, rows, **options):
    return [(r.file_a, r.file_b, r.match_reason) for r in M.edges(spark.createDataFrame(rows, SCHEMA), **options).collect()]


def test_near_match_and_far(spark):
    rows = [item(1, [ONES] * 12), item(2, [ONES] * 11 + [ONES - 1]), item(3, [FULL] * 12)]
    assert edges(spark, rows) == [(1, 2, "perceptual")]


@pytest.mark.parametrize(("other", "tolerance", "expected"), [(25.0, 8.0, [(1, 2, "trimmed_match")]), (26.0, 5.0, []), (24.0, 8.0, [(1, 2, "trimmed_match")])])
def test_trimmed(spark, other, tolerance, expected):
    cut = [FULL, FULL, *[ONES] * 8, FULL, FULL]
    assert edges(spark, [item(1, [ONES] * 12, 20.0), item(2, cut, other)], tolerance=tolerance) == expected


def test_audio_rescue_and_threshold(spark):
    rows = [item(1, [0] * 12, audio="audio:1"), item(2, [FULL] * 12, audio="audio:1")]
    assert edges(spark, rows) == [(1, 2, "audio_match")] and edges(spark, rows, audio=False) == []
    rows = [item(1, [0] * 12), item(2, [0xFF] * 12)]
    assert edges(spark, rows, profile="custom", custom=0.13) and not edges(spark, rows, profile="custom", custom=0.10)


def test_cross_resolution_modes(spark):
    rows = [item(1, [ONES] * 12), item(2, [ONES] * 12, width=640, height=480)]
    assert edges(spark, rows, mode="off") == [] and len(edges(spark, rows, mode="any_aspect")) == 1
    rows = [item(1, [ONES] * 12), item(2, [ONES] * 12, width=1920, height=800)]
    assert edges(spark, rows, mode="off") == [] and len(edges(spark, rows, mode="same_aspect")) == 1


def test_blocking_equals_a_walk_over_buckets(spark):
    g = random.Random(5)
    rows = [item(i, [0] * 12, g.choice([g.uniform(0, 120), 12.5, 17.5])) for i in range(120)]
    bucket = {r[0]: round(max(0.0, r[3]) / 5) for r in rows}
    for tolerance in (5.0, 8.0, 13.0):
        reach, expected = max(0, math.ceil(tolerance / 5) - 1), set()
        for centre in set(bucket.values()):
            near = sorted(i for i, b in bucket.items() if abs(b - centre) <= reach)
            expected |= {(a, b) for k, a in enumerate(near) for b in near[k + 1 :]}
        got = {tuple(r) for r in M.block_pairs(spark.createDataFrame(rows, SCHEMA), tolerance, "any_aspect").collect()}
        assert got == expected


def test_components_of_chain_star_clique_and_nothing(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 202), (200, 202), (202, 202)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()))
    assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys(range(100, 130), 100), **dict.fromkeys((200, 201, 202), 200)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_group_keeps_the_oldest_of_equals(spark):
    i = spark.createDataFrame([item(1, [ONES] * 12), item(2, [ONES] * 12), item(3, [FULL] * 12)], SCHEMA)
    m = {r.file_id: r for r in G.group_items(i, M.edges(i)).collect()}
    assert set(m) == {1, 2} and m[1].keep_default and not m[2].keep_default and m[2].selected_action == "rename"
    (s,) = G.summary(G.group_items(i, M.edges(i))).collect()
    assert (s.groups, s.files, s.total_bytes, s.extra_files) == (1, 2, 2003, 1)


def test_a_bucket_of_many_blocks_equals_brute_force(spark):
    from twinsieve.operators import tiles as B

    g = random.Random(9)
    base = [g.getrandbits(63) for _ in range(12)]
    rows = [item(i, [h ^ (1 << g.randrange(63)) for h in base[: g.choice([12, 12, 7])]], g.choice([50.0, 53.5, 58.0])) for i in range(60)]
    df = M.bucketed(spark.createDataFrame(rows, SCHEMA)).select("file_id", "bucket", "aspect", F.col("duration_s"), "hashes")

    def judge(a, b):
        a, b = B.at(a, b, B.once_all(a, b))
        yield (*B.ends(a, b), B.distance(a, b, False))

    got = sorted((r.a, r.b, r.d) for r in B.judged(df, 1, "any_aspect", judge, "a long, b long, d double", block=9).collect())

    def far(x, y):
        s = sorted((p ^ q).bit_count() for p, q in zip(x, y, strict=False))
        return (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 128 if len(x) == len(y) else 1.0

    assert got == [(a, b, far(rows[a][-1], rows[b][-1])) for a in range(60) for b in range(a + 1, 60)]


def test_audio_edges_meet_by_their_print(spark):
    """Items that sound unlike others never meet them: the join's keys hold the print, whatever else is in the bucket."""
    rows = [item(i, [ONES << i % 3] * 12, audio=f"audio:{i % 7}" if i % 2 else "") for i in range(40)] + [item(50, [FULL] * 12, 12.0, audio="audio:3")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = M.audio_edges(df)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert any("Join" in line and line.count("audio_fingerprint") >= 2 for line in plan.splitlines())
    assert {tuple(r) for r in got.select("file_a", "file_b").collect()} == {(r[0], 50) for r in rows if r[-2] == "audio:3" and r[0] != 50} | {
        (a[0], b[0]) for a in rows[:40] for b in rows[:40] if a[0] < b[0] and a[-2] == b[-2] != "" and a[-1] != b[-1]
    }


def _tile(n: int, seed: int):
    import numpy as np
    from types import SimpleNamespace

    g = np.random.default_rng(seed)
    hashes = g.integers(0, 1 << 63, (4, 12)).astype("u8")[g.integers(0, 4, n)] ^ (np.uint64(1) << g.integers(0, 64, (n, 12)).astype("u8"))
    hashes[g.random((n, 12)) < 0.3] = 0
    duration = np.round(g.uniform(47.5, 57.4, n), 1)
    ratio = g.choice([0.0, 16 / 9, 1.6, 4 / 3], n)
    return SimpleNamespace(id=g.integers(0, n, n), bucket=np.round(duration / 5).astype("i8"), duration_s=duration, ratio=ratio, hashes=hashes, n=np.full(n, 12))


@pytest.mark.parametrize("length", [12, 9, 2, 1, 0])
def test_near_pairs_and_counts_equal_judging_all(length):
    """Pairs found along the durations, and the counters, against every pair judged; ids repeat, and so do durations."""
    import numpy as np

    from twinsieve.operators import tiles as B

    rows = _tile(300, 3)
    rows.n[:], rows.hashes = length, rows.hashes[:, :length]
    low = B._taken(rows, rows.bucket == rows.bucket.min())
    for a, b in ((low, low), (low, B._taken(rows, rows.bucket != rows.bucket.min()))):
        for tolerance, aspect, limit in ((8.0, 0.2, 0.18), (5.0, None, 0.29), (4.0, 0.5, 0.12)):
            x, y = B.at(a, b, B.once_all(a, b) & B.gate_all(a, b, tolerance, aspect))
            inner = np.abs(x.duration_s - y.duration_s) > 3.0
            either = lambda f: np.where(inner, f(x, y, True), f(x, y, False))  # noqa: B023, E731
            passed = either(B.prefilter) <= 44
            close = passed & (either(B.distance) <= np.where(inner, limit * 0.9, limit))
            got = list(B.near_pairs(a, b, tolerance, aspect))
            assert sum(len(p[0].id) for p in got) == passed.sum() and (length < 9 or passed.any())
            got = [row for part in B.close_pairs(iter(got), limit) for row in zip(*(c.tolist() for c in part), strict=True)]
            reason, gap = np.where(inner, "trimmed_match", "perceptual"), np.abs(x.duration_s - y.duration_s)
            want = zip(*(c[close].tolist() for c in (*B.ends(x, y), 1 - either(B.distance), reason, gap)), strict=True)
            assert sorted(got) == sorted(want)
            every = B.once_all(a, b).sum()
            assert B.counted(a, b, tolerance, aspect).tolist() == [2 * every, 2 * len(x.id), 2 * inner.sum()]


def test_near_pairs_look_at_two_places_of_half_the_pairs(monkeypatch):
    """Hashes compared while a bucket meets itself: before, five places of every pair in both orders."""
    import numpy as np

    from twinsieve.operators import tiles as B

    rows, seen, count = _tile(600, 4), [], np.bitwise_count
    rows = B._taken(rows, rows.bucket == rows.bucket.min())
    rows.hashes = np.random.default_rng(1).integers(0, 1 << 63, rows.hashes.shape).astype("u8")
    monkeypatch.setattr(B, "CHUNK", 2048)
    monkeypatch.setattr(B.np, "bitwise_count", lambda x, *a, **k: (seen.append(np.size(x)), count(x, *a, **k))[1])
    for _ in B.close_pairs(B.near_pairs(rows, rows, 8.0, 0.2), 0.18):
        pass
    assert 0 < sum(seen) < 1.5 * len(rows.id) ** 2


def test_a_group_of_near_copies_leaves_a_row_an_item(spark):
    """A tile's edges grow with the square of a group and stay in the tile; groups and scores are those of all edges."""
    g = random.Random(12)
    base = [[g.getrandbits(63) for _ in range(12)] for _ in range(3)]
    rows = [item(i, [h ^ (g.getrandbits(63) & g.getrandbits(63) & g.getrandbits(63) & g.getrandbits(63)) for h in base[i % 3]], 50.0 if i % 3 == 2 else g.choice([50.0, 53.5, 58.0]), audio=f"audio:{i % 9}" if i % 2 else "") for i in range(90)]
    df = spark.createDataFrame([*rows, item(7, base[0], 51.0)], SCHEMA)
    edges, met = M.edges(df).cache(), M.met_items(df).cache()
    assert edges.count() > 1000 and met.filter("rank <> 2").count() <= 3 * len(rows)
    told = lambda m: sorted((r.file_id, r.group_id, round(r.similarity_score, 9), r.match_reason, r.match_duration_delta_s, r.keep_default) for r in m.collect())
    got = told(G.group_met(df, met))
    assert got == told(G.group_items(df, edges)) and {r[3] for r in got} >= {"trimmed_match", "perceptual"}
    sides = [(r[k], r.score) for r in edges.collect() for k in ("file_a", "file_b")]
    mean = lambda i: sum(s for j, s in sides if j == i) / sum(j == i for j, _ in sides)
    assert all(abs(r[2] - mean(r[0])) < 1e-8 for r in got)
