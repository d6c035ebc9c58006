"""Pairs of items in neighbouring duration buckets, compared block against block.

Every two items within reach are to be judged, so the work is quadratic in a bucket by nature. Spark
deals the items: a bucket is cut into blocks of about `BLOCK` items by a hash, and a tile is a
block with the blocks of one number of all buckets that it meets. A tile is judged in numpy, `CHUNK`
pairs at a time, and only what a caller asks for comes out; nothing larger than a tile is held.

Near pairs (`near_pairs`) are found along the durations: both groups are sorted, an item looks only at those
not shorter and within the tolerance, and of the prefilter's three places two are compared, as a median of
at most so many bits needs one of any two places to be within them. What is left is judged in full. Pairs are
only counted (`counted`) by distinct durations and ratios.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..runtime import Scratch

#: Items of a block; pairs judged at once, and with one item; pairs of a task; close pairs gathered at once.
BLOCK, CHUNK, ROW, TASK, CLOSE = 16384, 1 << 17, 4096, 200_000_000, 1 << 18
#: Seconds by which ranges of durations are widened before the gate judges exactly.
_SLACK = 1e-3
_KEYS = ["part", "lo", "i", "j"]


def tiled(items: DataFrame, reach: int, mode: str, block: int = BLOCK) -> DataFrame:
    """items(file_id, bucket, aspect, ..) dealt to tiles: part, lo, i, j tell the tile, side whether a row is its block (0) or what that meets.

    Two buckets meet if an occupied one (in mode off, of their aspect bin) lies within reach of both.
    """
    scratch = Scratch(items.sparkSession)
    rows = items.withColumn("part", F.col("aspect") if mode == "off" else F.lit(0.0))
    cells = scratch.cut(rows.groupBy("part", "bucket").agg(F.count("*").alias("n")), "cells").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    lower = cells.select("part", F.col("bucket").alias("lo"), F.col("n").alias("lo_n"), F.col("blocks").alias("lo_blocks"), F.explode(F.sequence("bucket", F.col("bucket") + 2 * reach)).alias("hi"))
    ways = lower.join(cells.select("part", F.col("bucket").alias("hi"), F.col("n").alias("hi_n"), F.col("blocks").alias("hi_blocks")), ["part", "hi"])
    if reach:
        between = ways.select("*", F.explode(F.sequence(F.col("hi") - reach, F.col("lo") + reach)).alias("centre"))
        ways = between.join(cells.select("part", F.col("bucket").alias("centre")), ["part", "centre"], "left_semi").drop("centre").distinct()
    ways = scratch.cut(ways, "ways")
    pairs = ways.agg(F.sum(F.col("lo_n").cast("double") * F.col("hi_n"))).first()[0] or 0
    blocks = lambda n: F.pmod(F.xxhash64("file_id"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = ways.groupBy("part", F.col("lo").alias("bucket")).agg(F.max("lo_blocks").alias("lo_blocks"), F.max("hi_blocks").alias("hi_blocks"))
    rows = rows.filter("file_id IS NOT NULL")
    left = rows.join(own, ["part", "bucket"]).select("*", F.col("bucket").alias("lo"), blocks(F.col("lo_blocks")).alias("i"), upto(F.col("hi_blocks")).alias("j"), F.lit(0).alias("side"))
    met = ways.select("part", F.col("hi").alias("bucket"), "lo", "lo_blocks", "hi_blocks")
    right = rows.join(met, ["part", "bucket"]).select("*", blocks(F.col("hi_blocks")).alias("j"), upto(F.col("lo_blocks")).alias("i"), F.lit(1).alias("side"))
    dealt = left.select(*_KEYS, "side", *items.columns).unionByName(right.select(*_KEYS, "side", *items.columns))
    parts = 2 * items.sparkSession.sparkContext.defaultParallelism + min(10_000, int(pairs // TASK))
    return dealt.repartition(parts, *_KEYS)


def judged(items: DataFrame, reach: int, mode: str, judge: Callable, schema: str, block: int = BLOCK, whole: bool = False) -> DataFrame:
    """What judge(a, b) yields of every two groups of items that meet, as tuples of arrays in the order of schema.

    items: file_id, bucket, aspect and further of duration_s, ratio, hashes. Of the pairs of a group judge takes
    those that `once` marks: each pair of items comes out once then, with either item as a. whole: judge gets
    whole groups of a tile and cuts them itself.
    """

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        names = [c.split(":")[0].split()[0] for c in schema.split(",")]
        rows, side = _arrays(t), t.column("side").to_numpy()
        left, right = _of_length(_taken(rows, side == 0)), _of_length(_taken(rows, side == 1))
        if whole:
            for a_all in left:
                for b in right:
                    yield from (pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in out], names) for out in judge(a_all, b))
            return
        right = [_taken(b, slice(k, k + ROW)) for b in right for k in range(0, len(b.id), ROW)]
        for a_all in left:
            for b in right:
                step = max(1, CHUNK // len(b.id))
                for k in range(0, len(a_all.id), step):
                    for out in judge(_taken(a_all, slice(k, k + step)), b):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names)

    return tiled(items, reach, mode, block).groupBy(*_KEYS).applyInArrow(tile, schema)


def _arrays(t) -> SimpleNamespace:
    """Columns of a tile as arrays; hashes as rows filled up with zeros, n the number of each."""
    got = {"id": t.column("file_id").to_numpy(), "bucket": t.column("bucket").to_numpy()}
    for name in ("duration_s", "ratio"):
        if name in t.column_names:
            got[name] = t.column(name).to_numpy().astype("f8")
    n = np.zeros(t.num_rows, "i8")
    if "hashes" in t.column_names:
        lists = t.column("hashes").combine_chunks()
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype("i8")
        got["hashes"] = np.zeros((t.num_rows, int(n.max(initial=0))), "u8")
        got["hashes"][np.arange(got["hashes"].shape[1]) < n[:, None]] = pc.fill_null(lists.flatten(), 0).to_numpy().view("u8")
    return SimpleNamespace(**got, n=n)


def _taken(rows: SimpleNamespace, at) -> SimpleNamespace:
    return SimpleNamespace(**{k: v[at] for k, v in vars(rows).items()})


def _of_length(rows: SimpleNamespace) -> list[SimpleNamespace]:
    """rows by number of hashes."""
    return [_taken(rows, rows.n == n) for n in np.unique(rows.n)]


def gate(a, b, tolerance: float, aspect: float | None):
    """Whether durations, and aspect ratios unless aspect is None, are near; of arrays that broadcast."""
    with np.errstate(all="ignore"):
        longest, shortest = np.maximum(a.duration_s, b.duration_s), np.minimum(a.duration_s, b.duration_s)
        ratio = np.maximum(0.70, 1 - tolerance / np.maximum(1.0, longest))
        ok = (longest - shortest <= tolerance) & (longest > 0) & (shortest / longest >= ratio) & (a.ratio > 0) & (b.ratio > 0)
        return ok if aspect is None else ok & (np.abs(np.log2(a.ratio / b.ratio)) <= aspect)


def gate_all(a, b, tolerance: float, aspect: float | None):
    """The gate of all pairs; ratios are few, so they are compared once each."""
    of = lambda side, how: SimpleNamespace(duration_s=side.duration_s[how], ratio=np.ones(1))
    ok = gate(of(a, np.s_[:, None]), of(b, np.s_[None, :]), tolerance, None)
    (ra, ia), (rb, ib) = np.unique(a.ratio, return_inverse=True), np.unique(b.ratio, return_inverse=True)
    one = lambda r: SimpleNamespace(duration_s=np.ones(1), ratio=r)
    return ok & gate(one(ra[:, None]), one(rb[None, :]), tolerance, aspect)[ia][:, ib]


def _bits(a, b, k: int):
    return np.bitwise_count(a.hashes[..., k] ^ b.hashes[..., k])


def _span(a, b, inner: bool) -> tuple[int, int, int]:
    """First place compared, and how many a and b have from there."""
    na, nb = (int(s.n.max(initial=0)) for s in (a, b))  # one number a side
    return (2, max(0, min(8, na - 2)), max(0, min(8, nb - 2))) if inner else (0, na, nb)


def _middle(n: int, at: Callable):
    """Twice the median of at(place) of the first, the middle and the last of n places; 128 if there is none."""
    if n == 0:
        return np.uint8(128)
    x, y, z = (at(k) for k in (0, n // 2, n - 1))
    return 2 * np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z)) if n > 2 else x + z


def prefilter(a, b, inner: bool):
    """Twice the prefilter's bits of pairs given row by row."""
    first, na, nb = _span(a, b, inner)
    return _middle(min(na, nb), lambda k: _bits(a, b, first + k))


def distance(a, b, inner: bool):
    """Median of the bits that differ over 64, 1 for unequal numbers of hashes or none, by a sorting network over whole arrays."""
    first, na, nb = _span(a, b, inner)
    if na != nb or na == 0:
        return np.ones(len(a.id))
    s = [_bits(a, b, first + k) for k in range(na)]
    for turn in range(na):
        for k in range(turn % 2, na - 1, 2):
            s[k], s[k + 1] = np.minimum(s[k], s[k + 1]), np.maximum(s[k], s[k + 1])
    return (s[(na - 1) // 2].astype("f8") + s[na // 2]) / 128.0


def once(a, b):
    """Marks pairs of arrays that broadcast; within a bucket both orders occur, and one counts."""
    return (a.id < b.id) | ((a.bucket < b.bucket) & (a.id != b.id))


def once_all(a, b):
    of = lambda s, how: SimpleNamespace(id=s.id[how], bucket=s.bucket[how])
    return once(of(a, np.s_[:, None]), of(b, np.s_[None, :]))


def ends(a, b) -> tuple:
    return np.minimum(a.id, b.id), np.maximum(a.id, b.id)


def at(a, b, mask) -> tuple[SimpleNamespace, SimpleNamespace]:
    """The pairs that mask marks, as rows of both sides."""
    x, y = np.divmod(np.flatnonzero(mask), mask.shape[1])
    return _taken(a, x), _taken(b, y)


def _by_duration(rows: SimpleNamespace) -> SimpleNamespace:
    """Rows that can pass the gate, by duration."""
    rows = _taken(rows, (rows.ratio > 0) & ~np.isnan(rows.duration_s))
    return _taken(rows, np.argsort(rows.duration_s, kind="stable"))


def _spread(a_id: np.ndarray, b_id: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple]:
    """file_id, others of each a that meets any: others is b_id[first:last], about `CHUNK` of them at once. Spark makes them rows."""
    n = np.maximum(last - first, 0)
    a_id, first, n = a_id[n > 0], first[n > 0], n[n > 0]
    upto, k = np.cumsum(n), 0
    while k < len(n):
        end = max(k + 1, int(np.searchsorted(upto, upto[k] - n[k] + CHUNK, "right")))
        m = n[k:end]
        at = np.append(0, np.cumsum(m))
        others = b_id[np.arange(at[-1]) + np.repeat(first[k:end] - at[:-1], m)]
        yield a_id[k:end], pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(others))
        k = end


def all_pairs(a, b) -> Iterator[tuple]:
    """Each a and the others of all pairs that `once` marks, of two groups of a tile (a is of one bucket); an id of two
    buckets meets itself here, which the caller leaves out.

    Of a's own bucket an item meets the greater ids, of higher ones all: sorted so, what an item meets is the end of b.
    """
    if not len(a.id) or not len(b.id):
        return
    own, higher = b.id[b.bucket == a.bucket[0]], b.id[b.bucket > a.bucket[0]]
    own.sort()
    both = np.concatenate([own, higher])
    yield from _spread(a.id, both, np.searchsorted(own, a.id, "right"), np.full(len(a.id), len(both)))


def gated_pairs(a, b, tolerance: float, aspect: float | None) -> Iterator[tuple]:
    """Each a and the others of the pairs that pass the gate, each once, of two groups of a tile; an id may meet itself, as in `all_pairs`.

    As in `near_pairs` the shorter item (or of equal ones the lesser id) is a. Of durations from a's on, sorted, those that
    pass are the first: what the gate compares falls on one side and rises on the other, rounded or not. Their end
    is found by bisection with the gate itself; ratios are few, so they are compared once each.
    """
    a, b = _by_duration(a), _by_duration(b)
    b = _taken(b, np.lexsort((b.id, b.duration_s)))
    b = _taken(b, b.duration_s > 0)
    if not len(a.id) or not len(b.id):
        return
    one = lambda r: SimpleNamespace(duration_s=np.ones(1), ratio=r)
    for kind in [b] if aspect is None else [_taken(b, b.ratio == r) for r in np.unique(b.ratio)]:
        x = a if aspect is None else _taken(a, gate(one(a.ratio), one(kind.ratio[:1]), tolerance, aspect))
        rest = lambda k, x=x: SimpleNamespace(duration_s=x.duration_s if k is None else k, ratio=np.ones(1))
        first, stop = (np.searchsorted(kind.duration_s, x.duration_s, way) for way in ("left", "right"))
        low, high = first.copy(), stop.copy()
        while (go := low < high).any():  # past the lesser ids of equal durations
            mid = np.minimum((low + high) // 2, len(kind.id) - 1)
            less = kind.id[mid] <= x.id
            low, high = np.where(go & less, mid + 1, low), np.where(go & ~less, mid, high)
        begin, low, high = low, first, np.full(len(x.id), len(kind.id))
        while (go := low < high).any():
            mid = np.minimum((low + high) // 2, len(kind.id) - 1)
            ok = gate(rest(None), rest(kind.duration_s[mid]), tolerance, None)
            low, high = np.where(go & ok, mid + 1, low), np.where(go & ~ok, mid, high)
        yield from _spread(x.id, kind.id, begin, low)


def _two_places(a, b, inner: bool) -> tuple[int, int] | None:
    """Places of which one is within the prefilter's bits in every pair that passes it; None if no pair does."""
    first, na, nb = _span(a, b, inner)
    n = min(na, nb)
    return None if n == 0 else (first + (n // 2 if n > 2 else n - 1), first)


def near_pairs(a, b, tolerance: float, aspect: float | None) -> Iterator[tuple]:
    """a, b, inner: pairs that pass the gate and the prefilter, each pair of items once, row by row; of two groups of a tile.

    A bucket grows with the duration, so an item of the lower bucket is the shorter one, and within a bucket both
    orders occur: the pairs whose a is shorter, or as long and of lesser id, are each pair once.
    """
    a, b = _by_duration(a), _by_duration(b)
    if not len(a.id) or not len(b.id):
        return
    first, last = np.searchsorted(b.duration_s, a.duration_s), np.searchsorted(b.duration_s, a.duration_s + tolerance + _SLACK, "right")
    places = [_two_places(a, b, inner) for inner in (False, True)]
    ha, hb = ({k: np.ascontiguousarray(s.hashes[:, k]) for p in places if p for k in p} for s in (a, b))
    buffer, one, two = np.empty(CHUNK, "u8"), np.empty(CHUNK, "u1"), np.empty(CHUNK, "u1")
    k = 0
    while k < len(a.id):
        end = min(len(a.id), k + max(1, CHUNK // max(1, int(last[k] - first[k]))))
        low, high = a.duration_s[k], a.duration_s[end - 1]
        middle = np.searchsorted(b.duration_s, [low + X.INNER_GAP - _SLACK, high + X.INNER_GAP + _SLACK])
        for inner, c, stop in ((False, first[k], min(last[end - 1], middle[1])), (True, max(first[k], middle[0]), last[end - 1])):
            if places[inner] is None:
                continue
            p, q = places[inner]
            for at_b in range(int(c), int(stop), CHUNK // (end - k)):
                cols = slice(at_b, min(int(stop), at_b + CHUNK // (end - k)))
                shape = (end - k, cols.stop - at_b)
                x, n1, n2 = (v[: shape[0] * shape[1]].reshape(shape) for v in (buffer, one, two))
                np.bitwise_count(np.bitwise_xor(ha[p][k:end, None], hb[p][None, cols], out=x), out=n1)
                np.bitwise_count(np.bitwise_xor(ha[q][k:end, None], hb[q][None, cols], out=x), out=n2)
                i, j = np.divmod(np.flatnonzero(np.minimum(n1, n2, out=n1) <= X.PREFILTER_BITS), shape[1])
                i, j = i + k, j + at_b
                da, db = a.duration_s[i], b.duration_s[j]
                ok = ((db - da > X.INNER_GAP) == inner) & ((da < db) | ((da == db) & (a.id[i] < b.id[j]))) & (a.id[i] != b.id[j])
                i, j = i[ok], j[ok]
                x, y = _taken(a, i), _taken(b, j)
                ok = gate(x, y, tolerance, aspect) & (prefilter(x, y, inner) <= 2 * X.PREFILTER_BITS)
                if ok.any():
                    yield _taken(x, ok), _taken(y, ok), inner
        k = end


def close_pairs(near: Iterator[tuple], limit: float) -> Iterator[tuple]:
    """file_a, file_b, score, match_reason, gap_s of the near pairs(a, b, inner) that are as near as limit."""
    for a, b, inner in near:
        far = distance(a, b, inner)
        ok = far <= (limit * X.INNER_FACTOR if inner else limit)
        if ok.any():
            told = np.full(int(ok.sum()), "trimmed_match" if inner else "perceptual")
            yield tuple(c[ok] for c in (*ends(a, b), 1 - far)) + (told, np.abs(a.duration_s - b.duration_s)[ok])


def _rooted(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least item of each item's component, after the pairs x, y; root is that before, and every root its own."""
    while True:
        u, v = root[x], root[y]
        cross = u != v
        if not cross.any():
            return root
        x, y, u, v = x[cross], y[cross], u[cross], v[cross]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]


def gathered(a, b, close: Iterator[tuple]) -> Iterator[tuple]:
    """file_id, root, edges, score, rank, gap_s of the items of close_pairs of two groups of a tile: the least id that its
    pairs reach, their number, the sum of their scores, 3 if one is trimmed (else 1) and the least gap of those; as many
    rows as items, whatever the number of pairs."""
    ids = np.unique(np.concatenate([a.id, b.id]))
    root, edges, score, gap = np.arange(len(ids)), np.zeros(len(ids), "i8"), np.zeros(len(ids)), np.full(len(ids), np.inf)
    held: list[tuple] = []

    def take(root):
        x, y, far, reason, apart = (np.concatenate(c) for c in zip(*held, strict=True))
        x, y, trimmed = np.searchsorted(ids, x), np.searchsorted(ids, y), reason == "trimmed_match"
        for side in (x, y):
            np.add(edges, np.bincount(side, minlength=len(ids)), out=edges)
            np.add(score, np.bincount(side, far, len(ids)), out=score)
            np.minimum.at(gap, side[trimmed], apart[trimmed])
        held.clear()
        return _rooted(root, x, y)

    for pairs in close:
        held.append(pairs)
        if sum(len(p[0]) for p in held) >= CLOSE:
            root = take(root)
    if held:
        root = take(root)
    at = np.flatnonzero(edges)
    if len(at):
        trimmed = gap[at] < np.inf
        yield ids[at], ids[root[at]], edges[at], score[at], np.where(trimmed, 3, 1).astype("i4"), np.where(trimmed, gap[at], 0.0)


def counted(a, b, tolerance: float, aspect: float | None) -> np.ndarray:
    """Pairs, those that pass the gate and those of them that are inner, of two groups of a tile; all twice over the tiles.

    Pairs of one bucket occur in both orders, others once and count twice. Items of one duration, ratio and
    bucket are judged together; pairs of equal ids do not count.
    """

    def grouped(s):
        of = np.lexsort((s.ratio, s.duration_s, s.bucket))
        s = SimpleNamespace(bucket=s.bucket[of], duration_s=s.duration_s[of], ratio=s.ratio[of])
        new = np.ones(len(of), bool)
        new[1:] = (s.bucket[1:] != s.bucket[:-1]) | (s.duration_s[1:] != s.duration_s[:-1]) | (s.ratio[1:] != s.ratio[:-1])
        at = np.flatnonzero(new)
        return SimpleNamespace(**vars(_taken(s, at)), count=np.diff(np.append(at, len(of))))

    def told(x, y, n):
        ok, twice = gate(x, y, tolerance, aspect), np.where(x.bucket == y.bucket, n, 2 * n)
        return np.array([twice.sum(), twice[ok].sum(), twice[ok & (np.abs(x.duration_s - y.duration_s) > X.INNER_GAP)].sum()])

    x, y, out = grouped(a), grouped(b), np.zeros(3, "i8")
    for k in range(0, len(x.count), step := max(1, CHUNK // max(1, len(y.count)))):
        part = SimpleNamespace(**{f: v[k : k + step, None] for f, v in vars(x).items()})
        out += told(part, SimpleNamespace(**{f: v[None, :] for f, v in vars(y).items()}), part.count * y.count[None, :])
    by_id = np.argsort(b.id, kind="stable")
    low, high = (np.searchsorted(b.id[by_id], a.id, way) for way in ("left", "right"))
    i = np.repeat(np.arange(len(a.id)), high - low)
    j = by_id[np.arange(len(i)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[i]]
    return out - told(_taken(a, i), _taken(b, j), np.ones(len(i), "i8"))


def ratio(width: Column, height: Column) -> Column:
    return F.coalesce(F.try_divide(width, height), F.lit(0.0))
