"""Exact Jaccard join of documents' word-shingle sets with skipping by set relations.

Sets that are equal form a class, and the join runs over classes. Shingles have one order for
all sets, rare ones first; two sets that reach the threshold share one of the first
n - ceil(t * n) + 1 shingles of both, so only those go to the index lists. A list is sorted by
set size, which cuts it into blocks: a set skips every block of sizes that cannot reach the
threshold, and inside a block every entry whose position leaves too few shingles.

A list of up to `LIST` sets gives its pairs, each at the least shingle the pair is known to
share. A longer list is not paired off as rows: its smallest set leads it, the others are compared
with the leader alone (and with one more set, so that groups join early), and a list whose sets
are in one component by then is done. The sets of open lists meet once a leader, whatever the number
of lists. There, sorted by size, a set skips the blocks of sizes out of reach and its own component.
For the others the answer follows from the computed answers of the leader r, both ways:
|x & y| >= |x & r| + |y & r| - |r| proves a link, and |x & y| <= min(|x & r|, |y & r|) +
min(|x - r|, |y - r|) rules one out; so do histograms of hash ranges, |x & y| <= the sum of their
minima, which for sets of a thousand shingles leave little open. Only pairs that remain become rows
and are compared. A leader's sets are cut into blocks of `BLOCK`, and pairs of blocks are dealt out, so
that no task holds a whole group.

Pairs are fetched as ids. Sets are fetched for one pair of each set first; the links so far are joined
into components, and of the pairs that still cross components those are compared whose histograms
leave room for enough shared shingles. Texts of sets are kept and fetched in slices, so that the disk holds
them once and one slice of what is moved; shingles, which are larger, are made where they are compared. No link between different sets is lost: components come out as
if all pairs had been compared.

The order comes from a bounded list of frequent shingles, which settles speed, not results.
Shingles and classes are 64-bit hashes.

Defined cases: null or blank text has an empty set and no links; fewer words than a shingle
make one shingle of the whole sequence; repeated rows and copies share a class;
rows of equal or null doc_id are documents of their own, told apart by a hash of id and text; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..runtime import Scratch, has_rows, maybe_in, row_key
from .tokens import in_batches

WIDTH, PERCENT, LIST = 5, 80, 6
#: Sets of one leader that a task holds beside as many others.
BLOCK = 2048
#: Characters shingled at a time.
CHARS = 300_000
#: Hash ranges of a set's histogram.
SLOT_BITS = 10
#: Sets made or pairs compared in one slice, whose shuffle alone is on disk, and the most slices.
SLICE, SLICES = 40_000, 16
#: Most entries of the list of frequent shingles, and the least count in one batch to be noted.
FREQUENT, NOTED = 1 << 18, 6

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(gap.astype(np.int8))
    start, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    n = len(data)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), dtype=np.uint64)])
    word = _mix((sums[end] - sums[start]) * _powers(_BACK, n)[start] + (end - start).astype(np.uint64))
    begins = 1 + np.concatenate([[0], np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))])
    cut = np.searchsorted(start, begins).tolist()
    m = len(word) - width + 1
    grams = np.zeros(max(m, 0), np.uint64)
    for k in range(width):
        grams = grams * np.uint64(0xC2B2AE3D27D4EB4F) + word[k : k + max(m, 0)]
    grams = _mix(grams)
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for w in word[a:b]:
                h = np.uint64((int(h) * 0xC2B2AE3D27D4EB4F + int(w)) & 0xFFFFFFFFFFFFFFFF)
            out.append(_mix(np.array([h])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signed(a) -> np.ndarray:
    return np.asarray(a, np.uint64).view(np.int64)


def _class(h: np.ndarray) -> int:
    """The class of a set: a hash of its sorted shingles."""
    with np.errstate(over="ignore"):
        return int(_signed(_mix((h * (np.arange(len(h), dtype=np.uint64) * np.uint64(2) + np.uint64(1))).sum(keepdims=True) + np.uint64(len(h))))[0])


def classes(docs: DataFrame, width: int) -> DataFrame:
    """kind 0: doc_id, key, class, n of each document; kind 1: shingles (class column) frequent in a batch and their counts (n)."""

    def run(batches):
        import pyarrow as pa

        names, held, held_n, seen = ["kind", "doc_id", "key", "class", "n"], [], 0, set()

        def frequent():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            h, c = h[c >= NOTED], c[c >= NOTED]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int64)), *[pa.array(np.zeros(len(h), np.int64))] * 2, pa.array(_signed(h)), pa.array(c.astype(np.int64))], names=names)

        for batch in batches:
            texts, ids, keys = batch.column("text").to_pylist(), batch.column("doc_id"), batch.column("key")
            for a, b in in_batches(texts, CHARS):
                sets = shingle_sets(texts[a:b], width)
                cls = [_class(h) for h in sets]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b - a, np.int64)), ids.slice(a, b - a), keys.slice(a, b - a), pa.array(cls, pa.int64()), pa.array([len(h) for h in sets], pa.int64())], names=names)
                for c, h in zip(cls, sets, strict=True):
                    if c not in seen:
                        seen.add(c)
                        held.append(h)
                        held_n += len(h)
                if held_n > 2_000_000:
                    yield frequent()
                    held, held_n = [], 0
        if held:
            yield frequent()

    return docs.select("doc_id", row_key().alias("key"), "text").mapInArrow(run, "kind long, doc_id long, key long, class long, n long")


class Order:
    """The order of shingles in all sets: frequent ones last, by rank; the others by hash, as they come."""

    def __init__(self, often: np.ndarray, rank: np.ndarray):
        self.often, self.rank = often, rank
        self.flags = np.zeros(1 << 22, bool)
        self.flags[(often >> np.uint64(42)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not self.flags[(h >> np.uint64(42)).astype(np.int64)].any():
            return h
        at = np.minimum(np.searchsorted(self.often, h), len(self.often) - 1)
        hit = self.often[at] == h
        return np.concatenate([h[~hit], h[hit][np.argsort(self.rank[at[hit]])]])


def index_rows(docs: DataFrame, width: int, percent: int, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """token, class, n, pos, first (the set's first token) of the first shingles of each set."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(order)  # at most FREQUENT entries

    def run(batches):
        import pyarrow as pa

        put_last = Order(*sent.value)
        seen = set()
        names = ["token", "class", "n", "pos", "first"]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in in_batches(texts, CHARS):
                token, cls, size, first = [], [], [], []
                for h in shingle_sets(texts[a:b], width):
                    n = len(h)
                    if not n or (c := _class(h)) in seen:
                        continue
                    seen.add(c)
                    p = n - -(-percent * n // 100) + 1
                    h = put_last(h)
                    h = h[:p]
                    token.append(h)
                    cls.append(c)
                    size.append(n)
                    first.append(h[0])
                if token:
                    m = np.array([len(t) for t in token])
                    pos = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(_signed(np.concatenate(token))), pa.array(np.repeat(np.array(cls, np.int64), m)),
                        pa.array(np.repeat(np.array(size), m)), pa.array(pos), pa.array(np.repeat(_signed(np.array(first, np.uint64)), m)),
                    ], names=names)

    return docs.select("text").mapInArrow(run, "token long, class long, n long, pos long, first long")


def _least(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that sets of these sizes must share."""
    return -(-percent * (na + nb) // (100 + percent))


def list_pairs(rows: DataFrame, percent: int, most: int) -> DataFrame:
    """From index rows: kind 0, pairs (a, b) to compare; kind 1, the sets (a, of size n) of long lists with their leader (b); kind 2, pairs with leaders.

    Lists come sorted by token and size, so that a long one is streamed past its first rows.
    """

    def run(batches):
        import pyarrow as pa

        names = ["kind", "a", "b", "token", "n"]

        def out(kind, a, b, token=None, n=None):
            zero = np.zeros(len(a), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(zero + kind), pa.array(a), pa.array(b), pa.array(zero if token is None else token), pa.array(zero if n is None else n)], names=names)

        def long_rows(x: dict, lead: dict):
            """Rows of one long list: its leader for each, and a pair with leader and hub where the sizes allow it."""
            yield out(1, x["class"], np.full(len(x["class"]), lead["class"]), x["token"], x["n"])
            a, b = [], []
            for mate in ("class", "hub"):
                fit = (100 * np.minimum(x["n"], lead[f"{mate}_n"]) >= percent * np.maximum(x["n"], lead[f"{mate}_n"])) & (x["class"] != lead[mate])
                a.append(x["class"][fit])
                b.append(np.full(fit.sum(), lead[mate]))
            a, b = np.concatenate(a), np.concatenate(b)
            yield out(2, np.minimum(a, b), np.maximum(a, b))

        def lists(x: dict):
            """x: whole lists only, sorted by token, n, class."""
            start = np.flatnonzero(np.concatenate([[True], x["token"][1:] != x["token"][:-1]]))
            size = np.diff(np.concatenate([start, [len(x["token"])]]))
            found = []
            for m in np.unique(size[(size > 1) & (size <= most)]).tolist():
                s = start[size == m]
                for i in range(m - 1):
                    for j in range(i + 1, m):
                        a, b = s + i, s + j
                        na, nb = x["n"][a], x["n"][b]
                        room = np.minimum(na - x["pos"][a], nb - x["pos"][b])
                        ok = (100 * na >= percent * nb) & (room >= _least(na, nb, percent))
                        ok &= (x["first"][a] != x["first"][b]) | (x["first"][a] == x["token"][a])
                        found.append((x["class"][a[ok]], x["class"][b[ok]]))
            for s, m in zip(start[size > most].tolist(), size[size > most].tolist(), strict=True):
                part = {k: v[s : s + m] for k, v in x.items()}
                yield from long_rows(part, leader(part))
            if found:
                a, b = (np.concatenate(z) for z in zip(*found, strict=True))
                if len(a):
                    pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                    yield out(0, np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1]))

        def leader(part: dict) -> dict:
            mid = most // 2
            return {"token": part["token"][0], "class": part["class"][0], "class_n": part["n"][0], "hub": part["class"][mid], "hub_n": part["n"][mid]}

        def cut(x: dict, e: slice) -> dict:
            return {k: v[e] for k, v in x.items()}

        held: list[dict] = []
        held_n, lead = 0, None

        def advance(x: dict, end: bool):
            """Rows out of x; what must wait for more rows stays held."""
            nonlocal held, held_n, lead
            new = np.ones(len(x["token"]), bool)
            new[1:] = (x["token"][1:] != x["token"][:-1]) | (x["class"][1:] != x["class"][:-1])
            x = {k: v[new] for k, v in x.items()}
            if lead is not None:
                same = int(np.searchsorted(x["token"], lead["token"], "right"))
                if same:
                    yield from long_rows(cut(x, slice(0, same)), lead)
                if same == len(x["token"]) and not end:
                    held, held_n = [], 0
                    return
                x, lead = cut(x, slice(same, None)), None
            last = len(x["token"]) if end else int(np.searchsorted(x["token"], x["token"][-1]))
            if last:
                yield from lists(cut(x, slice(0, last)))
            x = cut(x, slice(last, None))
            if len(x["token"]) > most and not end:
                lead = leader(x)
                yield from long_rows(x, lead)
                x = cut(x, slice(0, 0))
            held, held_n = [x], len(x["token"])

        for batch in batches:
            held.append({k: batch.column(k).to_numpy() for k in ("token", "class", "n", "pos", "first")})
            held_n += batch.num_rows
            if held_n >= 100_000:
                yield from advance({k: np.concatenate([h[k] for h in held]) for k in held[0]}, False)
        if held_n:
            yield from advance({k: np.concatenate([h[k] for h in held]) for k in held[0]}, True)

    return rows.repartition("token").sortWithinPartitions("token", "n", "class").mapInArrow(run, "kind long, a long, b long, token long, n long")


def blocks_of(rows: DataFrame) -> DataFrame:
    """rows(leader, class, n, ...) with left, right: the pair of blocks, once for every pair of blocks that a row is in."""
    by_size = Window.partitionBy("leader").orderBy("n", "class")
    cut = rows.withColumn("block", F.floor((F.row_number().over(by_size) - 1) / BLOCK).cast("int"))
    cut = cut.withColumn("last", F.max("block").over(Window.partitionBy("leader")))
    cut = cut.withColumn("mate", F.explode(F.sequence(F.lit(0), "last")))
    return cut.withColumn("left", F.least("block", "mate")).withColumn("right", F.greatest("block", "mate")).drop("last", "mate")


def group_pairs(rows: DataFrame, percent: int, best: bool) -> DataFrame:
    """a, b, sure: from rows (leader, left, right, block, class, n, component, shared with the leader or -1,
    lead_n, histogram) the pairs of different components that may link; sure where the leader proves it.
    best: of each set only the pair with most room."""

    def run(batches):
        import pyarrow as pa

        names = ["a", "b", "sure"]

        def one(x: dict):
            """The rows of one pair of blocks."""
            order = np.lexsort((x["class"], x["n"]))
            block, n, comp, o, cls = (x[k][order] for k in ("block", "n", "component", "shared", "class"))
            alone, lead_n = x["left"][0] == x["right"][0], int(x["lead_n"][0])
            counts = [x["histogram"][i] for i in order]
            whole = np.array([h is not None for h in counts])
            table = np.stack([np.frombuffer(h, np.uint8) if h is not None else np.zeros(1 << SLOT_BITS, np.uint8) for h in counts])
            for i in range(len(cls) - 1):
                last = int(np.searchsorted(n, 100 * n[i] // percent, "right"))  # larger sets are out of reach
                j = np.arange(i + 1, max(i + 1, last))
                j = j[(comp[j] != comp[i]) & (alone | (block[j] != block[i]))]
                need = _least(n[i], n[j], percent)
                known = (o[j] >= 0) & (o[i] >= 0)
                most = np.where(known, np.minimum(o[i], o[j]) + np.minimum(n[i] - o[i], n[j] - o[j]), n[i])
                j, need, known = (v[most >= need] for v in (j, need, known))
                if not len(j):
                    continue
                sure = known & (o[i] + o[j] - lead_n >= need)
                room = np.minimum(table[j], table[i]).sum(axis=1, dtype=np.int64) if len(j) else need
                keep = sure | (room >= need) | ~whole[j] | ~whole[i]
                if keep.any():
                    if best:
                        keep = np.arange(len(j)) == np.where(keep, room - need, -(1 << 60)).argmax()
                    b = cls[j[keep]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cls[i], b)), pa.array(np.maximum(cls[i], b)), pa.array(sure[keep])], names=names)

        kinds = ("leader", "left", "right", "block", "class", "n", "component", "shared", "lead_n")
        held: list[dict] = []

        def flush():
            yield from one({k: [h for x in held for h in x[k]] if k == "histogram" else np.concatenate([x[k] for x in held]) for k in held[0]})

        key = None
        for batch in batches:
            x = {k: batch.column(k).to_numpy() for k in kinds} | {"histogram": batch.column("histogram").to_pylist()}
            new = np.flatnonzero(np.concatenate([[True], (x["leader"][1:] != x["leader"][:-1]) | (x["left"][1:] != x["left"][:-1]) | (x["right"][1:] != x["right"][:-1])]))
            for a, b in zip(new.tolist(), [*new[1:].tolist(), batch.num_rows], strict=True):
                now = (x["leader"][a], x["left"][a], x["right"][a])
                if held and now != key:
                    yield from flush()
                    held = []
                key = now
                held.append({k: v[a:b] for k, v in x.items()})
        if held:
            yield from flush()

    return rows.repartition("leader", "left", "right").sortWithinPartitions("leader", "left", "right").mapInArrow(run, "a long, b long, sure boolean")


def compare(pairs: DataFrame, sets: DataFrame, percent: int, width: int = WIDTH) -> DataFrame:
    """a, b, shared, na, nb of pairs(a, b), by their sets(class, text): a text is less than its shingles, which are made anew, once a batch."""
    left = maybe_in(sets, "class", pairs, "a").select(F.col("class").alias("a"), F.col("text").alias("x"))
    right = maybe_in(sets, "class", pairs, "b").select(F.col("class").alias("b"), F.col("text").alias("y"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, y, a_all, b_all = (batch.column(k).to_pylist() for k in ("x", "y", "a", "b"))
            for i, j in in_batches([p + q for p, q in zip(x, y, strict=True)], CHARS):
                of = dict(zip(a_all[i:j] + b_all[i:j], x[i:j] + y[i:j], strict=True))
                made = dict(zip(of, shingle_sets(list(of.values()), width), strict=True))
                shared, na, nb = [], [], []
                for a, b in zip(a_all[i:j], b_all[i:j], strict=True):
                    both = np.concatenate([made[a], made[b]])
                    both.sort()
                    shared.append(int((both[1:] == both[:-1]).sum()))
                    na.append(len(made[a]))
                    nb.append(len(made[b]))
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a_all[i:j], b_all[i:j], shared, na, nb)], names=["a", "b", "shared", "na", "nb"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, shared long, na long, nb long")


def in_slices(scratch: Scratch, rows: DataFrame, key: str, make: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """make of the rows, by slices of key: each is a table whose shuffle goes before the next begins."""
    n = min(SLICES, rows.count() // SLICE + 1)
    slot = F.pmod(F.xxhash64(F.lit(11), key), F.lit(n))
    parts = [scratch.cut(make(rows.filter(slot == i) if n > 1 else rows), label, release=True) for i in range(n)]
    return reduce(DataFrame.unionByName, parts)


def _histogram(h: np.ndarray) -> bytes | None:
    """Shingles in each of SLOTS hash ranges; None where a count does not fit a byte."""
    c = np.bincount((h >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=1 << SLOT_BITS)
    return None if c.max(initial=0) > 255 else c.astype(np.uint8).tobytes()


def sieve(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose histograms leave room for enough shared shingles: |x & y| <= sum of minima.

    Much less is moved than the sets themselves, and no pair that links is lost.
    """
    table = sets.select("class", "n", "histogram")
    for side in ("a", "b"):
        h = maybe_in(table, "class", pairs, side).select(F.col("class").alias(side), F.col("n").alias(f"n{side}"), F.col("histogram").alias(f"h{side}"))
        pairs = pairs.join(h, side)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ha, hb = batch.column("ha").to_pylist(), batch.column("hb").to_pylist()
            need = _least(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent)
            keep = [
                x is None or y is None or int(np.minimum(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)).sum()) >= k
                for x, y, k in zip(ha, hb, need.tolist(), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "na", "nb", "ha", "hb").mapInArrow(run, "a long, b long")


def _packed(docs: DataFrame, width: int) -> DataFrame:
    """class, n, histogram, text of docs(text)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in in_batches(texts, CHARS):
                s = shingle_sets(texts[a:b], width)
                yield pa.RecordBatch.from_arrays([
                    pa.array([_class(v) for v in s], pa.int64()), pa.array([len(v) for v in s], pa.int64()),
                    pa.array([_histogram(v) for v in s], pa.binary()), pa.array(texts[a:b], pa.string()),
                ], names=["class", "n", "histogram", "text"])

    return docs.select("text").mapInArrow(run, "class long, n long, histogram binary, text string")


def _component_of(rows: DataFrame, comps: DataFrame, column: str) -> DataFrame:
    """rows with `_column`, the component of the class in column."""
    of = comps.select(F.col("node").alias(column), F.col("component").alias(f"_{column}"))
    return rows.join(of, column, "left").withColumn(f"_{column}", F.coalesce(f"_{column}", column))


def _crossing(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs(a, b) of different components."""
    return _component_of(_component_of(pairs, comps, "a"), comps, "b").filter("_a <> _b").select("a", "b")


def _open_groups(listed: DataFrame, comps: DataFrame, met: DataFrame) -> DataFrame:
    """leader, class, n, component, shared (with the leader, -1 if not known), lead_n: the sets of long lists
    that are of several components, once for each leader."""
    long = _component_of(listed.filter("kind = 1").select("token", "n", F.col("a").alias("class"), F.col("b").alias("leader")), comps, "class")
    ends = long.groupBy("token").agg(F.min("_class").alias("lo"), F.max("_class").alias("hi")).filter("lo < hi").select("token")
    rows = long.join(ends, "token", "left_semi").select("leader", "class", "n", F.col("_class").alias("component")).distinct()
    lead_n = rows.filter("class = leader").select("leader", F.col("n").alias("lead_n"))
    seen = met.select(F.col("a").alias("_x"), F.col("b").alias("_y"), F.col("shared").alias("_s"))
    rows = rows.join(seen, (F.least("class", "leader") == F.col("_x")) & (F.greatest("class", "leader") == F.col("_y")), "left")
    shared = F.when(F.col("class") == F.col("leader"), F.col("n")).otherwise(F.coalesce("_s", F.lit(-1)))
    return rows.join(lead_n, "leader").select("leader", "class", "n", "component", shared.alias("shared"), "lead_n")


def similarity_classes(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links); no pairs or link counts, as pairs inside a component are skipped."""
    return _members(docs, width, percent).select("doc_id", "n_shingles", "component_id")


def _members(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, key, n_shingles, component_id and first_key, the key of the component's row that stays."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    both = scratch.cut(classes(docs, width), "set-classes")
    nodes = both.filter("kind = 0").select("doc_id", "key", "class", "n")
    often = (
        both.filter("kind = 1").groupBy("class").agg(F.sum("n").alias("n")).filter(F.col("n") >= 2 * NOTED)
        .orderBy(F.desc("n"), "class").limit(FREQUENT).collect()
    )
    h = np.array([r["class"] for r in often], np.int64).view(np.uint64)
    rank = np.arange(len(h))[::-1]  # the most frequent come last in the order
    if not len(h):
        h, rank = np.array([0], np.uint64), np.array([0])
    by_hash = np.argsort(h)
    order = (h[by_hash], rank[by_hash])
    reps = nodes.filter("n > 0").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("rep"))
    listed = scratch.cut(list_pairs(index_rows(docs, width, percent, order), percent, LIST), "set-lists", release=True)
    need = listed.filter("kind < 2").select(F.col("a").alias("class")).unionByName(listed.filter("kind < 2").select(F.col("b").alias("class"))).distinct()
    need = scratch.cut(need.join(reps, "class").select("class", F.col("rep.key").alias("rep")), "set-needed")

    def packed(need: DataFrame) -> DataFrame:
        few = maybe_in(docs.select(row_key().alias("key"), "text"), "key", need, "rep")
        return _packed(few.join(need.select(F.col("rep").alias("key")), "key", "left_semi").dropDuplicates(["key"]), width)

    sets = in_slices(scratch, need, "rep", packed, "sets")
    scratch.drop(need)
    overlaps = lambda pairs: in_slices(scratch, pairs, "a", lambda part: compare(part, sets, percent, width), "set-overlaps")
    sieved = lambda pairs: scratch.cut(sieve(pairs, sets, percent), "set-sieved", release=True)

    # leaders' pairs and each set's least partner first, then what short lists leave open, then long lists
    linked = (100 + percent) * F.col("shared") >= percent * (F.col("na") + F.col("nb"))
    short = listed.filter("kind = 0").select("a", "b")
    step = short.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").unionByName(listed.filter("kind = 2").select("a", "b")).distinct()
    step = scratch.cut(step, "set-first")
    met = overlaps(sieved(step))
    links = met.filter(linked).select("a", "b")
    comps = scratch.cut(connected_components(links, "a", "b"), "set-components")
    rest = _crossing(short, comps).distinct().join(step, ["a", "b"], "left_anti")
    rest = sieved(scratch.cut(rest, "set-crossing"))
    links = links.unionByName(overlaps(rest).filter(linked).select("a", "b"))
    comps = scratch.cut(connected_components(links, "a", "b"), "set-components")

    groups = scratch.cut(_open_groups(listed, comps, met), "set-open")
    for best in (True, False):  # each set's best pair joins what belongs together, so that fewer pairs are left
        if not has_rows(groups):
            break
        if not best:
            groups = scratch.cut(_component_of(groups.drop("component"), comps, "class").withColumnRenamed("_class", "component"), "set-open")
        told = blocks_of(groups).join(sets.select("class", "histogram"), "class")
        more = group_pairs(told, percent, best).groupBy("a", "b").agg(F.max("sure").alias("sure"))
        more = scratch.cut(more.join(step, ["a", "b"], "left_anti"), "set-more", release=True)
        unsure = overlaps(more.filter("not sure").select("a", "b")).filter(linked).select("a", "b")
        links = links.unionByName(unsure).unionByName(more.filter("sure").select("a", "b"))
        comps = scratch.cut(connected_components(links, "a", "b"), "set-components")
        step = step.unionByName(more.select("a", "b"))

    whole = reps.join(comps, reps["class"] == comps["node"], "left").select("class", "rep", F.coalesce("component", "class").alias("component"))
    ids = whole.groupBy("component").agg(F.min("rep").alias("first"))
    ids = whole.join(ids, "component").select(F.col("class").alias("_class"), F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("first_key"))
    return nodes.join(ids, (F.col("class") == F.col("_class")) & (F.col("n") > 0), "left").select(
        "doc_id", "key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("first_key", "key").alias("first_key")
    )


def keep_one(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Of each component the row of least doc_id, null last; of exactly repeated rows one stays."""
    gone = _members(docs, width, percent).filter("first_key <> key").select(F.col("key").alias("_key")).distinct()
    kept = docs.withColumn("_key", row_key()).join(gone, "_key", "left_anti")
    return kept.dropDuplicates(["_key"]).select(*docs.columns)
