"""Document fingerprints of closed syncmers.

A k-mer is a closed syncmer if the least hash among its s-mers is at its first or last place.
Whether it is depends on the k-mer alone, so two texts that share a passage choose the same
anchors in it, and at least one in every k - s + 1 places. A fingerprint holds the `keep`
anchors with the least hashes of a whole text (`keep=None`: all), each with the place of its first
occurrence; the query keeps 96.

Likeness matches anchors by hash and by position: of the anchors below both fingerprints'
horizon, it counts those in both whose shift between the texts agrees with the shift that most
of them have (within `slack` of the larger text), over all of them.

Defined cases: null is the empty text, with an empty fingerprint; a text without a syncmer is
its own single anchor; equal fingerprints have likeness 1, two different ones with nothing in
common 0; repeated rows follow one another in the order of their texts' hashes; further
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch
from .tokens import in_batches

#: One length of anchor for all texts, so that texts of any two lengths can match.
K, S, KEEP, SLACK = 16, 8, 96, 0.02


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window, by doubling: h(2w) from two h(w)."""
    h, have, out, at = codes, 1, None, 0
    n = len(codes)
    while True:
        if width & have:
            m = n - at - have + 1
            piece = h[at : at + max(m, 0)]
            if out is None:
                out = piece
            else:
                out = out[: len(piece)] * np.uint64(0x9E3779B97F4A7C15) + piece
            at += have
        have *= 2
        if have > width:
            break
        half = have // 2
        h = h[: len(h) - half] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * half) + h[half:]
    return _mix(out[: max(0, n - width + 1)])


def fingerprints(texts: list[str], keep: int | None = KEEP, k: int = K, s: int = S) -> list[str]:
    """One fingerprint a text: `hash:position` in hexadecimal, by hash; all texts in one pass.

    keep=None keeps every anchor, so that any passage two texts share can be found by position.
    """
    data = "".join(texts).encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(data, "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    out = [""] * len(texts)
    for i in np.flatnonzero(lengths > 0):  # stays where a text has no syncmer
        out[i] = hashlib.sha256(texts[i].encode("utf-8", "surrogatepass")).hexdigest()[:10] + ":0"
    if len(codes) < k or not (lengths >= k).any():
        return out
    inner = _rolling(codes + np.uint64(1), s)
    least, have, span = inner, 1, k - s + 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    n = len(least)
    picked = np.flatnonzero((inner[:n] == least) | (inner[k - s : k - s + n] == least))
    doc = np.searchsorted(starts, picked, "right") - 1
    inside = picked + k <= starts[doc + 1]
    picked, doc = picked[inside], doc[inside]
    h = _rolling(codes + np.uint64(1), k)[picked] >> np.uint64(24)
    order = np.argsort((doc.astype(np.uint64) << np.uint64(40)) | h)
    d, v, p = doc[order], h[order], picked[order]
    if len(d):
        run = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])]))
        d, v, p = d[run], v[run], np.minimum.reduceat(p, run) - starts[d[run]]
        first = np.searchsorted(d, np.arange(len(texts)))
        for i in np.unique(d).tolist():
            end = first[i + 1] if i + 1 < len(texts) else len(d)
            e = slice(first[i], end if keep is None else min(first[i] + keep, end))
            out[i] = ",".join([f"{x:010x}:{y:x}" for x, y in zip(v[e].tolist(), p[e].tolist(), strict=True)])
    return out


def likeness(a: str, b: str, size_a: int, size_b: int, keep: int | None = KEEP, slack: float = SLACK) -> float:
    if a == b:
        return 1.0
    x = dict(e.split(":") for e in a.split(",")) if a else {}
    y = dict(e.split(":") for e in b.split(",")) if b else {}
    horizon = min((max(z) for z in (x, y) if keep is not None and len(z) >= keep), default="g")
    x, y = ({h: int(p, 16) for h, p in z.items() if h <= horizon} for z in (x, y))
    shifts = sorted(y[h] - x[h] for h in x.keys() & y.keys())
    if not shifts:
        return 0.0
    room = 2 * slack * max(size_a, size_b)
    best = i = 0
    for j, v in enumerate(shifts):
        while v - shifts[i] > room:
            i += 1
        best = max(best, j - i + 1)
    return best / len(x.keys() | y.keys())


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) dealt to ranges of doc_id, each with the first document after it.

    Returns rows (part, doc_id, text, own) sorted within partitions: for `own` rows the next row
    of the same part is the next document; the rows that are not own close each part. Text is
    shuffled once. The bounds are quantiles of doc_id; null ids are a part of their own, and the first
    document of all also closes the last part.
    """
    spark = docs.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    quantiles = docs.select(F.percentile_approx("doc_id", F.lit([(i + 1) / parts for i in range(parts - 1)]), F.lit(20 * parts))).first()[0] or []
    bounds = sorted(set(quantiles))
    part: Column = F.when(F.col("doc_id").isNull(), F.lit(-1))
    part = F.coalesce(part, F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>"), lambda b: b < F.col("doc_id"))))
    placed = docs.select(part.cast("int").alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie"))
    # one row a part: the least document of the part, to be copied to the part before
    key = F.struct("doc_id", "tie")
    heads = Scratch(spark).cut(placed.groupBy("part").agg(F.min(key).alias("head")), "heads")
    around = Window.orderBy("part")  # at most `parts` rows
    closes = F.coalesce(F.lag("part").over(around), F.max("part").over(Window.partitionBy(F.lit(1))))
    heads = heads.select(F.col("part").alias("head_part"), F.col("head.doc_id").alias("head_id"), F.col("head.tie").alias("head_tie"), closes.alias("closes"))
    match = (F.col("part") == F.col("head_part")) & F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    halo = placed.join(F.broadcast(heads), match).select(F.col("closes").alias("part"), "doc_id", "text", "tie", F.lit(False).alias("own"))
    rows = placed.select("part", "doc_id", "text", "tie", F.lit(True).alias("own")).unionByName(halo)
    # the documents of a group of repeated heads are equal, so one of them closes the part as well as another
    # part numbers go to partitions as they are: hashed, some would meet and others be empty
    return rows.repartitionById(parts + 1, F.col("part") + 1).sortWithinPartitions("part", F.col("own").desc(), "doc_id", "tie")


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses."""
    columns = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

    def walk(batches):
        import pyarrow as pa

        kinds = {"doc_id": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}
        schema = pa.schema([(c, kinds.get(c, pa.string())) for c in columns])
        held: list[tuple] = []

        def flush():
            """All held rows but the last have their next row behind them."""
            rows, texts = held, [r[2] for r in held]
            edits = []
            for i in range(len(rows) - 1):
                cut = len(texts[i]) // 4
                edits.append(texts[i][: len(texts[i]) - cut] + texts[i + 1][:cut] if rows[i][3] and rows[i][0] == rows[i + 1][0] else "")
            prints, edited = fingerprints(texts), fingerprints(edits)
            out = []
            for i in range(len(rows) - 1):
                if rows[i][3] and rows[i][0] == rows[i + 1][0]:
                    t, nxt = texts[i], texts[i + 1]
                    out.append((
                        rows[i][1], len(t), hashlib.sha256(edits[i].encode("utf-8", "surrogatepass")).hexdigest(), prints[i], edited[i],
                        likeness(prints[i], edited[i], len(t), len(edits[i])), likeness(prints[i], prints[i + 1], len(t), len(nxt)),
                    ))
            del held[: len(held) - 1]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            part, ids, own = (batch.column(c).to_pylist() for c in ("part", "doc_id", "own"))
            texts = batch.column("text").to_pylist()
            for a, b in in_batches(texts):
                held.extend(zip(part[a:b], ids[a:b], texts[a:b], own[a:b], strict=True))
                yield from flush()
        if held:
            yield from flush()

    return with_next(docs).select("part", "doc_id", "text", "own").mapInArrow(
        walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
