"""Approximate nearest neighbours by collision counting over query-centred windows.

Index: vectors are dealt to shards of bounded size; a shard holds its unit vectors' projections
on `lines` random directions, each as one sorted array. Search: around the query's own
projection each array opens a window of half width R. A vector collides where it lies in the
window; one that collides on `threshold` of the lines or more is verified by its exact cosine.
R grows step by step (virtual rehashing: the same arrays serve every R, only the new margins
are counted) until `k` verified vectors lie within distance R, so that anything nearer would
have collided often enough with high probability, or until R covers the unit sphere, when all
rest is verified. Nothing caps windows or candidates.

A shard stays in one task, to which all blocks of queries (a small share of the vectors) are sent; its
answers are k rows a query, and the nearest over all shards are ranked per query.

Defined cases: vectors null, zero, or with null or non-finite components take no part, as
query or as candidate; vectors only meet vectors of their dimension; a query never finds rows
of its own vec_id; repeated query rows are one query, rows of one vec_id with different vectors
several; repeated candidate rows are counted first, compared once and take a rank each; copies tie and go by vec_id; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch

LINES, THRESHOLD, STEP = 64, 0.56, 1.3
SHARD_ROWS, BLOCK_QUERIES = 16_384, 1024


def directions(dim: int, lines: int = LINES) -> np.ndarray:
    return np.random.default_rng(3).standard_normal((dim, lines))


class Shard:
    """Sorted projections of some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        p = (vectors / self.norms[:, None]) @ directions(vectors.shape[1])
        self.order = np.ascontiguousarray(np.argsort(p, axis=0, kind="stable").T.astype(np.int32))
        self.sorted = np.ascontiguousarray(np.sort(p, axis=0).T)

    def cosines(self, rows: np.ndarray, q: np.ndarray, norm: float) -> np.ndarray:
        """In double precision, each by the same sum whatever other rows are asked for."""
        return (self.vectors[rows] * q).sum(axis=1) / (self.norms[rows] * norm)

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest found, as rows and cosines, the query's own id left out."""
        n, norm = len(self.ids), float(np.sqrt((q * q).sum()))
        at = (q / norm) @ directions(len(q))
        counts, verified = np.zeros(n, np.uint8), np.zeros(n, bool)
        low = high = np.array([np.searchsorted(s, x) for s, x in zip(self.sorted, at, strict=True)])
        rows, scores = [], []
        need, radius = int(np.ceil(THRESHOLD * LINES)), 0.3
        while True:
            far = radius >= 2
            if not far:
                new_low = np.array([np.searchsorted(s, x - radius) for s, x in zip(self.sorted, at, strict=True)])
                new_high = np.array([np.searchsorted(s, x + radius, "right") for s, x in zip(self.sorted, at, strict=True)])
                for j in range(LINES):
                    counts[self.order[j, new_low[j] : low[j]]] += 1
                    counts[self.order[j, high[j] : new_high[j]]] += 1
                low, high = new_low, new_high
            fresh = np.flatnonzero(~verified) if far else np.flatnonzero((counts >= need) & ~verified)
            verified[fresh] = True
            fresh = fresh[self.ids[fresh] != own]
            rows.append(fresh)
            scores.append(self.cosines(fresh, q, norm))
            near = np.concatenate(scores)
            if far or (near >= 1 - radius * radius / 2).sum() >= k:
                found = np.concatenate(rows)
                best = np.lexsort((self.ids[found], -near))[:k]
                return found[best], near[best]
            radius *= STEP


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding as doubles, of the vectors that take part."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists(e, lambda x: x != 0)
    return vectors.select("vec_id", e.alias("embedding")).filter(F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & ~F.coalesce(zero, F.lit(True)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """For each of queries(vec_id, embedding) its k nearest vectors: query_id, rank, vec_id, score."""
    scratch = Scratch(vectors.sparkSession)
    rows = usable(vectors).groupBy("vec_id", "embedding").agg(F.count("*").alias("times"))
    asked = usable(queries).distinct().withColumn("times", F.lit(1).cast("bigint"))
    shards = max(1, -(-usable(vectors).count() // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))

    def packed(df: DataFrame, parts: int, name: str) -> DataFrame:
        def pack(key, pdf):
            import pandas as pd

            raw = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            ids = pdf["vec_id"].fillna(np.iinfo(np.int64).min).astype(np.int64).to_numpy()
            nos = pdf["no"].to_numpy(np.int64)
            return pd.DataFrame({"dim": [int(key[0])], name: [int(key[1])], "ids": [ids.tobytes()], "nos": [nos.tobytes()], "times": [pdf["times"].to_numpy(np.int64).tobytes()], "matrix": [raw.tobytes()]})

        # by the row alone: a task that runs again deals its rows the same way
        keyed = df.select(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(parts)).alias(name), "vec_id", "embedding", F.xxhash64("embedding").alias("no"), "times")
        return keyed.groupBy("dim", name).applyInPandas(pack, f"dim long, {name} long, ids binary, nos binary, times binary, matrix binary")

    index = scratch.cut(packed(rows, shards, "shard"), "ann-index")
    ask = scratch.cut(packed(asked, blocks, "block"), "ann-queries")

    def search(batches):
        import pyarrow as pa

        shard, shard_key, times = None, None, None
        none = np.iinfo(np.int64).min
        schema = pa.schema([("query_id", pa.int64()), ("no", pa.int64()), ("vec_id", pa.int64()), ("times", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            for r in batch.to_pylist():
                ids, matrix = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["matrix"], np.float64).reshape(-1, r["dim"])
                if r["block"] < 0:  # the shard comes before its blocks
                    shard_key, shard, times = (r["dim"], r["shard"]), Shard(ids, matrix), np.frombuffer(r["times"], np.int64)
                    continue
                if shard_key != (r["dim"], r["shard"]):
                    raise ValueError("a block of queries without its shard")
                found, of, nos, score, many = [], [], [], [], []
                for own, no, v in zip(ids.tolist(), np.frombuffer(r["nos"], np.int64).tolist(), matrix, strict=True):
                    at, s = shard.search(own, v, k)
                    found.append(shard.ids[at])
                    score.append(s)
                    many.append(times[at])
                    of.append(np.full(len(at), own))
                    nos.append(np.full(len(at), no))
                of, found = np.concatenate(of), np.concatenate(found)
                yield pa.RecordBatch.from_arrays([
                    pa.array(of, mask=of == none), pa.array(np.concatenate(nos)), pa.array(found, mask=found == none), pa.array(np.concatenate(many)), pa.array(np.concatenate(score)),
                ], schema=schema)

    sent = ask.join(index.select("dim", "shard"), "dim").select("dim", "shard", "block", "ids", "nos", "times", "matrix")
    held = index.select("dim", "shard", F.lit(-1).cast("long").alias("block"), "ids", "nos", "times", "matrix")
    both = held.unionByName(sent).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "block")
    found = both.mapInArrow(search, "query_id long, no long, vec_id long, times long, score double")
    found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(F.col("times"), F.lit(k)).cast("int"))))
    rank = F.row_number().over(Window.partitionBy("query_id", "no").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
