"""Whitening of embeddings: streamed covariance, merged over partitions, and a symmetric QR eigen-solve.

An entry c becomes the integer x = floor(64 c) + 1000000 (held within 2^52 of that offset). Every
distinct integer vector counts once. Each partition runs over its vectors with Welford's rank-one
updates of mean and scatter; the states of partitions are merged by the parallel update formula,
first in tasks, then the last few on the driver (a matrix of dimensions squared each, whatever the
rows). The covariance goes to tridiagonal form by reflections and to diagonal form by implicit QR
steps. Rows are projected where they lie, without a shuffle. A second pass over the distinct
vectors measures how far the covariance of what came out is from the identity.

Defined cases: vectors that are null or hold null or non-finite entries take no part; where lengths
differ, the most frequent one among distinct vectors (ties: the longest) is whitened and the others take no part; repeated rows
get rows each but count once in the fit; null ids stay null; components whose eigenvalue is zero
within rounding do not exist, so one distinct vector, or an empty table, gives no rows; a deviation
beyond a long is null; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch

SCALE, OFFSET, LIMIT = 64, 1_000_000, 2.0**52
MERGE_TASKS = 16
_STATE = "dim long, n long, sums string, mean binary, scatter binary"


class Moments:
    """Count, exact sums, mean and scatter (sum of outer products of deviations) of the vectors seen."""

    def __init__(self, dim: int):
        self.n, self.sums, self.mean, self.scatter = 0, [0] * dim, np.zeros(dim), np.zeros((dim, dim))

    def add(self, rows: np.ndarray) -> None:
        """Welford: a rank-one update a row."""
        product, mean, scatter, n = np.empty_like(self.scatter), self.mean, self.scatter, self.n
        for x in rows.astype(np.float64):
            n += 1
            before = x - mean
            mean += before / n
            np.multiply.outer(before, x - mean, out=product)
            scatter += product
        self.n = n

    def count(self, rows: np.ndarray) -> None:
        """Exact sums of integer rows, in two halves that cannot overflow."""
        high, low = (rows >> 26).sum(axis=0), (rows & ((1 << 26) - 1)).sum(axis=0)
        self.sums = [s + (int(h) << 26) + int(k) for s, h, k in zip(self.sums, high, low, strict=True)]

    def merge(self, other: Moments) -> None:
        n = self.n + other.n
        if other.n:
            gap = other.mean - self.mean
            self.scatter += other.scatter + np.multiply.outer(gap, gap) * (self.n * other.n / n)
            self.mean += gap * (other.n / n)
        self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums, strict=True)]

    def row(self) -> dict:
        return {"dim": len(self.mean), "n": self.n, "sums": ",".join(map(str, self.sums)), "mean": self.mean.tobytes(), "scatter": self.scatter.tobytes()}

    @classmethod
    def of(cls, r) -> Moments:
        m = cls(r["dim"])
        m.n, m.sums = r["n"], [int(s) for s in r["sums"].split(",")]
        m.mean, m.scatter = np.frombuffer(r["mean"]).copy(), np.frombuffer(r["scatter"]).reshape(m.scatter.shape).copy()
        return m


def _merged(rows) -> dict[int, Moments]:
    out: dict[int, Moments] = {}
    for r in rows:
        m = Moments.of(r)
        if m.n:
            out.setdefault(len(m.mean), Moments(len(m.mean))).merge(m)
    return out


def _matrix(column) -> np.ndarray:
    """The rows of an Arrow list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def moments(vectors: DataFrame, project: tuple[np.ndarray, np.ndarray] | None = None) -> dict[int, Moments]:
    """Moments of vectors(x array<long>) by their length; project: of (x - OFFSET - centre) @ axes instead."""

    def states(batches):
        import pyarrow as pa

        held: dict[int, Moments] = {}
        for batch in batches:
            column = batch.column("x")
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                x = _matrix(column.filter(pa.array(lengths == dim)) if (lengths != dim).any() else column)
                if project:
                    y = (x - OFFSET - project[0]) @ project[1]
                    held.setdefault(y.shape[1], Moments(y.shape[1])).add(y)
                else:
                    m = held.setdefault(int(dim), Moments(int(dim)))
                    m.add(x - OFFSET)
                    m.count(x)
        if held:
            yield pa.RecordBatch.from_pylist([m.row() for m in held.values()])

    def merge(batches):
        import pyarrow as pa

        held = _merged(r for batch in batches for r in batch.to_pylist())
        if held:
            yield pa.RecordBatch.from_pylist([m.row() for m in held.values()])

    found = vectors.select("x").mapInArrow(states, _STATE).withColumn("node", F.pmod(F.spark_partition_id(), F.lit(MERGE_TASKS)))
    return _merged(found.repartition(MERGE_TASKS, "node").drop("node").mapInArrow(merge, _STATE).collect())  # a matrix a merging task


def symmetric_qr(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, the largest entry of each positive."""
    a, n = np.array(matrix, np.float64), len(matrix)
    q = np.eye(n)  # rows are the vectors to come
    for k in range(n - 2):  # reflections to tridiagonal form
        u = a[k + 1 :, k].copy()
        if not u[1:].any():
            continue
        u[0] += np.copysign(np.linalg.norm(u), u[0])
        u /= np.linalg.norm(u)
        a[k + 1 :] -= np.multiply.outer(2 * u, u @ a[k + 1 :])
        a[:, k + 1 :] -= np.multiply.outer(a[:, k + 1 :] @ u, 2 * u)
        q[k + 1 :] -= np.multiply.outer(2 * u, u @ q[k + 1 :])
    d, e = np.diag(a).copy(), np.diag(a, 1).copy()
    hi, steps = n - 1, 0
    while hi > 0:
        e[np.abs(e) <= np.finfo(float).eps * (np.abs(d[:-1]) + np.abs(d[1:]))] = 0
        if e[hi - 1] == 0:
            hi -= 1
            continue
        steps += 1
        if steps > 60 * n:
            raise ArithmeticError("the QR steps do not converge")
        lo = hi - 1
        while lo and e[lo - 1]:
            lo -= 1
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - np.copysign(1.0, half) * e[hi - 1] ** 2 / (abs(half) + np.hypot(half, e[hi - 1]))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):  # the bulge is chased down
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            p, b, t = d[k], e[k], d[k + 1]
            d[k], d[k + 1], e[k] = c * c * p + 2 * c * s * b + s * s * t, s * s * p - 2 * c * s * b + c * c * t, c * s * (t - p) + (c * c - s * s) * b
            if k < hi - 1:
                x, z, e[k + 1] = e[k], s * e[k + 1], c * e[k + 1]
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    q = q[order]
    q *= np.copysign(1.0, q[np.arange(n), np.abs(q).argmax(axis=1)])[:, None]
    return d[order], q.T


@dataclass
class Whitening:
    """What a fit found: n and exact sums of the distinct vectors, and components by falling eigenvalue."""

    dim: int
    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    explained: np.ndarray
    identity_error: float

    def centre(self) -> np.ndarray:
        """Mean of x - OFFSET, each rounded once."""
        return np.array([(s - self.n * OFFSET) / self.n for s in self.sums])

    def scaled(self) -> np.ndarray:
        return self.axes / np.sqrt(self.values)


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, x: the integer vectors of the rows that take part."""
    e = F.col(column).cast("array<double>")
    bad = F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    held = lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), c * SCALE))
    x = F.transform(e, lambda c: F.floor(held(c)).cast("bigint") + OFFSET)
    return vectors.filter(F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(False))).select(F.col(id_col).cast("bigint").alias("vec_id"), x.alias("x"))


def fit_whitening(vectors: DataFrame, components: int = 16) -> Whitening | None:
    """Fit on the distinct integer vectors of vectors(vec_id, embedding); None where there is nothing to fit."""
    scratch = Scratch(vectors.sparkSession)
    distinct = scratch.cut(integer_vectors(vectors).filter(F.size("x") > 0).select("x").distinct(), "whitening-fit")
    by_dim = moments(distinct)
    if not by_dim:
        return None
    dim, m = max(by_dim.items(), key=lambda kv: (kv[1].n, kv[0]))
    cov = (m.scatter + m.scatter.T) / (2 * m.n)
    values, axes = symmetric_qr(cov)
    kept = min(components, int((values > dim * np.finfo(float).eps * max(values[0], 0)).sum()))
    out = Whitening(dim, m.n, m.sums, values[:kept], axes[:, :kept], values[:kept] / np.trace(cov), 0.0)
    if kept:
        (w,) = moments(distinct.filter(F.size("x") == dim), (out.centre(), out.scaled())).values()
        out.identity_error = float(np.abs(w.scatter / w.n - np.eye(kept)).max())
    scratch.drop(distinct)
    return out


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation (exact), whitened array<double> of every row that takes part."""
    dim, n, sums, centre, axes = model.dim, model.n, model.sums, model.centre(), model.scaled()

    def deviations(x: np.ndarray) -> list[int | None]:
        exact = np.array(sums, object)
        if x.size and n * float(np.abs(x).max()) < 2**62 and max(map(abs, sums)) < 2**62:
            y = n * x - exact.astype(np.int64)
            if dim * float(np.abs(y).max()) ** 2 < 2**62:
                return (y * y).sum(axis=1).tolist()
        y = n * x.astype(object) - exact
        return [t if t < 2**63 else None for t in (y * y).sum(axis=1).tolist()]

    def project(batches):
        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column("x"))
            y = (x - OFFSET - centre) @ axes
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * y.shape[1], pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviations(x), pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    return integer_vectors(vectors).filter(F.size("x") == dim).mapInArrow(project, "vec_id long, deviation long, whitened array<double>")
