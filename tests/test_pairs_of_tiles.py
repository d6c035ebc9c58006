"""Pairs that tiles make along sorted items, against all pairs judged one by one."""

import random
from types import SimpleNamespace

import numpy as np
import pytest

from twinsieve.operators import tiles as B


def side(g, n, ids, bucket=None):
    seconds = np.array([g.choice([-3.0, 0.0, 0.5, 1.0, 4.9, 7.5, 7.6, 12.5, 12.6, 17.5, g.uniform(0, 30), float("nan")]) for _ in range(n)])
    of = np.round(np.maximum(0, np.nan_to_num(seconds)) / 5).astype("i8")
    rows = SimpleNamespace(id=np.array(g.sample(ids, n)), bucket=of, duration_s=seconds, ratio=np.array([g.choice([0.0, 1.0, 1.2, 1.78, 4 / 3]) for _ in range(n)]), n=np.zeros(n, "i8"))
    return rows if bucket is None else B._taken(rows, rows.bucket == bucket)


def listed(parts):
    return sorted((min(x, y), max(x, y)) for xs, ys in parts for x, others in zip(xs.tolist(), ys.to_pylist(), strict=True) for y in others if x != y)


@pytest.mark.parametrize("seed", range(6))
def test_pairs_of_a_tile(seed, monkeypatch):
    monkeypatch.setattr(B, "CHUNK", 37)  # several chunks a tile
    g = random.Random(seed)
    a, b = side(g, 120, range(150), bucket=g.randrange(4)), side(g, 120, range(150))
    b = B._taken(b, b.bucket >= (a.bucket[0] if len(a.id) else 0))
    # b holds a's whole bucket, as a tile's blocks do in turn
    b = SimpleNamespace(**{k: np.concatenate([getattr(a, k), getattr(b, k)[(b.bucket > a.bucket[0]) if len(a.id) else slice(None)]]) for k in vars(a)})
    x, y = B.at(a, b, B.once_all(a, b))
    assert listed(B.all_pairs(a, b)) == sorted(zip(*(e.tolist() for e in B.ends(x, y)), strict=True))
    for aspect in (None, 0.2, 0.5):
        x, y = B.at(a, b, B.once_all(a, b) & B.gate(SimpleNamespace(duration_s=a.duration_s[:, None], ratio=a.ratio[:, None]), SimpleNamespace(duration_s=b.duration_s[None, :], ratio=b.ratio[None, :]), 8.0, aspect))
        assert listed(B.gated_pairs(a, b, 8.0, aspect)) == sorted(zip(*(e.tolist() for e in B.ends(x, y)), strict=True))


def test_pairs_leave_a_tile_as_lists(spark):
    """Before, every pair crossed from Python to Spark as a row, from a mask of all pairs."""
    from twinsieve.operators import matching as M

    schema = "file_id long, duration_s double, width int, height int"
    rows = [(i, float(g), 16, 9) for i, g in enumerate([1, 2, 3, 11, 12, 40])] + [(3, 17.0, 16, 9)]
    pairs = M.block_pairs(spark.createDataFrame(rows, schema), 8.0, "off")
    assert "explode" in pairs._jdf.queryExecution().analyzed().toString()
    assert {tuple(r) for r in pairs.collect()} >= {(0, 1), (0, 2), (1, 2), (3, 4)} and all(r.file_a < r.file_b for r in pairs.collect())
