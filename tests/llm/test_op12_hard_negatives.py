import math
import random

import numpy as np
import pytest

from lexivane.llm import hard_negatives as H

KIND = "vec_id long, label int, embedding array<double>"


def brute(rows, anchor_ids, k=5):
    """Rows of (anchor, positive, rank, negative, scores)."""
    use = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        c = [math.floor(256 * x) for x in v]
        if all(abs(x) < H.LARGEST for x in c):
            use.append((i, label, c))
    out = []
    for a in {(i, x, tuple(c)) for i, x, c in use if i in anchor_ids}:
        others = [(sum(p * q for p, q in zip(a[2], c)), -i, x) for i, x, c in use if i != a[0] and len(c) == len(a[2])]
        others.sort(reverse=True)
        for s, p in dict.fromkeys((s, i) for s, i, x in [o for o in others if o[2] == a[1]][:k]):
            found = [(t, i) for t, i, x in others if x != a[1] and 80 * s <= 100 * t <= 100 * s][:k]
            out += [(a[0], -p, r, -i, s, t) for r, (t, i) in enumerate(found, 1)]
    return sorted(out)


def rows_of(seed, n, d, scale=1.0):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(3), [rng.gauss(0.3, 1) * scale for _ in range(d)]) for i in range(n)]
    rows += [(n + i, rng.randrange(3), rows[0][2]) for i in range(n // 3)]  # ties: a third are copies
    return rows


def run(spark, rows, anchors):
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as score", "'x' as anchor").repartition(3)
    return sorted(tuple(r) for r in H.hard_negatives(df, df.where(df.vec_id.isin(anchors))).collect())


@pytest.mark.parametrize("block", [1024, 3])
@pytest.mark.parametrize("scale", [0.2, 3000.0])
def test_equals_brute_force(spark, monkeypatch, block, scale):
    """Large components need Python's integers; small blocks of anchors, several passes."""
    monkeypatch.setattr(H, "ANCHOR_BLOCK", block)
    monkeypatch.setattr(H, "SLICE", 16)
    rows = rows_of(3, 60, 6, scale)
    anchors = [0, 5, 10, 15, 20, 61]
    assert run(spark, rows, anchors) == brute(rows, anchors)


def test_packed_products_are_exact():
    rng = np.random.default_rng(1)
    for low, high, d in [(-256, 257, 64), (0, 2, 3), (-1, 0, 5), (-(1 << 23), 1 << 23, 17), (-(1 << 24) + 1, 1 << 24, 1), (7, 8, 1)]:
        a, v = rng.integers(low, high, (5, d)), rng.integers(low, high, (11, d))
        assert (H.scores(a, v) == a @ v.T).all()
    assert H.scores(np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64)).tolist() == [[0] * 3] * 2


def test_two_candidates_share_one_product():
    v = np.array([[3, -2], [-5, 7]])
    width = H._width(7, 4, 2)
    packed = H.pack(v, 5, width, 2)
    assert packed.shape == (2, 1) and packed.dtype == np.float64
    assert H.unpack(np.array([[4.0, -1.0]]) @ packed, width, 2).tolist() == [[4 * 8 - 3, 0 - 12]]


def test_rows_that_take_no_part_and_ties(spark):
    v = [0.5, 0.5]
    rows = [(0, 1, v), (1, 1, v), (2, 1, v), (3, 2, v), (3, 2, v), (4, 2, v), (5, None, v), (None, 2, v), (6, 2, None), (7, 2, [0.5, None]),
            (8, 2, [0.5, math.nan]), (9, 2, [0.5, math.inf]), (10, 2, [1e300, 0.5]), (11, 2, [0.5]), (12, 2, []), (0, 1, v)]
    got = run(spark, rows, [0, 12])
    assert got == brute(rows, [0, 12])
    assert [r[3] for r in got if r[:2] == (0, 1)] == [3, 3, 4]
    assert run(spark, rows, []) == []
    empty = spark.createDataFrame([], KIND)
    assert H.hard_negatives(empty, empty).count() == 0
