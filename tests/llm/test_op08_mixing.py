from collections import Counter

import pytest

from lexivane.llm import mixing

KIND = "doc_id long, text string, source string"


def fill(sizes, weights, budget):
    """Targets by lifting all together in small steps of who is full first."""
    target, open_ = {s: 0.0 for s in sizes}, set(sizes)
    while budget > 1e-9 and open_:
        w = sum(weights[s] for s in open_)
        step = min([budget / w] + [(2 * sizes[s] - target[s]) / weights[s] for s in open_])
        for s in open_:
            target[s] += step * weights[s]
        budget -= step * w
        open_ = {s for s in open_ if target[s] < 2 * sizes[s] - 1e-9}
    return target


def rows(n=900):
    out = []
    for i in range(n):
        source = None if i % 50 == 0 else f"s{min(i % 7, i % 4)}" if i % 3 else "s0"  # s0 holds most rows
        out.append((i, " ".join(["w"] * (i % 37)) if i % 11 else None, source))
    return out


def test_targets_and_taken_words(spark):
    data = rows()
    got = mixing.mix_digest(spark.createDataFrame(data, KIND)).collect()
    sizes = Counter()
    for i, t, s in data:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target = fill(sizes, weights, 1.5 * sum(sizes.values()))
    source = {i: s for i, _, s in data}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= mixing.PACKET for s in sizes)
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_rows_come_as_often_as_they_are_taken(spark):
    df = spark.createDataFrame(rows(), KIND).selectExpr("*", "'x' as size", "1 as u")
    taken = {r["doc_id"]: -(-r["taken"] // r["size"]) for r in mixing.mix_digest(df).collect() if r["taken"]}
    mixed = mixing.mix_rows(df)
    assert mixed.columns == df.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == taken


def test_nulls_ties_and_empty_tables(spark):
    got = mixing.mix_digest(spark.createDataFrame([(None, None, None), (1, "a b", "s"), (1, "a b", "s"), (2, " ", "t")], KIND)).collect()
    assert sorted((r["size"], r["taken"], r["target"]) for r in got)[:2] == [(0, 0, 0.0), (0, 0, 0.0)]
    assert sum(r["taken"] for r in got) == 6 and len(got) == 4
    assert mixing.mix_digest(spark.createDataFrame([], KIND)).count() == 0
    assert mixing.mix_rows(spark.createDataFrame([], KIND)).count() == 0
    one = mixing.mix_digest(spark.createDataFrame([(1, "a " * 300_000, "s")], KIND)).first()
    assert (one["size"], one["taken"]) == (300_000, 450_000)
