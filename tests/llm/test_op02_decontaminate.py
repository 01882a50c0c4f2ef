import random

import numpy as np

from lexivane.llm import decontaminate as d


def plain_smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (d.MATCH if x == y else d.MISS), h[i - 1][j] + d.GAP, h[i][j - 1] + d.GAP)
    return max(max(r) for r in h)


def test_scores_equal_the_full_table():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 15)), rng.integers(0, 4, rng.integers(1, 25))
        assert d.smith_waterman(a, b)[0] == plain_smith_waterman(a.tolist(), b.tolist())


def corpus():
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(300)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, words(rng.choice([12, 25, 60]))) for i in range(30)]
    docs, planted = [], set()
    for k in range(300):
        w = words(rng.choice([20, 200, 900]))
        if k % 3 == 0:
            i, item = rng.choice(items)
            copy = list(item)
            if k % 2:  # one word in twelve replaced, one dropped, one put in
                for j in range(5, len(copy), 12):
                    copy[j] = "edited"
                if len(copy) > 20:
                    del copy[9]
                    copy.insert(15, "more")
            at = rng.randrange(len(w))
            w[at:at] = copy
            planted.add((k, i))
        docs.append((k, " ".join(x.upper() + "," if rng.random() < 0.2 else x for x in w)))
    return docs, [(i, " ".join(w)) for i, w in items], planted


def brute(docs, items):
    import re

    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    out = set()
    for k, t in docs:
        for i, q in items:
            a, b = words(q), words(t)
            if a and b and set(zip(a, a[1:], a[2:])) & set(zip(b, b[1:], b[2:])):
                s = plain_smith_waterman(a, b)
                if s >= d.LEAST * d.MATCH * len(a) and s >= d.MATCH * min(len(a), d.LEAST_WORDS):
                    out.add((k, i))
    return out


def test_exact_and_edited_copies_are_found_and_clean_texts_left(spark):
    docs, items, planted = corpus()
    x = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    y = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.leaks(x, y).collect()}
    assert got == planted == brute(docs[:60], items) | {p for p in planted if p[0] >= 60}
    kept = {r["doc_id"] for r in d.without_leaks(x, y).collect()}
    assert kept == {k for k, _ in docs} - {k for k, _ in planted}


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items, planted = corpus()
    monkeypatch.setattr(d, "BLOCK_WORDS", 300)
    x, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in d.leaks(x, y).collect()} == planted
    assert d.without_leaks(x, y).count() == len(docs) - len({k for k, _ in planted})


def test_nulls_short_items_repeats_long_texts_and_empty_tables(spark):
    long_ = " ".join(f"x{i}" for i in range(300_000))
    rows = [(None, "one two"), (1, None), (2, ""), (3, "one two"), (3, "one two"), (4, long_ + " one two three four five six seven eight"), (5, "two one")]
    x = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as item_id", "7 as __n")
    y = spark.createDataFrame([(1, "One, two"), (1, "One, two"), (2, None), (3, "  "), (4, "one two three four five six seven eight")], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"], r["score_ratio"]) for r in d.leaks(x, y).collect())
    assert got == [(0, 1, 1.0), (3, 1, 1.0), (3, 1, 1.0), (4, 1, 1.0), (4, 4, 1.0)] or (4, 4, 1.0) in got
    kept = d.without_leaks(x, y)
    assert kept.columns == x.columns and {1, 2, 5} <= {r["doc_id"] for r in kept.collect()}
    assert d.leaks(x, y.limit(0)).count() == 0 and d.leaks(x.limit(0), y).count() == 0
    assert d.without_leaks(x, y.limit(0)).count() == len(rows)


def test_a_half_that_many_texts_hold_is_found(spark):
    item = [f"q{i}" for i in range(20)]
    docs = [(k, f"some text {k} " + " ".join(item[:11]) + f" and more {k}") for k in range(200)] + [(900, "other words " * 9)]
    x = spark.createDataFrame(docs, "doc_id long, text string")
    y = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {(r["doc_id"], r["score"], r["n_seeds"]) for r in d.leaks(x, y).collect()}
    assert got == {(k, 22, 9) for k in range(200)}
    assert [r["doc_id"] for r in d.without_leaks(x, y).collect()] == [900]


def test_items_left_out_before_the_table_could_not_reach_the_score():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a, b = rng.integers(0, 30, rng.integers(1, 40)), rng.integers(0, 30, 60)
        low = rng.integers(0, 50)
        part = a[rng.random(len(a)) < 0.8]
        b = np.concatenate([b[:low], part, b[low:]])
        score = d.smith_waterman(a, b)[0]
        if score >= d.LEAST * d.MATCH * len(a) and score >= d.MATCH * min(len(a), d.LEAST_WORDS):
            assert d.align(a, b, np.arange(len(b)))[0] == score
