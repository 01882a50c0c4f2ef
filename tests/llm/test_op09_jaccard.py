import random
import re

import pytest

from lexivane.llm import jaccard
from lexivane.llm.components import components

W = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(t, n):
    w = W.findall((t or "").translate(LOW))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                same = len(sets[i] & sets[j])
                if 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                    root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, len(sets[i]), low.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def edited(rng, words, share):
    return [rng.choice(words) + "x" if rng.random() < share else w for w in words]


def corpus(seed, families=6, size=12, alone=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    shared = [rng.choice(vocab) for _ in range(40)]  # a passage of many texts
    rows, i = [], 0
    for _ in range(families):
        base = [rng.choice(vocab) for _ in range(rng.choice([5, 30, 150, 400]))]
        for _ in range(size):
            rows.append((i, " ".join(edited(rng, base, rng.choice([0, 0.005, 0.02, 0.05])))))
            i += 1
    for k in range(alone):
        own = [rng.choice(vocab) for _ in range(rng.choice([3, 20, 80]))]
        rows.append((i, " ".join(own + shared if k % 2 else own)))
        i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot,block", [(32, 512), (4, 5)])
def test_components_equal_all_pairs(spark, monkeypatch, hot, block):
    """Also with so low a bound that most lists are long and families take many blocks."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus(hot)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for n, percent in ((4, 85), (5, 80)):
        got = jaccard.similar_sets(df, n, percent).collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows, n, percent)


def test_nulls_repeats_short_and_long_texts(spark):
    long_ = " ".join(f"w{i * i % 7919}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b"), (4, "A B"), (4, "A B"), (None, "null id alone"), (5, "a"), (6, "A"), (7, long_), (8, long_ + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "'t' as toks")
    assert sorted(map(tuple, jaccard.similar_sets(df, 4, 85).collect()), key=repr) == brute(rows, 4, 85)
    assert jaccard.similar_sets(spark.createDataFrame([], "doc_id long, text string"), 4, 85).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c"), (1, "A b c"), (1, "A b c"), (2, "other words"), (None, "a b c"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as component_id")
    got = jaccard.one_of_each(df, 5, 80)
    assert got.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(1, "A b c"), (2, "other words"), (9, None)]


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}


def test_dense_texts_that_share_one_rare_ngram(spark, monkeypatch):
    """Two short texts whose other n-grams are in many texts, in many hash orders."""
    monkeypatch.setattr(jaccard, "HOT", 2)
    rows = []
    for g in range(200):
        w = [f"g{g}w{i}" for i in range(11)]
        rows += [(len(rows), " ".join(w[:10])), (len(rows) + 1, " ".join(w))]
        for f in range(2):
            rows.append((len(rows), " ".join(w[1:] + [f"g{g}f{f}x{i}" for i in range(40)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.similar_sets(df, 4, 85).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 4, 85)
