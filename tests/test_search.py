"""Keyword search against SQLite's full-text search, vectors against numpy."""

import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivane.functions.porter import porter_stem
from lexivane.operators import fusion as U
from lexivane.operators import knn as N
from lexivane.operators import vector_lists as V
from lexivane.operators.bm25 import bm25_topk, match_all_terms
from lexivane.operators.postings import derive_index

WORDS = (
    "model models modeling registry register registered run running runs runner ran data dataset loader "
    "loading loads serve serving server train trained training trainer generalization generalize happy "
    "happiness relational rational feed agreed hopping hoping café cafe deploy deployment the the the of of"
).split()


def corpus(seed=1, rows=60):
    rng = random.Random(seed)
    pick = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    return [
        (f"c{i:02d}", pick(rng.randint(0, 25)) + " the", pick(rng.randint(0, 4)), pick(rng.randint(0, 3)))
        for i in range(rows)
    ]


def fts(rows, match):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(chunk_id unindexed, content, title, heading_path, tokenize='porter')")
    con.executemany("insert into t values (?, ?, ?, ?)", rows)
    return {r[0]: abs(r[1]) for r in con.execute("select chunk_id, bm25(t) from t where t match ?", (match,))}


@pytest.mark.parametrize(
    "question, match",
    [
        ("models", "models*"),
        ("the model", "the* AND model*"),
        ("Training data", "training* AND data*"),
        ("cafe of", "cafe* AND of"),
        ("registered runs", "registered* AND runs*"),
        ("the", "the*"),
        ("the the model", "the* AND the* AND model*"),
        ("model_registry", "model_registry*"),
        ("generalization", "generalization*"),
    ],
)
def test_bm25_equals_fts5(spark, question, match):
    rows = corpus()
    chunks = spark.createDataFrame(rows, "chunk_id string, content string, title string, heading_path string")
    q = spark.createDataFrame([(1, question)], "query_id bigint, q string")
    index = derive_index(chunks, fold=True, stem=True)
    got = {r["chunk_id"]: r["score"] for r in bm25_topk(q, index, k=1000).collect()}
    want = fts(rows, match.replace("_", " + ") if "_" in match else match)
    assert got.keys() == want.keys()
    assert all(abs(got[c] - want[c]) < 1e-6 for c in want)
    assert {r["chunk_id"] for r in match_all_terms(q, index).collect()} == want.keys()


def test_questions_without_matches(spark):
    chunks = spark.createDataFrame(corpus(), "chunk_id string, content string, title string, heading_path string")
    q = spark.createDataFrame([(1, "???"), (2, "nosuchword model"), (3, "__"), (4, "model")], "query_id bigint, q string")
    got = bm25_topk(q, derive_index(chunks), k=3).collect()
    assert {r["query_id"] for r in got} == {4}


def test_stems_equal_fts5():
    import itertools

    ends = "s es ies ed ing ational tional izer ization fulness iveness ly ement ness y ability al ance e ee eed er ic ll logi ology".split()
    stems = "relat condit valu oper form hop fall plast motor agre confl siz fizz happ sk run cre".split()
    words = sorted({a + b for a, b in itertools.product(stems, ends)} | set(w for w in WORDS if w.isascii()))
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(w, tokenize='porter')")
    con.executemany("insert into t(rowid, w) values (?, ?)", enumerate(words, 1))
    con.execute("create virtual table v using fts5vocab(t, instance)")
    want = {words[r[1] - 1]: r[0] for r in con.execute("select term, doc from v")}
    assert {w: porter_stem(w) for w in words} == want


def ranked(spark, ids, query_id=1):
    return spark.createDataFrame(
        [(query_id, c, 1.0 / i, i) for i, c in enumerate(ids, 1)],
        "query_id bigint, chunk_id string, score double, rank int",
    )


def fused(spark, vec, kw):
    return U.rrf_fuse(ranked(spark, vec), ranked(spark, kw))


def test_fusion(spark):
    rows = fused(spark, "abc", "bd").orderBy("fused_rank").collect()
    assert [(r["chunk_id"], round(r["score"], 6)) for r in rows] == [
        ("b", 0.032522), ("a", 0.016393), ("d", 0.016129), ("c", 0.015873),
    ]
    assert [r["chunk_id"] for r in fused(spark, "a", "d").orderBy("fused_rank").collect()] == ["a", "d"]
    empty = ranked(spark, "a").filter("false")
    alone = U.rrf_fuse(ranked(spark, "abc"), empty).orderBy("fused_rank").collect()
    assert [r["chunk_id"] for r in alone] == ["a", "b", "c"]


def test_boost_and_cut(spark):
    urls = spark.createDataFrame(
        [("a", "x"), ("b", "x"), ("c", "x"), ("d", "file://pytorch-docs/n.rst")], "chunk_id string, source_url string"
    )
    queries = spark.createDataFrame([(1, "PyTorch loaders", 2)], "query_id bigint, q string, top_k int")
    out = U.domain_boost(fused(spark, "abc", "bd").join(urls, "chunk_id"), queries)
    rows = out.orderBy("final_rank").collect()
    assert [(r["chunk_id"], round(r["score"], 6)) for r in rows][:2] == [("d", 0.036129), ("b", 0.032522)]
    assert [r["fused_rank"] for r in rows] == [3, 1, 2, 4]
    assert {r["chunk_id"] for r in U.top_k(out, queries).collect()} == {"d", "b"}


def test_valid_queries(spark):
    rows = [(1, "x", 5), (2, " ", 5), (3, "x", 0), (4, "x", 21), (5, None, 5)]
    good, bad = U.valid_queries(spark.createDataFrame(rows, "query_id bigint, q string, top_k int"))
    assert [r["query_id"] for r in good.collect()] == [1]
    assert {r["query_id"]: r["error"] for r in bad.collect()} == {
        2: "empty query", 3: "top_k out of range", 4: "top_k out of range", 5: "empty query",
    }


def vectors(spark, seed, n, name, copies=0):
    rng = np.random.default_rng(seed)
    m = np.round(rng.normal(size=(n, 6)), 3)
    m[n - copies :] = m[0]
    m[1] = 0
    return m, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{name} bigint, embedding array<double>")


def brute(q, v, k, metric):
    out = set()
    for i, a in enumerate(q):
        rows = []
        for j, b in enumerate(v):
            if metric == "cosine":
                la, lb = np.linalg.norm(a), np.linalg.norm(b)
                if la == 0 or lb == 0:
                    continue
                s = a @ b / (la * lb)
            else:
                s = 1 / (1 + ((a - b) ** 2).sum())
            rows.append((-round(float(s), 6), j))
        out |= {(i, j, r) for r, (_, j) in enumerate(sorted(rows)[:k], 1)}
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2sq"])
@pytest.mark.parametrize("block", [4096, 7])
def test_knn(spark, monkeypatch, metric, block):
    """A third of the vectors are copies; small blocks make several passes."""
    monkeypatch.setattr(N, "QUERY_BLOCK", block)
    q, qdf = vectors(spark, 1, 20, "query_id")
    v, vdf = vectors(spark, 2, 60, "chunk_id", copies=20)
    got = {(r["query_id"], r["chunk_id"], r["rank"]) for r in N.knn(qdf, vdf, 5, metric, digits=6).collect()}
    assert got == brute(q, v, 5, metric)


def test_l2_scores(spark):
    q = spark.createDataFrame([(1, [0.0, 0.0])], "query_id bigint, embedding array<double>")
    v = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 0.0])], "chunk_id string, embedding array<double>")
    assert [r["score"] for r in N.knn(q, v, 2, "l2sq").orderBy("rank").collect()] == [1.0, 0.5]


def test_vectors_meet_those_of_their_length(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [1.0] * 9), (5, [0.0, 0.0])], "query_id bigint, embedding array<double>")
    v = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", None), ("c", [1.0]), ("d", [1.0, None]), ("e", [1.0, 1e-9]), ("f", [1.0] * 3)], "chunk_id string, embedding array<double>"
    )
    assert sorted((r["query_id"], r["chunk_id"]) for r in N.knn(q, v, 9).collect()) == [(1, "a"), (1, "e"), (3, "c")]
    assert {tuple(r) for r in N.knn_rejected(q, v).collect()} == {
        ("query", "2", "no vector"), ("query", "4", "no counterpart of this length"), ("vector", "b", "no vector"),
        ("vector", "d", "null component"), ("vector", "f", "no counterpart of this length"),
    }
    assert N.knn(q.limit(0), v, 9).count() == 0 and N.knn(q, v.limit(0), 9).count() == 0
    # without digits the full scores decide
    w = spark.createDataFrame([("a", [1.0, 2e-4]), ("z", [1.0, 1e-4])], "chunk_id string, embedding array<double>")
    q = q.where("query_id = 1")
    assert [r["chunk_id"] for r in N.knn(q, w, 1).collect()] == ["z"] and [r["chunk_id"] for r in N.knn(q, w, 1, digits=6).collect()] == ["a"]


def clustered(n, families=40, d=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(families, d))
    return [(i, (centres[i % families] + 0.15 * rng.normal(size=d)).tolist()) for i in range(n)]


def test_lists_find_neighbours_in_few_lists(spark, monkeypatch):
    """Where vectors lie in families, a tenth of them is enough."""
    rows = clustered(3000)
    v = spark.createDataFrame(rows, "chunk_id bigint, embedding array<double>")
    q = v.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    lists = V.build_lists(v, n_lists=90, k=5)
    exact = N.knn(q, v, 5)
    near = V.knn_lists(q, lists, 5)
    both = near.withColumnRenamed("score", "s").join(exact, ["query_id", "chunk_id"])
    assert both.count() >= 0.9 * exact.count() and both.where("abs(s - score) > 1e-12").count() == 0
    assert V.scored_share(lists) < 0.1
    monkeypatch.setattr(N, "QUERY_BLOCK", 7)
    again = V.knn_lists(q, lists, 5)
    key = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in df.collect())
    assert key(again) == key(near)
    plan = lists.rows.where("list in (3)")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan
    assert V.knn_lists(q, lists, 5, probes=len(lists.centroids)).join(exact, ["query_id", "chunk_id", "rank"]).count() == exact.count()


def test_lists_of_odd_vectors(spark):
    kind = "chunk_id string, embedding array<double>"
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [1.0]), ("e", [1.0, 1.0]), ("e", [1.0, 1.0])], kind)
    q = spark.createDataFrame([(1, [1.0, 0.1]), (2, [1.0]), (3, None)], "query_id bigint, embedding array<double>")
    lists = V.build_lists(v)
    assert sorted((r["query_id"], r["chunk_id"]) for r in V.knn_lists(q, lists, 9, probes=9).collect()) == [(1, "a"), (1, "e"), (1, "e")]
    assert V.knn_lists(q, V.build_lists(v.limit(0)), 9).count() == 0
