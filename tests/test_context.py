"""Neighbour context, answers and audits on cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from lexivane.operators import answers as A
from lexivane.operators import context as K
from lexivane.operators import stats as S


@pytest.fixture(scope="module")
def chain(spark):
    return spark.createDataFrame(
        [(f"c:{i}", "c", i, f"text {i}") for i in range(1, 10)],
        "chunk_id string, doc_key string, chunk_seq int, content string",
    )


def hits(spark, seqs):
    return spark.createDataFrame(
        [(1, f"c:{s}", 1.0 / r, r) for r, s in enumerate(seqs, 1)],
        "query_id bigint, chunk_id string, score double, rank int",
    )


@pytest.mark.parametrize(
    "seqs, walk, window",
    [
        ([5], [4, 3, 5, 6, 7], range(3, 8)),
        ([5, 4], [4, 3, 5, 6, 7], range(2, 8)),
        ([5, 8], [4, 3, 5, 6, 7, 8, 9], range(3, 10)),
        ([5, 7], [4, 3, 5, 6, 7, 8, 9], range(3, 10)),
        ([1], [1, 2, 3], range(1, 4)),
        ([9, 1], [8, 7, 9, 1, 2, 3], [1, 2, 3, 7, 8, 9]),
    ],
)
def test_expansion(spark, chain, seqs, walk, window):
    got = K.expand_context(hits(spark, seqs), chain).orderBy("position").collect()
    assert [int(r["chunk_id"][2:]) for r in got] == walk
    union = K.context_window(hits(spark, seqs), chain).orderBy("chunk_seq").collect()
    assert [r["chunk_seq"] for r in union] == list(window)


def test_hit_taken_in_as_neighbour_keeps_score_zero(spark, chain):
    got = {r["chunk_id"]: r["score"] for r in K.expand_context(hits(spark, [5, 4]), chain).collect()}
    assert got["c:5"] == 1.0 and got["c:4"] == 0.0


def test_fetch(spark, chain):
    ids = spark.createDataFrame([("c:3",), ("zz:1",)], "chunk_id string")
    got = {r["chunk_id"]: (r["found"], r["content"], r["rank"]) for r in K.fetch_chunks(ids, chain).collect()}
    assert got == {"c:3": (True, "text 3", 0), "zz:1": (False, None, 0)}


def test_context_prompt_and_sources(spark):
    rows = [
        (1, 2, "b", None, None, None, None, "B", 0.5),
        (1, 1, "a", "u", "T", "H", "u#h", "A {user_question}", 0.9),
        (2, 1, "c", "w", "V", "G", "w#g", "C", 0.1),
    ]
    results = spark.createDataFrame(
        rows,
        "query_id bigint, position int, chunk_id string, source_url string, title string, "
        "heading_path string, anchor_link string, content string, score double",
    )
    queries = spark.createDataFrame([(1, "why?", True), (2, "no", False)], "query_id bigint, q string, include_sources boolean")
    context = A.format_context(results)
    text = context.filter("query_id = 1").first()["context"]
    assert text == (
        "\n--- Chunk ID: a ---\nSource: u\nSection: H\nContent:\nA {user_question}\n---\n"
        "\n\n--- Chunk ID: b ---\nSource: Unknown\nSection: Unknown\nContent:\nB\n---\n"
    )
    prompt = A.build_prompt(queries, context, "Q={user_question} C={context_chunks}!").filter("query_id = 1").first()
    assert prompt["prompt"] == f"Q=why? C={text}!"
    lists = {r["query_id"]: r for r in A.source_list(results, queries).collect()}
    assert [s["chunk_id"] for s in lists[1]["sources"]] == ["a", "b"]
    assert lists[1]["sources"][1]["title"] == "Unknown" and lists[1]["sources"][1]["url"] == ""
    assert lists[2]["sources"] == [] and lists[2]["chunks_retrieved"] == 1


def test_citations(spark):
    answers = spark.createDataFrame(
        [
            ("1", "X is Y [Source: a]. Z [Source: q]."),
            ("2", "X [Source: a]."),
            ("3", "X [Source: a]. Bare."),
            ("4", "X. [Source: a] Y. [Source: b]"),
        ],
        "answer_id string, answer string",
    )
    sources = spark.createDataFrame([(str(i), c) for i in range(1, 5) for c in "ab"], "answer_id string, chunk_id string")
    got = {r["answer_id"]: (r["n_cited"], r["n_invalid"], r["n_uncited"], r["verdict"]) for r in A.citation_audit(answers, sources).collect()}
    assert got == {
        "1": (2, 1, 0, "NON_COMPLIANT"),
        "2": (1, 0, 0, "COMPLIANT"),
        "3": (1, 0, 1, "NON_COMPLIANT"),
        "4": (2, 0, 0, "COMPLIANT"),
    }


def test_labels_find_word_runs(spark):
    passages = spark.createDataFrame([(1, "b c"), (2, "x"), (3, "a b c d e f g h i j"), (4, "b d"), (5, "")], "query_id bigint, text string")
    docs = spark.createDataFrame(
        [("p", "a b\nc d e f g h i j"), ("q", "ab c x"), ("r", "xx")], "chunk_id string, content string"
    )
    got = {(r["query_id"], r["chunk_id"]) for r in A.containment_labels(passages, docs).collect()}
    assert got == {(1, "p"), (2, "q"), (3, "p")}


def test_evaluation(spark):
    labels = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "query_id bigint, chunk_id string")
    results = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (2, "z", 1)], "query_id bigint, chunk_id string, rank int")
    got = {r["k"]: (r["n_queries"], r["recall"], r["mrr"]) for r in A.retrieval_eval(results, labels, (1, 5)).collect()}
    assert got == {1: (2, 0.0, 0.0), 5: (2, 0.25, 0.25)}


def test_capacity(spark):
    docs = spark.createDataFrame([(60000,), (40000,)], "word_count int")
    row = S.capacity_estimate(docs, spark.range(1000)).first()
    assert (row["est_chunks_by_words"], row["est_chunks_by_size"]) == (500, 400)
    assert round(row["storage_mb"], 4) == 2.9297 and round(row["tier_percent"], 4) == 0.2861
    assert not (row["warn_80"] or row["warn_90"] or row["warn_chunks"])
    empty = S.capacity_estimate(docs.filter("false"), spark.range(0)).first()
    assert empty["total_words"] == 0 and empty["storage_mb"] == 0
