"""The pipeline against the operators' brute force, stage by stage."""

from collections import Counter, defaultdict

import corpus_pipeline
from test_op02_decontaminate import brute as leaks
from test_op05_quality import brute as counts
from test_op09_jaccard import brute as groups

from lexivane.llm import quality
from lexivane.session import materialize

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_do_their_whole_job(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, before, SF))
        old, new = before.collect(), after.collect()
        text = {r["doc_id"]: r["text"] for r in old}
        kept = Counter(r["doc_id"] for r in new)
        assert all(text[r["doc_id"]] == r["text"] for r in new), name
        if name == "quality rules":
            base = {i for i, t in text.items() if (c := counts(t))[0] >= 50 and 100 * c[4] <= 50 * c[0]}
            assert set(kept) <= base and len(kept) > 0.9 * len(base) - 20 and max(kept.values()) == 1
        elif name == "n-gram Jaccard join":
            assert set(kept) == {low for d, _, low in groups([(r["doc_id"], r["text"]) for r in old], 5, 80) if low is not None}
            assert max(kept.values()) == 1
        elif name == "benchmark decontamination":
            dirty = {d for d, _ in leaks([(i, t) for i, t in text.items() if any(x.split()[0].lower() in t.lower() for _, x in items)], items)}
            assert set(kept) == set(text) - dirty
        elif name == "mixing sources to target weights":
            assert max(kept.values()) <= 2
            words = lambda rows: sum(len(r["text"].split()) for r in rows)
            assert words(new) >= 1.4 * words(old)
        else:
            assert len(new) == len(old) and kept == Counter(r["doc_id"] for r in old)
            slots = defaultdict(list)
            for r in new:
                slots[r["shard"]].append(r["slot"])
            assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        before = after
    assert rows_of(corpus_pipeline.run(spark, SF)) == rows_of(before)


def test_each_stage_takes_empty_and_odd_documents(spark):
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "en", None, 0), (2, "short", None, "s", 5), (2, "short", None, "s", 5)],
        "doc_id long, text string, lang string, source string, n_chars long",
    ).selectExpr("*", "1 as shard", "'x' as size")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() <= 4
        assert stage(spark, odd.limit(0), SF).count() == 0
    assert quality.judge(odd).where("kept").count() == 0


def test_stages_keep_columns_of_any_name(spark):
    """Names that the stages use inside stay the user's own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).selectExpr(
        "*", "doc_id as keep", "doc_id as lower", "doc_id as counts", "doc_id as key", "doc_id as place", "doc_id as whole", "doc_id as row",
        "doc_id as size", "doc_id as finish", "doc_id as k1", "doc_id as u", "doc_id as label", "map('a', doc_id) as extra",
    )
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        assert after.columns[: len(docs.columns)] == docs.columns, name
        rows = [r.asDict() for r in after.collect()]
        assert rows and all(r[c] == r["doc_id"] for r in rows for c in docs.columns[5:-1]), name
        assert all(r["extra"] == {"a": r["doc_id"]} for r in rows), name
