"""Blocks of terms: made by tile, in rounds, without leaving shuffle files."""

import os
import random
import time

from pyspark.sql import functions as F

from lexivane.operators import blocks as BL
from lexivane.operators import bm25 as B
from lexivane.operators import postings as PO
from lexivane.operators.chunking import chunk_documents
from lexivane.session import freed_shuffles
from lexivane.sources import index_store as IS


def texts(spark, n, words=25, parts=3):
    rng = random.Random(4)
    word = lambda: rng.choice(["Über", "data", "naïve", "the", "x_1", "…", "42"]) + str(rng.randrange(60))
    rows = [(f"k{i:04d}", "u", f"Title {i % 7}", " ".join(word() for _ in range(rng.randrange(words)))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_key string, url string, title string, content string").repartition(parts)


def test_blocks_by_tile_equal_grouped_postings(spark, monkeypatch):
    rows = texts(spark, 500).withColumnsRenamed({"doc_key": "chunk_id"}).withColumn("heading_path", F.when(F.rand(1) < 0.5, "the data"))
    rows = rows.unionByName(rows.limit(70).withColumns({"content": F.lit(None).cast("string"), "title": F.lit("!"), "heading_path": F.lit(None).cast("string")}))
    placed = PO.with_place(rows).cache()
    want = PO.term_blocks(PO.chunk_terms(placed, keep=("tile", "slot")))
    listed = lambda df: sorted(map(str, df.select(*want.columns).collect()))
    for at_once, batch in ((1 << 20, 10_000), (300, 50)):
        monkeypatch.setattr(BL, "TOKENS_AT_ONCE", at_once)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = BL.blocks_of_tiles(placed, 3)
            assert listed(got) == listed(want) and got.select(*want.columns).schema.simpleString() == want.schema.simpleString()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert BL.blocks_of_tiles(placed.limit(0), 3).count() == 0


def test_rounds_write_the_same_index(spark, folder, monkeypatch):
    """However many rounds, each tile is in one; chunks without a word keep their place."""
    chunks = chunk_documents(texts(spark, 700).unionByName(texts(spark, 1).withColumns({"doc_key": F.lit("bare"), "title": F.lit("?"), "content": F.lit("...")})))
    chunks = chunks.withColumn("heading_path", F.when(F.col("doc_key") != "bare", F.col("heading_path")))
    one = IS.IndexStore(spark, f"{folder}/one", n_buckets=2, term_buckets=2, stem=False)
    one.write(chunks)
    monkeypatch.setattr(IS, "TOKENS_PER_ROUND", 1000)
    many = IS.IndexStore(spark, f"{folder}/many", n_buckets=2, term_buckets=2, stem=False, rounds=5)
    seen, rounds = [], IS.IndexStore._rounds
    monkeypatch.setattr(IS.IndexStore, "_rounds", lambda self, stored: (seen.append(rounds(self, stored)), seen[-1])[1])
    many.write(chunks)
    assert len(seen[0][0]) == 5 and sum(x.count() for x in seen[0][0]) == chunks.count()
    for name in ("postings", "lengths", "vocab", "stats"):
        rows = [sorted(map(str, getattr(s.open(), name).drop("tile").collect())) for s in (one, many)]
        assert rows[0] == rows[1]
    assert many.open().lengths.where("chunk_id = 'bare:1'").first()["n_tokens"] == 0


def test_a_write_gives_back_its_shuffle_files(spark, folder):
    """They must not wait for the driver's garbage collection; a large index fills the disk first."""
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()

    def shuffles():
        return {f for top in dirs for _, _, names in os.walk(top.getPath()) for f in names if f.startswith("shuffle_")}

    def new_after(act):
        was = shuffles()
        act()
        until = time.time() + 10
        while shuffles() - was and time.time() < until:
            time.sleep(0.2)
        return shuffles() - was

    dealt = lambda name: texts(spark, 50).repartition(2, "doc_key").write.parquet(f"{folder}/{name}")
    assert new_after(lambda: dealt("kept"))

    def freed():
        with freed_shuffles(spark):
            dealt("freed")

    assert not new_after(freed)
    chunks = texts(spark, 300)
    store = IS.IndexStore(spark, f"{folder}/ix", n_buckets=2, term_buckets=2, stem=False)
    assert not new_after(lambda: store.write(chunk_documents(chunks)))


def test_questions_read_the_tiles_in_rounds(spark, folder, monkeypatch):
    """Words, prefixes and phrases find the same in one round or many, and what a round
    stored is not read for another."""
    store = IS.IndexStore(spark, f"{folder}/ix", n_buckets=2, term_buckets=2, stem=False)
    store.write(chunk_documents(texts(spark, 600)))
    asked = [(1, "the1 data"), (2, "uber"), (3, "x_1"), (4, "na"), (5, "title the"), (6, "nothing here"), (7, "da th 42")]
    q = spark.createDataFrame(asked, "query_id bigint, q string")
    one = sorted(map(str, B.bm25_topk(q, store.open(), k=4, digits=6).collect()))
    pairs = sorted(map(str, B.match_all_terms(q, store.open()).collect()))
    monkeypatch.setattr(B, "CHUNKS_PER_ROUND", 150)
    rounds = B.in_rounds(store.open())
    found = [r["chunk_id"] for _, part in rounds for r in part.lengths.collect()]
    assert len(rounds) == 4 and len(found) == len(set(found)) == store.open().chunks.count()
    assert sorted(map(str, B.bm25_topk(q, store.open(), k=4, digits=6).collect())) == one and len(one) > 8
    assert sorted(map(str, B.match_all_terms(q, store.open()).collect())) == pairs
