"""Limiter, frontier, stored index and streams."""

import datetime as dt
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexivane.operators import bm25 as B
from lexivane.operators import ratelimit as R
from lexivane.operators.bm25 import bm25_topk
from lexivane.operators.chunking import chunk_documents
from lexivane.operators.embedding import embed_dedup, embed_hash, embed_udf, mean_pool
from lexivane.operators.frontier import crawl_sources, frontier_bfs
from lexivane.operators.pages import clean_pages, extract_links, seed_select, split_ok_quarantine
from lexivane.operators import postings as PO
from lexivane.operators.postings import bucket_of_term
from lexivane.operators.stats import store_counts
from lexivane.plans.ingest import ingest_pages, run_ingest
from lexivane.plans.retrieve import hybrid_retrieve, prompts
from lexivane.sources.index_store import ConcurrentWrite, IndexStore
from lexivane.streaming.incremental import DOCUMENT_SCHEMA, incremental_ingest
from lexivane.streaming.limiter import STATE_PROVIDER, rate_limit_stream, window_count_stream

T0 = dt.datetime(2024, 1, 1)


def requests(spark, rows):
    data = [(i, c, T0 + dt.timedelta(seconds=s)) for i, (c, s) in enumerate(rows)]
    return spark.createDataFrame(data, "event_id bigint, client string, ts timestamp")


def plain_limit(rows, limit, window):
    held, out = defaultdict(list), {}
    for i, (c, s) in sorted(enumerate(rows), key=lambda e: (e[1][1], e[0])):
        held[c] = [h for h in held[c] if h > s - window]
        out[i] = len(held[c]) < limit
        if out[i]:
            held[c].append(s)
    return out


def verdicts(df):
    return {r["event_id"]: r["admitted"] for r in df.collect()}


def test_limit_by_hand(spark):
    rows = [("a", s) for s in (0, 5, 7, 10, 11, 16)]
    got = verdicts(R.rate_limit(requests(spark, rows), "client", "ts", "event_id", 2, 10))
    assert [got[i] for i in range(6)] == [True, True, False, True, False, True]


@pytest.mark.parametrize("limit, window, slice_rows", [(2, 10, 1000), (1, 7, 60), (5, 30, 100)])
def test_limit_equals_a_plain_loop(spark, limit, window, slice_rows):
    """One client sends a third of all requests; some times are equal. Small
    slices make its stretch be worked in several rounds."""
    rng = random.Random(limit)
    rows = [("hot", rng.randint(0, 400)) for _ in range(500)]
    rows += [(f"c{rng.randint(0, 30)}", rng.choice([rng.randint(0, 2000), rng.randint(0, 50)])) for _ in range(1000)]
    out = R.rate_limit(requests(spark, rows), "client", "ts", "event_id", limit, window, slice_rows)
    assert verdicts(out) == plain_limit(rows, limit, window)


def test_window_count(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aab"), rng.randint(0, 300)) for _ in range(300)]
    out = R.window_count(requests(spark, rows), "client", "ts", 20).collect()
    for r in out:
        c, s = rows[r["event_id"]]
        assert r["n_recent"] == sum(1 for d, t in rows if d == c and s - 20 < t <= s)
    assert len(out) == 300


@pytest.mark.parametrize("pieces", [1, 3, 8, 10**9])
def test_window_count_of_a_busy_client(spark, pieces):
    """Nine of ten requests are one client's; its intervals are many tasks' work."""
    rng = random.Random(6)
    rows = [("busy" if i % 10 else rng.choice(["b", None]), rng.choice([rng.randint(0, 400), 50])) for i in range(800)]
    df = requests(spark, rows).withColumn("ts", F.when(F.col("event_id") != 7, F.col("ts")))
    got = {r["event_id"]: r["n_recent"] for r in R.window_count(df, "client", "ts", 20, pieces).collect()}
    live = [(i, c, s) for i, (c, s) in enumerate(rows) if i != 7]
    assert got == {i: sum(d == c and s - 20 < t <= s for _, d, t in live) for i, c, s in live} | {7: None}
    plan = R.window_count(df, "client", "ts", 20)._jdf.queryExecution().toString()
    assert "windowspecdefinition(_k" in plan and "windowspecdefinition(client" not in plan
    assert R.window_count(df.limit(0), "client", "ts", 20).count() == 0


def test_stream_of_requests_equals_batch(spark, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    rng = random.Random(9)
    rows = sorted(((rng.choice("abc"), rng.randint(0, 500)) for _ in range(120)), key=lambda r: r[1])
    df = requests(spark, rows)
    for part in range(3):
        df.filter(f"event_id >= {part * 40} and event_id < {part * 40 + 40}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = rate_limit_stream(stream, "client", "ts", "event_id", 2, 30, delay="1 hour")
    sink = out.writeStream.option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True)
    sink.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    got = verdicts(spark.read.parquet(f"{folder}/out"))
    assert got == plain_limit(rows, 2, 30)


def test_late_requests_and_a_limit_of_none(spark, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    parts = ([("a", 100), ("a", 105)], [("a", 50)], [("b", 400)], [("a", 401), ("a", 120), ("a", 121)])
    rows = [r for p in parts for r in p]
    df, at = requests(spark, rows), 0
    for part in parts:
        df.filter(f"event_id >= {at} and event_id < {at + len(part)}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        at += len(part)
        stream = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
        out = rate_limit_stream(stream, "client", "ts", "event_id", 3, 60, delay="1 hour")
        sink = out.writeStream.option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True)
        sink.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    got = verdicts(spark.read.parquet(f"{folder}/out"))
    # 120 still sees 100 and 105; 121 sees these and 120
    assert got == {0: True, 1: True, 2: True, 3: True, 4: True, 5: True, 6: False}
    assert set(verdicts(R.rate_limit(df, "client", "ts", "event_id", 0, 60)).values()) == {False}


def test_requests_beyond_the_delay_leave_a_row(spark, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    parts = ([("a", 100)], [("b", 5000)], [("c", 5001)], [("a", 90), ("a", 5002), ("d", 7)])
    df, at = requests(spark, [r for p in parts for r in p]), 0
    for part in parts:
        df.filter(f"event_id >= {at} and event_id < {at + len(part)}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        at += len(part)
        out = rate_limit_stream(spark.readStream.schema(df.schema).parquet(f"{folder}/in"), "client", "ts", "event_id", 1, 60, delay="1 minute")
        sink = out.writeStream.option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True)
        sink.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    got = {r["event_id"]: (r["admitted"], r["reason"]) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {0: (True, None), 1: (True, None), 2: (True, None), 3: (None, "late"), 4: (True, None), 5: (None, "late")}


def test_requests_without_client_or_time_are_kept(spark):
    df = requests(spark, [("a", 1), (None, 2), ("a", 3)])
    df = df.withColumn("ts", F.when(F.col("event_id") != 2, F.col("ts")))
    assert verdicts(R.rate_limit(df, "client", "ts", "event_id", 1, 10)) == {0: True, 1: None, 2: None}


def test_stream_of_window_counts(spark, folder):
    df = requests(spark, [("a", 1), ("a", 2), ("b", 70), ("a", 5000)])
    df.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
    out = window_count_stream(stream, "client", "ts", "60 seconds")
    run = out.writeStream.format("memory").queryName("counts").outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted((r["client"], r["n"]) for r in spark.table("counts").collect())
    assert got == [("a", 1), ("a", 2), ("b", 1)]


def test_frontier(spark):
    pairs = ["ab", "ac", "bd", "ce", "df", "fa", "xy", "eg", "gh"]
    edges = spark.createDataFrame([tuple(p) for p in pairs], "src string, dst string")
    start = spark.createDataFrame([("a",)], "url string")
    depth = lambda df: {r["url"]: r["depth"] for r in df.collect()}
    full = {"a": 0, "b": 1, "c": 1, "d": 2, "e": 2, "f": 3, "g": 3, "h": 4}
    assert depth(frontier_bfs(edges, start)) == full
    assert depth(frontier_bfs(edges, start, max_pages=4)) == {"a": 0, "b": 1, "c": 1, "d": 2}
    good = spark.createDataFrame([(u,) for u in "abdf"], "url string")
    assert depth(frontier_bfs(edges, start, accepted=good)) == {"a": 0, "b": 1, "d": 2, "f": 3}
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(12)], "src string, dst string")
    assert depth(frontier_bfs(chain, spark.createDataFrame([("n0",)], "url string"))) == {f"n{i}": i for i in range(13)}


def test_crawl_of_many_sources(spark):
    """Against the one-by-one crawl, source after source, budget by budget."""
    rng = random.Random(11)
    hosts = ["http://a.org", "http://b.org"]
    urls = [f"{rng.choice(hosts)}/{rng.choice(['docs', 'blog'])}/p{i}" for i in range(60)]
    links = {u: rng.sample(urls, 3) for u in urls}
    good = {u for i, u in enumerate(urls) if i % 7}
    html = lambda u: "".join(f"<a href='{v}?q=1#x'>l</a>" if v.startswith("http://a") else f"<a href=\"{v}\">l</a>" for v in links[u]) + "<a href='docs/p3'>r</a>"
    pages = spark.createDataFrame([(u, html(u), u in good) for u in urls] * 2, "url string, html string, accepted boolean")
    rules = [
        ("s1", "http://a.org/x/", [urls[1], urls[2]], ["/docs/"], 8), ("s2", "http://b.org/", [urls[3], urls[0], "http://no.org"], [], 25),
        ("s3", "http://b.org/", [urls[4]], None, 1000), ("s4", "http://b.org/", [urls[5]], ["/docs/"], 0), (None, "http://b.org/", [urls[5]], [], 9),
        ("s5", "http://b.org/", None, [], 9),
    ]
    sources = spark.createDataFrame(rules, "name string, base_url string, start_urls array<string>, allowed_patterns array<string>, max_pages int")
    want = set()
    for name, base, start, allowed, most in rules:
        if name is None or most < 1:
            continue
        level, seen, depth, got = sorted(set(start or [])), set(start or []), 0, []
        while level and len(got) < most:
            took = [u for u in level if u in good]
            got += [(name, u, depth) for u in took]
            found = {v for u in took for v in [*links[u], base + "docs/p3"] if not allowed or any(a in v for a in allowed)}
            level, depth = sorted(found - seen), depth + 1
            seen |= found
        want |= {(*g, i) for i, g in enumerate(got[:most], 1)}
    out = crawl_sources(pages, sources, accept=lambda p: p)
    assert {(r["source"], r["url"], r["depth"], r["place"]) for r in out.collect()} == want
    few = crawl_sources(pages, sources, accept=lambda p: p, most=2)
    assert max(r["place"] for r in few.collect()) == 2
    own = crawl_sources(pages, sources, mode="focused", accept=lambda p: p).where("source = 's2' and depth > 0")
    assert own.where("url not like 'http://b.org/%'").count() == 0 < own.count()
    assert crawl_sources(pages, sources.limit(0)).count() == 0 == crawl_sources(pages.limit(0), sources).count()


def test_links(spark):
    html = "<a href='/docs/x?y=1#z'>1</a><a class=k href=\"http://other/docs/\">2</a><a href='/docs/x'>3</a><a href='/no'>4</a>"
    pages = spark.createDataFrame([(1, "http://h/p/", html)], "page_id bigint, url string, html string")
    base = F.lit("http://h")
    broad = {r["dst"] for r in extract_links(pages, ("/docs/",), base).collect()}
    assert broad == {"http://h/docs/x", "http://other/docs/"}
    focused = {r["dst"] for r in extract_links(pages, ("/docs/",), base, same_host=True).collect()}
    assert focused == {"http://h/docs/x?y=1#z", "http://h/docs/x"}


def documents(spark, rows):
    return spark.createDataFrame(
        [(k, f"doc://{k}", k, text, v) for k, text, v in rows], DOCUMENT_SCHEMA
    )


def contents(store):
    return {r["chunk_id"]: r["content"] for r in store.open().chunks.collect()}


def test_store(spark, folder):
    store = IndexStore(spark, f"{folder}/ix", n_buckets=3, term_buckets=2)
    long = ". ".join(f"sentence number {i} about models" for i in range(120))
    docs = documents(spark, [("a", long, 1), ("b", "short text", 1), ("c", " ", 1), ("d", None, 1)])
    stats = run_ingest(docs, store, clear=True)
    n = len(contents(store))
    assert (stats.documents, stats.errors) == (2, 2) and stats.chunks_created == stats.chunks_stored == n > 2
    # a shorter version leaves no tail, and the same upsert again changes nothing
    for _ in range(2):
        run_ingest(documents(spark, [("a", "now short", 2)]), store)
        assert contents(store) == {"a:1": "now short", "b:1": "short text"}
    counts = {r["store"]: (r["n"], r["matches"]) for r in store_counts(store.open()).collect()}
    assert counts == {"chunks": (2, True), "text": (2, True), "vectors": (2, True)}
    assert store.open().stats.first()["n_chunks"] == 2
    assert {r["term"] for r in store.open().vocab.collect()} >= {"now", "short", "text"}
    assert not store.open().vocab.filter("term = 'models'").count()
    store.clear()
    assert contents(store) == {}


def test_a_write_leaves_no_dead_rows(spark, folder):
    store = IndexStore(spark, f"{folder}/ix", n_buckets=2, term_buckets=2)
    many = documents(spark, [(f"k{i}", f"text number {i}", 1) for i in range(8)]).withColumn("url", F.lit("one source"))
    run_ingest(many, store, clear=True)
    run_ingest(many.where("doc_key = 'k3'").withColumn("content", F.lit("!!!")), store)  # no words left in it
    got = contents(store)
    assert len(got) == 8 and got["k3:1"] == "!!!"
    assert not store.open().postings.where("chunk_id = 'k3:1' and term = 'number'").count()
    stats = run_ingest(documents(spark, [("k1", " ", 2), ("k2", None, 2)]), store)  # blank documents are removed
    assert (stats.documents, stats.chunks_created, stats.chunks_stored, stats.errors) == (0, 0, 6, 2)
    ix = store.open()
    assert {r["chunk_id"] for r in ix.embeddings.collect()} <= set(contents(store)) and ix.lengths.count() == 6
    assert not ix.vocab.where("term = '1'").count()
    run_ingest(documents(spark, [(f"k{i}", "...", 1) for i in range(8)]), store)
    left = "term in ('text', 'number')"
    assert store.open().postings.where(left).count() == store.open().vocab.where(left).count() == 0 and len(contents(store)) == 8
    before = contents(store)
    assert store.vacuum() > 0 and contents(store) == before and store.vacuum() == 0


def test_an_index_is_opened_as_it_was_made(spark, folder):
    IndexStore(spark, f"{folder}/ix", n_buckets=4, term_buckets=2).write(chunk_documents(documents(spark, [("a", "x y", 1)])))
    with pytest.raises(ValueError, match="buckets"):
        IndexStore(spark, f"{folder}/ix", n_buckets=64).open()


def test_an_unfinished_write_is_not_seen(spark, folder):
    store = IndexStore(spark, f"{folder}/ix", n_buckets=2, term_buckets=2)
    run_ingest(documents(spark, [("a", "old text", 1)]), store, clear=True)
    commit, IndexStore._commit = IndexStore._commit, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        with pytest.raises(RuntimeError):
            run_ingest(documents(spark, [("a", "half written", 2)]), store)
    finally:
        IndexStore._commit = commit
    assert contents(store) == {"a:1": "old text"} and store.open().postings.where("term = 'half'").count() == 0
    run_ingest(documents(spark, [("a", "new text", 2)]), store)
    assert contents(store) == {"a:1": "new text"} and store.open().postings.where("term in ('half', 'old')").count() == 0


def size_of(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def index_rows(store):
    ix = store.open()
    kinds = {"postings": ["term", "chunk_id", "tf", "n_tokens", "positions"], "lengths": ["chunk_id", "n_tokens"], "embeddings": ["chunk_id", "embedding"], "stats": ["n_chunks", "avgdl"]}
    return {n: sorted(map(repr, getattr(ix, n).select(*cols).collect())) for n, cols in kinds.items()} | {"chunks": contents(store)}


def test_delta_segments_equal_a_rebuild(spark, folder):
    """A batch writes what it brings; reads, before and after compaction, are those of
    an index built at once from what is left."""
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["models", "data", "train", "run", "the"]) + str(rng.randrange(40)) for _ in range(n))
    now = {f"k{i}": text(30) for i in range(300)}
    store = IndexStore(spark, f"{folder}/ix", n_buckets=4, term_buckets=2)
    run_ingest(documents(spark, [(k, t, 1) for k, t in now.items()]), store, clear=True)
    whole = size_of(f"{folder}/ix")
    for batch in range(3):
        before = size_of(f"{folder}/ix")
        news = {f"k{rng.randrange(310)}": text(20) if i % 3 else None for i in range(4)}
        run_ingest(documents(spark, [(k, t, 2 + batch) for k, t in news.items()]), store)
        assert size_of(f"{folder}/ix") - before < 0.4 * whole
        now = {k: t for k, t in (now | news).items() if t}
    built = IndexStore(spark, f"{folder}/new", n_buckets=4, term_buckets=2)
    run_ingest(documents(spark, [(k, t, 1) for k, t in now.items()]), built, clear=True)
    want = index_rows(built)
    assert index_rows(store) == want and len(store._manifest()["segments"]) == 4
    assert not store.compaction_due()
    q = spark.createDataFrame([(1, "mod"), (2, "data1 run"), (3, "the")], "query_id bigint, q string")
    best = lambda s: sorted((r["query_id"], r["chunk_id"], round(r["score"], 9)) for r in bm25_topk(q, s.open(), k=5).collect())
    assert best(store) == best(built)
    store.compact()
    assert index_rows(store) == want and len(store._manifest()["segments"]) == 1
    assert store.vacuum() > 0 and index_rows(store) == want
    run_ingest(documents(spark, [("k1", "older", 0)]).drop("version"), store)  # no version given: replaces
    assert contents(store)["k1:1"] == "older"


def test_keys_without_a_version_replace_and_keep_it(spark, folder):
    store = IndexStore(spark, f"{folder}/ix", n_buckets=2, term_buckets=2)
    put = lambda text, v: store.upsert(
        chunk_documents(documents(spark, [("a", text, 1)]).drop("version")),
        spark.createDataFrame([("a", v)], "doc_key string, version bigint"),
    )
    put("five", 5), put("new", None)
    assert contents(store) == {"a:1": "new"}
    put("four", 4)
    assert contents(store) == {"a:1": "new"}
    put("six", 6)
    assert contents(store) == {"a:1": "six"}


def test_the_second_of_two_writers_fails(spark, folder):
    store = IndexStore(spark, f"{folder}/ix", n_buckets=2, term_buckets=2)
    store.write(chunk_documents(documents(spark, [("a", "x y", 1)])))
    held, manifest = store._manifest(), IndexStore._manifest
    store.upsert(chunk_documents(documents(spark, [("b", "first", 1)])))
    IndexStore._manifest = lambda self: held  # what a job saw that began at the same time
    try:
        with pytest.raises(ConcurrentWrite):
            store.upsert(chunk_documents(documents(spark, [("c", "second", 1)])))
    finally:
        IndexStore._manifest = manifest
    assert contents(store) == {"a:1": "x y", "b:1": "first"}


def test_only_asked_buckets_and_promising_tiles_are_read(spark, folder):
    """Of the blocks, the buckets of the asked terms; of the postings, the tiles whose
    bound reaches the best ones."""
    rng = random.Random(5)
    rare = {i * 700 for i in range(12)}
    rows = [(f"k{i:04d}", "common " * (9 if i in rare else 1) + " ".join(f"w{rng.randrange(90)}" for _ in range(5 if i in rare else 25)), 1) for i in range(9000)]
    store = IndexStore(spark, f"{folder}/ix", n_buckets=2, term_buckets=16, stem=False)
    store.write(chunk_documents(documents(spark, rows)))
    ix = store.open()
    q = spark.createDataFrame([(1, "common")], "query_id bigint, q string")
    units = B.query_units(q)
    m = B.matching_tiles(q, ix)
    assert units.count() == 1 and len(m.buckets) == 1
    plan = B.asked_blocks(m.expanded, ix, m.buckets, "present")._jdf.queryExecution().toString()
    wanted = spark.createDataFrame([("common",)], "t string").select(bucket_of_term(F.col("t"), 16)).first()[0]
    scan = next(x for x in plan.split("FileScan") if "/blocks" in x)
    assert wanted == m.buckets[0] and f"= {wanted})" in scan.split("PartitionFilters")[1].split("]")[0]
    assert "positions" not in scan.split("ReadSchema")[1]
    seen = []
    score, B.score_tiles = B.score_tiles, lambda tiles, *a: (seen.append(tiles.agg(F.sum(F.bit_count("present"))).first()[0]), score(tiles, *a))[1]
    try:
        got = [r["chunk_id"] for r in bm25_topk(q, ix, k=5).orderBy("rank").collect()]
    finally:
        B.score_tiles = score
    assert set(got) <= {f"k{i:04d}:1" for i in rare} and len(got) == 5
    assert sum(seen) < 0.15 * 9000


def test_versions_decide_in_a_batch_and_over_batches(spark, folder):
    store = IndexStore(spark, f"{folder}/stream", n_buckets=2, term_buckets=2)
    parts = (
        [("a", "alpha five", 5), ("b", "beta", 1), ("c", "gamma", 1), ("c", " ", 2)],  # a newer blank beats an older text
        [("a", "alpha four", 4), ("b", None, 2)],  # an older version comes late; a text is withdrawn
        [("b", "beta one again", 1), ("c", "gamma three", 3)],
    )
    for part in parts:
        documents(spark, part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        incremental_ingest(spark, f"{folder}/in", store, f"{folder}/cp", quarantine=f"{folder}/bad").awaitTermination()
    assert contents(store) == {"a:1": "alpha five", "c:1": "gamma three"}
    assert sorted(r["doc_key"] for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/bad").collect()) == ["b", "c"]


def test_retrieval_with_neighbours(spark, folder):
    store = IndexStore(spark, f"{folder}/ix", n_buckets=2, term_buckets=2)
    text = "# Guide\n" + "\n".join(f"## Part {w}\nAll about {w} here." for w in ("ants", "bees", "crows", "ducks", "elks"))
    run_ingest(documents(spark, [("g", text, 1), ("z", "Nothing of note.", 1)]), store, clear=True)
    queries = spark.createDataFrame([(1, "crows", 1)], "query_id bigint, q string, top_k int")
    rows = hybrid_retrieve(queries, store.open()).orderBy("position").collect()
    assert [r["chunk_id"] for r in rows] == ["g:2", "g:3", "g:4", "g:5", "g:6"]
    assert [r["hit_rank"] for r in rows] == [None, None, 1, None, None]
    walk = hybrid_retrieve(queries, store.open(), exact_walk=True).orderBy("position").collect()
    assert [r["chunk_id"] for r in walk] == ["g:3", "g:2", "g:4", "g:5", "g:6"]
    bare = hybrid_retrieve(queries, store.open(), expand=False).collect()
    assert [(r["chunk_id"], r["heading_path"]) for r in bare] == [("g:4", "Guide > Part crows")]


def test_every_question_has_a_row(spark, folder):
    store = IndexStore(spark, f"{folder}/ix", n_buckets=2, term_buckets=2, embed=lambda rows, c: embed_hash(rows.withColumn("t", F.lit("")), "t", 8).drop("t"))
    run_ingest(documents(spark, [("g", "# Guide\nAll about ants here.", 1)]), store, clear=True)
    rows = [(1, "ants", 1, True), (2, "  ", 1, True), (3, "ants", 21, True), (4, "bees", 5, True), (5, "ants", None, True), (6, "ants", 2, False)]
    asked = spark.createDataFrame(rows, "query_id bigint, q string, top_k int, include_sources boolean")
    got = {r["query_id"]: r for r in prompts(asked, store.open(), "{user_question}? {context_chunks}").collect()}
    assert {i: r["status"] for i, r in got.items()} == {
        1: "ok", 2: "empty query", 3: "top_k out of range", 4: "no result", 5: "top_k out of range", 6: "ok"
    }
    assert got[1]["prompt"].startswith("ants? \n--- Chunk ID: g:1") and got[2]["prompt"] is None
    assert [(len(got[i]["sources"]), got[i]["chunks_retrieved"]) for i in (1, 2, 4, 6)] == [(1, 1), (0, 0), (0, 0), (0, 1)]
    assert prompts(asked.limit(0), store.open(), "x").count() == 0


def test_pages_into_the_index(spark, folder):
    pages = spark.createDataFrame(
        [(1, "http://H/a/?x=1", "<article><h1>A</h1><p>one two</p></article>"), (2, "http://h/b", "<p>b</p>")],
        "page_id bigint, url string, html string",
    )
    seeds = spark.createDataFrame([("http://h/a#top",)], "url string")
    assert [r["page_id"] for r in seed_select(pages, seeds).collect()] == [1]
    store = IndexStore(spark, f"{folder}/ix", n_buckets=2, term_buckets=2)
    assert ingest_pages(pages, store, seeds).documents == 1
    assert contents(store) == {"1:1": "# A\n\none two"}
    assert clean_pages(pages, "broad").count() == 0


def test_quarantine(spark):
    df = spark.createDataFrame([("a", "x"), ("b", " \n"), ("c", None)], "doc_key string, content string")
    ok, bad = split_ok_quarantine(df, "clean", "doc_key", "content")
    assert [r["doc_key"] for r in ok.collect()] == ["a"]
    assert {(r["doc_key"], r["stage"], r["error"]) for r in bad.collect()} == {("b", "clean", "empty"), ("c", "clean", "missing")}


def test_incremental_equals_batch(spark, folder):
    store = IndexStore(spark, f"{folder}/stream", n_buckets=2, term_buckets=2)
    first = [("a", "alpha one", 1), ("b", "beta one", 1)]
    second = [("a", "alpha two", 2), ("a", "alpha old", 1), ("c", "gamma", 1)]
    for part in (first, second):
        documents(spark, part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        incremental_ingest(spark, f"{folder}/in", store, f"{folder}/cp").awaitTermination()
    want = {"a:1": "alpha two", "b:1": "beta one", "c:1": "gamma"}
    assert contents(store) == want
    batch = IndexStore(spark, f"{folder}/batch", n_buckets=2, term_buckets=2)
    run_ingest(documents(spark, [("a", "alpha two", 2), ("b", "beta one", 1), ("c", "gamma", 1)]), batch, clear=True)
    assert contents(batch) == want


def test_embedding_slot(spark):
    def broken():
        def encode(texts):
            if "bad" in texts:
                raise ValueError("no")
            return [[1.0, float(len(t))] for t in texts]

        return encode

    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "fine")], "id int, t string").coalesce(1)
    got = {r["id"]: (r["embedding"], r["embed_ok"]) for r in embed_udf(df, "t", broken, 2, batch_size=1).collect()}
    assert got == {1: ([1.0, 2.0], True), 2: ([0.0, 0.0], False), 3: ([1.0, 4.0], True)}


def test_a_model_serves_the_index_and_the_questions(spark, folder):
    def letters():
        return lambda texts: [[float(t.count(c)) for c in "abcdefgh"] for t in texts]

    model = lambda rows, column: embed_udf(rows, column, letters, 8)
    store = IndexStore(spark, f"{folder}/ix", n_buckets=2, term_buckets=2, embed=model)
    texts = ["aaaa zz", "bbbb zz", "bbbb zz", "hhhh zz"]
    run_ingest(documents(spark, [(f"k{i}", t, 1) for i, t in enumerate(texts)]), store, clear=True)
    assert {len(r["embedding"]) for r in store.open().embeddings.collect()} == {8}
    queries = spark.createDataFrame([(1, "hhhhhhhhhhhhhhhh", 1)], "query_id bigint, q string, top_k int")
    rows = hybrid_retrieve(queries, store.open(), expand=False).collect()
    assert [r["chunk_id"] for r in rows] == ["k3:1"]  # no word in common: found by vector
    store.upsert(chunk_documents(documents(spark, [("k0", "hhhhhhhhhhhh", 2)])))
    assert [r["chunk_id"] for r in hybrid_retrieve(queries, store.open(), expand=False).collect()] == ["k0:1"]


def test_equal_texts_are_encoded_once(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(30)], "id int, t string")
    seen = []

    def embed(reps):
        seen.append(reps.count())
        return embed_hash(reps, "t", 8)

    assert embed_dedup(df, "t", embed).count() == 30 and seen == [11]
    plain = {r["id"]: r["embedding"] for r in embed_hash(df, "t", 8).collect()}
    for hot in (100, 3):
        got = embed_dedup(df, "t", embed, hot).collect()
        assert len(got) == 30 and {r["id"]: r["embedding"] for r in got} == plain
    assert not embed_hash(spark.createDataFrame([(" ",), (None,)], "t string"), "t", 8).filter("embed_ok").count()


def test_mean_pool(spark):
    df = spark.createDataFrame([("a", [1.0, 3.0]), ("a", [3.0, 5.0]), ("b", [7.0, 0.0])], "k string, v array<float>")
    assert {r["k"]: r["v"] for r in mean_pool(df, "k", "v").collect()} == {"a": [2.0, 4.0], "b": [7.0, 0.0]}


def test_a_full_bucket_is_cut_into_tasks(spark, folder):
    """One bucket, and a word that all chunks have: no task gets the whole of either."""
    text = F.concat(F.lit("common "), F.sha2(F.col("id").cast("string"), 256), F.lit(" "), F.sha2((-F.col("id")).cast("string"), 256))
    rows = spark.range(0, 3000, 1, 6).select(
        F.concat(F.lit("k"), "id").alias("doc_key"), F.lit("u").alias("url"), F.lit("t").alias("title"), text.alias("content")
    )
    store = IndexStore(spark, f"{folder}/ix", n_buckets=1, term_buckets=1)
    sizes = [f"spark.sql.adaptive.{x}" for x in ("advisoryPartitionSizeInBytes", "coalescePartitions.minPartitionSize")]
    for name in sizes:
        spark.conf.set(name, "16k")
    try:
        store.write(chunk_documents(rows))
    finally:
        for name in sizes:
            spark.conf.unset(name)
    segment = f"{folder}/ix/segments/{os.listdir(f'{folder}/ix/segments')[0]}"
    files = lambda path: sum(x.endswith(".parquet") for x in os.listdir(f"{segment}/{path}"))
    assert (files("chunks/bucket=0") > 1, files("blocks/term_bucket=0") > 1) == (True, True)
    common = store.open().postings.where("term = 'common'")
    assert common.count() == common.select("chunk_id").distinct().count() == store.open().chunks.count() == 3000


def test_postings_are_grouped_by_as_many_tasks_as_they_need(spark, monkeypatch):
    rows = spark.range(200).select(F.col("id").cast("string").alias("chunk_id"), F.concat(F.lit("same word "), "id").alias("content"))
    rows = PO.with_place(rows.coalesce(1)).withColumns({"title": F.lit(None).cast("string"), "heading_path": F.lit("")})
    terms = PO.chunk_terms(rows, keep=("tile", "slot"))
    assert PO.block_parts(terms) is None
    monkeypatch.setattr(PO, "TOKENS_PER_TASK", 50)
    assert PO.block_parts(terms) == 12  # 600 tokens
    cut = PO.term_blocks(terms, 12)
    assert cut.rdd.getNumPartitions() == 12
    assert sorted(map(str, cut.collect())) == sorted(map(str, PO.term_blocks(terms).collect()))
