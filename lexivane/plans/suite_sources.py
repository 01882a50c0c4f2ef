"""Registered queries: sources, sinks, statistics and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexivane.functions.text import word_count
from lexivane.operators import pages as P
from lexivane.operators import stats as S
from lexivane.operators.chunking import chunk_documents
from lexivane.operators.context import fetch_chunks
from lexivane.operators.ratelimit import rate_limit, window_count
from lexivane.plans import inputs
from lexivane.plans.catalog import CHUNKS, TERMS, UNITS, q_strip, q_words, query
from lexivane.plans.ingest import run_ingest
from lexivane.session import scratch_path
from lexivane.sources import files as FS
from lexivane.sources.index_store import IndexStore, upsert_chunks
from lexivane.sources.tables import scan_pages, spread, table
from lexivane.streaming.incremental import incremental_ingest

# A file tree laid over the documents: folder, name and extension by id.
_FOLDERS = ("docs", "docs/examples", "docs/tests", "pytorch-docs", "pytorch-docs/cpp", "ray/serve", "site/tutorials", "site/build")
_NAMES = ("data", "nn", "my-deployment-guide", "models", "intro_page", "getting-started", "setup")
_EXTS = (".rst", ".md", ".mdx", ".py")


def _pick(options, step: int):
    at = F.floor(F.col("doc_id") / step) % len(options)
    return F.element_at(F.array(*[F.lit(o) for o in options]), (at + 1).cast("int"))


def tree(spark, sf):
    d = spread(table(spark, sf, "documents"))
    path = F.concat(
        _pick(_FOLDERS, 1), F.lit("/"), F.col("doc_id"), F.lit("/"), _pick(_NAMES, 1), _pick(_EXTS, 8)
    )
    return d.select(path.alias("path"), F.octet_length("text").cast("bigint").alias("length"), F.col("text"))


def _q_pick(options, step: int) -> str:
    return "[" + ", ".join(f"'{o}'" for o in options) + f"][doc_id // {step} % {len(options)} + 1]"


TREE = f"""tree as (
  select {_q_pick(_FOLDERS, 1)} || '/' || doc_id || '/' || {_q_pick(_NAMES, 1)} || {_q_pick(_EXTS, 8)} as path,
    octet_length(encode(text)) as length, text from documents)"""


@query(
    "scan_docs",
    """select lang, source, cast(sum(octet_length(encode(text)) + 1) as bigint) as length, cast(sum(length(text) + 1) as bigint) as n_chars
    from documents where text is not null and lang is not null and source is not null group by lang, source""",
)
def scan_docs(spark, sf):
    """Documents put into text files below folders of language and source, and found
    again with what they hold; files of other kinds among them are not."""
    root = scratch_path(spark, "tree")
    d = table(spark, sf, "documents").where("text is not null and lang is not null and source is not null")
    d.select("lang", "source", F.col("text").alias("value")).write.partitionBy("lang", "source").text(f"{root}/docs")
    d.select("doc_id").write.parquet(f"{root}/docs/lang=other/source=parquet")
    found = FS.decode_text(FS.scan_docs(spark, root, exts=(".txt",)))
    folder = lambda name: F.regexp_extract("path", f"/{name}=([^/]*)/", 1).alias(name)
    return found.groupBy(folder("lang"), folder("source")).agg(
        F.sum("length").alias("length"), F.sum(F.length("text").cast("bigint")).alias("n_chars")
    )


@query("decode_text", "select doc_id, 'x' || text || 'y' as text from documents")
def decode_text(spark, sf):
    """Texts with bytes put in that are not UTF-8; those and no others go."""
    d = spread(table(spark, sf, "documents"))
    bad = F.unhex(F.lit("FF"))
    cut = F.unhex(F.lit("C3"))
    raw = F.concat(F.encode(F.lit("x"), "UTF-8"), bad, F.encode("text", "UTF-8"), cut, F.encode(F.lit("y"), "UTF-8"))
    return FS.decode_text(d.select("doc_id", raw.alias("content"))).select("doc_id", "text")


@query(
    "filter_corpus_files",
    f"""with {TREE} select distinct path, length from tree where length <= 2048
    and not regexp_matches(path, '/(examples|test|tests|__pycache__|node_modules|build|dist|[.]git)/')
    and regexp_extract(path, '[^/]*$') not in ('Makefile', 'requirements.txt', 'setup.py', 'conf.py')""",
)
def filter_corpus_files(spark, sf):
    return FS.filter_corpus_files(tree(spark, sf), max_bytes=2048).select("path", "length")


@query(
    "filter_api_files",
    f"""with {TREE} select distinct path, length from tree where length <= 2048
    and starts_with(path, 'pytorch-docs/') and (suffix(path, '.rst') or suffix(path, '.md'))
    and not regexp_matches(path, '/cpp/|/libtorch|/cuda|/cpu|/cudnn')""",
)
def filter_api_files(spark, sf):
    return FS.filter_api_files(tree(spark, sf), max_bytes=2048).select("path", "length")


@query(
    "select_focused_files",
    f"""with {TREE} select distinct path from tree
    where regexp_matches(path, '(^|/)(data|nn|distributed|ddp)[.]rst$')
       or regexp_matches(path, '(^|/)tutorials/(.*/)?[^/]*(data|distributed)[^/]*[.]rst$')
       or regexp_matches(path, '(^|/)(tracking|model-registry|models|getting-started)[^/]*[.]mdx$')
       or regexp_matches(path, '(^|/)serve/(.*/)?[^/]*(getting-started|key-concepts|production|deployment)[^/]*[.]rst$')""",
)
def select_focused_files(spark, sf):
    return FS.select_focused_files(tree(spark, sf)).select("path")


@query(
    "seed_select",
    r"""with n as (
      select *, rtrim(regexp_extract(regexp_extract(url, '^[^?#]*'), '^([^:]+://)', 1)
        || lower(regexp_extract(url, '://([^/?#]*)', 1))
        || regexp_extract(regexp_extract(url, '^[^?#]*'), '://[^/]*(.*)$', 1), '/') as nurl from pages)
    select page_id, url from n where nurl in (
      select nurl from n where regexp_matches(url, '^https')) """,
)
def seed_select(spark, sf):
    """Seeds: the addresses with https, with a fragment put on."""
    p = inputs.pages(spark, sf)
    seeds = p.filter(F.col("url").startswith("https")).select(
        F.concat(F.substring_index("url", "#", 1), F.lit("#seed")).alias("url")
    )
    return P.seed_select(p, seeds).select("page_id", "url")


@query("scan_pages", "select page_id, url, html from pages")
def pages_scan(spark, sf):
    return scan_pages(spark, f"{sf}/pages.parquet")


@query(
    "drop_failed",
    f"""with t as (select *, case when length(text) % 5 = 0 then '  ' else text end as body from documents)
    select cast(doc_id as varchar) as doc_key, case when {q_strip('body')} = '' then 'empty' else 'ok' end as outcome from t""",
)
def drop_failed(spark, sf):
    """Documents whose length is a multiple of five are blanked first."""
    d = spread(table(spark, sf, "documents")).select(
        F.col("doc_id").cast("string").alias("doc_key"),
        F.when(F.length("text") % 5 == 0, "  ").otherwise(F.col("text")).alias("content"),
    )
    ok, bad = P.split_ok_quarantine(d, "clean", "doc_key", "content")
    return ok.select("doc_key", F.lit("ok").alias("outcome")).unionByName(
        bad.select("doc_key", F.col("error").alias("outcome"))
    )


# ---- sinks ---------------------------------------------------------------


def _versions(spark, sf):
    """Stored: all documents. Incoming: newer ones of those in English."""
    d = table(spark, sf, "documents").select(
        F.concat(F.lit("doc://"), F.col("doc_id")).alias("source_url"), "lang", F.col("text").alias("content")
    )
    return d, d.filter("lang = 'en'").withColumn(
        "content", F.concat(F.lit("newer: "), "content")
    )


@query(
    "upsert_chunks",
    """select 'doc://' || doc_id as source_url, lang,
    case when lang = 'en' then 'newer: ' || text else text end as content from documents""",
)
def upsert(spark, sf):
    existing, incoming = _versions(spark, sf)
    return upsert_chunks(existing, incoming)


@query(
    "upsert_index",
    """select doc_id || ':1' as chunk_id, case lang when 'en' then 'newer' else text end as content
    from documents where lang <> 'de'""",
)
def upsert_index(spark, sf):
    """A stored index of whole documents: the English ones get a newer text, the German
    ones lose theirs, and an older version of the French ones comes too late."""
    store = IndexStore(spark, scratch_path(spark, "upsert"), n_buckets=4, term_buckets=4)
    langs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_key"), "lang")
    whole = inputs.whole_documents(spark, sf).withColumn("chunk_id", F.concat("doc_key", F.lit(":1")))
    whole = whole.withColumn("source_url", F.col("anchor_link"))
    version = F.when(F.col("lang") == "fr", 1).otherwise(3)
    store.write(whole, langs.select("doc_key", F.lit(2).alias("version")))
    changed = langs.where("lang in ('en', 'de', 'fr')").select("doc_key", version.alias("version"))
    new = whole.join(langs.where("lang in ('en', 'fr')"), "doc_key", "left_semi")
    store.upsert(new.withColumn("content", F.lit("newer")), changed)
    return store.open().chunks.select("chunk_id", "content")


@query(
    "clear_index",
    f"""with {CHUNKS}, c as (select count(*) as before from chunks)
    select store, before, 0::bigint as n from c, (values ('chunks'), ('text'), ('vectors')) t(store)""",
)
def clear_index(spark, sf):
    """Rows of each table before and after the index is emptied."""
    store = IndexStore(spark, scratch_path(spark, "clear"), n_buckets=4, term_buckets=4)
    store.write(chunk_documents(inputs.docs(spark, sf)))
    before = S.store_counts(store.open()).select("store", F.col("n").alias("before"))
    store.clear()
    return before.join(S.store_counts(store.open()).select("store", "n"), "store")


@query(
    "write_index",
    f"with {UNITS}, {TERMS} select term, chunk_id, tf, n_tokens from post join lens using (chunk_id)",
)
def write_index(spark, sf):
    return inputs.index(spark, sf, "documents").postings.select(
        "term", "chunk_id", F.col("tf").cast("bigint").alias("tf"), F.col("n_tokens").cast("bigint").alias("n_tokens")
    )


@query(
    "fetch_chunk",
    f"""with {CHUNKS}, wanted as (select doc_key || ':2' as chunk_id from docs)
    select w.chunk_id, c.content, c.title, c.chunk_id is not null as found, 0.0::double as score
    from wanted w left join chunks c using (chunk_id)""",
)
def fetch_chunk(spark, sf):
    """The second chunk of every document, which not all have."""
    ids = inputs.docs(spark, sf).select(F.concat("doc_key", F.lit(":2")).alias("chunk_id"))
    ix = inputs.index(spark, sf, "chunks")
    return fetch_chunks(ids, ix.chunks, ix.n_buckets).select("chunk_id", "content", "title", "found", "score")


# ---- statistics ----------------------------------------------------------


@query(
    "store_counts",
    f"""with {CHUNKS}, c as (select count(*) as n from chunks)
    select store, n, true as matches from c, (values ('chunks'), ('text'), ('vectors')) t(store)""",
)
def store_counts(spark, sf):
    return S.store_counts(inputs.index(spark, sf, "chunks"))


@query(
    "source_distribution",
    f"with {CHUNKS} select source_url, count(*) as chunk_count from chunks group by source_url",
)
def source_distribution(spark, sf):
    return S.source_distribution(inputs.index(spark, sf, "chunks").chunks)


@query(
    "chunks_per_source",
    f"""with {CHUNKS} select d.source, count(*) as n from chunks c join docs d using (doc_key)
    group by d.source""",
)
def chunks_per_source(spark, sf):
    of = inputs.docs(spark, sf).select("doc_key", "source")
    chunks = chunk_documents(inputs.docs(spark, sf)).groupBy("doc_key").agg(F.count(F.lit(1)).alias("k"))
    joined = chunks.join(of, "doc_key").groupBy("source").agg(F.sum("k").alias("n"))
    return joined.orderBy("source")


@query("docs_per_source", "select source, count(*) as n from documents group by source")
def docs_per_source(spark, sf):
    return S.count_by(table(spark, sf, "documents"), "source", order="value")


@query(
    "ingest_stats",
    f"""with {CHUNKS} select (select count(*) from docs where {q_strip('content')} <> '') as documents,
    (select count(*) from chunks) as chunks_created, (select count(*) from chunks) as chunks_stored,
    (select count(*) from docs where {q_strip('content')} = '') as errors""",
)
def ingest_stats(spark, sf):
    store = IndexStore(spark, scratch_path(spark, "ingest"), n_buckets=4, term_buckets=4)
    stats = run_ingest(inputs.docs(spark, sf), store, clear=True)
    return spark.createDataFrame(
        [(stats.documents, stats.chunks_created, stats.chunks_stored, stats.errors)],
        "documents bigint, chunks_created bigint, chunks_stored bigint, errors bigint",
    )


@query(
    "capacity_estimate",
    f"""with {CHUNKS}, w as (select cast(sum(len({q_words('content')})) as bigint) as total_words from docs),
    c as (select count(*) as n_chunks from chunks)
    select total_words, n_chunks, total_words // 200 as est_chunks_by_words, total_words // 250 as est_chunks_by_size,
      round(n_chunks * 3072 / 1048576.0, 6) as storage_mb, round(n_chunks * 3072 / 1048576.0 / 1024 * 100, 6) as tier_percent,
      n_chunks * 3072 / 1048576.0 / 1024 > 0.8 as warn_80, n_chunks * 3072 / 1048576.0 / 1024 > 0.9 as warn_90,
      n_chunks > 300000 or total_words // 250 > 300000 as warn_chunks from w, c""",
)
def capacity_estimate(spark, sf):
    d = inputs.docs(spark, sf)
    est = S.capacity_estimate(d.withColumn("word_count", word_count(F.col("content"))), chunk_documents(d))
    return est.withColumn("storage_mb", F.round("storage_mb", 6)).withColumn(
        "tier_percent", F.round("tier_percent", 6)
    )


# ---- requests and streams ------------------------------------------------

_LIMIT, _WINDOW = 2, 12 * 3600


@query(
    "rate_limit_admission",
    f"""with recursive e as (
      select event_id, user_id, epoch_us(ts) as us,
        row_number() over (partition by user_id order by ts, event_id) as rn from events),
    run as (
      select event_id, user_id, rn, true as admitted, [us] as held from e where rn = 1
      union all
      select e.event_id, e.user_id, e.rn,
        len(list_filter(r.held, lambda h: h > e.us - {_WINDOW}000000)) < {_LIMIT},
        case when len(list_filter(r.held, lambda h: h > e.us - {_WINDOW}000000)) < {_LIMIT}
          then list_append(list_filter(r.held, lambda h: h > e.us - {_WINDOW}000000), e.us)
          else list_filter(r.held, lambda h: h > e.us - {_WINDOW}000000) end
      from run r join e on e.user_id = r.user_id and e.rn = r.rn + 1)
    select event_id, user_id, admitted from run""",
)
def rate_limit_admission(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return rate_limit(events, "user_id", "ts", "event_id", _LIMIT, _WINDOW).select("event_id", "user_id", "admitted")


@query(
    "request_window_count",
    f"""select event_id, user_id, count(*) over (partition by user_id order by epoch_us(ts)
      range between {_WINDOW}000000 - 1 preceding and current row) as n_recent from events""",
)
def request_window_count(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return window_count(events, "user_id", "ts", _WINDOW).select("event_id", "user_id", "n_recent")


@query(
    "incremental_ingest",
    f"""with {CHUNKS} select chunk_id, content, prev_id, next_id from chunks
    where cast(doc_key as bigint) % 5 <> 0""",
)
def incremental(spark, sf):
    """The documents arrive as files; the stream indexes them and ends. A second batch
    brings a newer blank for a fifth of them and an older text for another fifth."""
    inbox, progress = scratch_path(spark, "inbox"), scratch_path(spark, "progress")
    store = IndexStore(spark, scratch_path(spark, "stream"), n_buckets=4, term_buckets=4)
    rows = inputs.docs(spark, sf).select("doc_key", "url", "title", "content", F.lit(5).cast("bigint").alias("version"))
    part = F.col("doc_key").cast("bigint") % 5
    late = rows.where(part < 2).withColumns(
        {"content": F.when(part == 1, "an older text"), "version": F.when(part == 0, 6).otherwise(4).cast("bigint")}
    )
    for batch in (rows, late):
        batch.write.mode("append").parquet(inbox)
        incremental_ingest(spark, inbox, store, progress, max_files=1000).awaitTermination()
    return store.open().chunks.select("chunk_id", "content", "prev_id", "next_id")
