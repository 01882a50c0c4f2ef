"""Registered queries: chunking and embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lexivane.functions import text as X
from lexivane.functions import vectors as V
from lexivane.functions.terms import tokens
from lexivane.operators import chunking as C
from lexivane.operators import embedding as E
from lexivane.plans import inputs
from lexivane.plans.catalog import (
    CHUNKS,
    q_hash_vectors,
    q_sentences,
    q_strip,
    q_tokens,
    query,
)
from lexivane.sources.tables import spread, table

TURNS = """docs as (
  select conv_id || '-' || turn as doc_key, 'conv://' || conv_id || '-' || turn as url,
    '# Conversation ' || conv_id || chr(10) || chr(10) || '## ' || role || ' ' || turn || chr(10) || text as content
  from conversations)"""

SECTIONS = rf"""lines as (
  select doc_key, url, i as pos, ls[i] as line,
    regexp_matches(ls[i], '^#{{1,6}}\s+.') as is_head
  from (select doc_key, url, string_split(content, chr(10)) as ls from docs), unnest(range(1, len(ls) + 1)) r(i)
  where true),
numbered as (
  select *, sum(cast(is_head as integer)) over (partition by doc_key order by pos) as sec from lines),
bodies as (
  select doc_key, any_value(url) as url, sec, {q_strip("string_agg(line, chr(10) order by pos)")} as content,
    {q_strip(r"regexp_replace(min(line) filter (where is_head), '^#+\s+', '')")} as heading,
    length(regexp_extract(min(line) filter (where is_head), '^#+')) as level
  from numbered group by doc_key, sec),
kept as (
  select *, row_number() over (partition by doc_key order by sec) as section_seq,
    last_value(case when level = 1 then heading end ignore nulls) over (partition by doc_key order by sec) as h1
  from bodies where content <> ''),
sections as (
  select doc_key, url, section_seq, content, coalesce(heading, '') as heading,
    case when level is null then 'Introduction' when level = 1 then heading else h1 || ' > ' || heading end as heading_path,
    case when heading is null then '' else '#' || trim(regexp_replace(regexp_replace(lower(heading), '[^a-zA-Z0-9\s-]', '', 'g'), '[\s-]+', '-', 'g'), '-') end as anchor
  from kept)"""


@query(
    "split_sections",
    f"with {TURNS}, {SECTIONS} select doc_key, section_seq, anchor, content from sections",
)
def split_sections(spark, sf):
    return C.split_sections(inputs.turns(spark, sf)).select(
        "doc_key", F.col("section_seq").cast("bigint").alias("section_seq"), "anchor", "content"
    )


@query(
    "heading_path",
    f"with {TURNS}, {SECTIONS} select doc_key, section_seq, heading_path from sections",
)
def heading_path(spark, sf):
    return C.split_sections(inputs.turns(spark, sf)).select(
        "doc_key", F.col("section_seq").cast("bigint").alias("section_seq"), "heading_path"
    )


@query(
    "anchor_link",
    f"""with {TURNS}, {SECTIONS} select doc_key, section_seq,
    case when anchor = '' then url else url || anchor end as anchor_link from sections""",
)
def anchor_link(spark, sf):
    rows = C.split_sections(inputs.turns(spark, sf))
    return rows.select(
        "doc_key",
        F.col("section_seq").cast("bigint").alias("section_seq"),
        X.anchor_link(F.col("url"), F.col("anchor")).alias("anchor_link"),
    )


@query("token_estimate", "select doc_id, cast(length(text) // 4 as integer) as tokens from documents")
def token_estimate(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query(
    "split_sentences",
    f"""with s as (select doc_id, {q_sentences('text')} as ss from documents)
    select doc_id, cast(i as integer) as pos, ss[i] as sentence from s, unnest(range(1, len(ss) + 1)) r(i)""",
)
def split_sentences(spark, sf):
    d = spread(table(spark, sf, "documents"))
    return X.unnest(d, C.sentences(F.col("text")), "doc_id").select("doc_id", "pos", F.col("item").alias("sentence"))


@query("pack_chunks", f"with {CHUNKS} select doc_key, chunk_seq, content, token_count from chunks")
def pack_chunks(spark, sf):
    """Every document as one section."""
    d = inputs.docs(spark, sf).select("doc_key", "content")
    return C.pack_chunks(d).select("doc_key", "chunk_seq", "content", "token_count")


@query(
    "overlap_suffix",
    f"""with s as (select doc_id, list_transform({q_sentences('text')}, lambda x: length(x) // 4) as tk from documents),
    j as (select doc_id, tk, i, list_sum(tk[i:len(tk)]) as total from s, unnest(range(1, len(tk) + 1)) r(i))
    select s.doc_id, cast(count(j.i) as integer) as n, cast(coalesce(max(j.total), 0) as integer) as tokens
    from s left join j on s.doc_id = j.doc_id and j.total <= 50 group by s.doc_id""",
)
def overlap_suffix(spark, sf):
    """The overlap that a chunk made of the whole document would pass on."""
    d = spread(table(spark, sf, "documents"))
    tk = F.transform(C.sentences(F.col("text")), X.token_estimate)
    suffix = X.let(tk, lambda t: C.overlap_suffix(t, F.lit(1), F.size(t), 50))
    return d.select("doc_id", suffix.alias("o")).select("doc_id", "o.n", "o.tokens")


@query("link_chunks", f"with {CHUNKS} select chunk_id, prev_id, next_id from chunks")
def link_chunks(spark, sf):
    return C.chunk_documents(inputs.docs(spark, sf)).select("chunk_id", "prev_id", "next_id")


@query(
    "chunk_documents",
    f"""with {CHUNKS} select chunk_id, source_url, title, heading_path, anchor_link, section_seq,
    chunk_seq, content, token_count, prev_id, next_id from chunks""",
)
def chunk_documents(spark, sf):
    return C.chunk_documents(inputs.docs(spark, sf)).drop("doc_key")


# ---- embeddings ----------------------------------------------------------


def _dims(df, key):
    """Vectors as rows: key, d, x."""
    return X.unnest(df, F.col("embedding"), key, start=0).select(
        key, F.col("pos").alias("d"), F.round(F.col("item").cast("double") + 0.0, 6).alias("x")
    )


def q_dense(name: str, key: str, rows: str) -> str:
    return f"""select r.{key}, cast(g.d as integer) as d, round(coalesce(v.x, 0), 6) as x
    from (select {key} from {rows}) r cross join range(0, 64) g(d)
    left join {name} v on v.{key} = r.{key} and v.d = g.d"""


@query(
    "embed_hash",
    f"with {q_hash_vectors('v', 'documents', 'doc_id', 'text')} {q_dense('v', 'doc_id', 'documents')}",
)
def embed_hash(spark, sf):
    d = spread(table(spark, sf, "documents"))
    return _dims(E.embed_hash(d.select("doc_id", "text"), "text"), "doc_id")


def letter_model():
    """Stand-in for a model: shares of the letters a to h."""

    def encode(texts):
        counts = np.array([[t.count(c) for c in "abcdefgh"] for t in texts], dtype=np.float64)
        return counts / np.maximum(counts.sum(axis=1), 1)[:, None]

    return encode


_SHARES = ", ".join(f"length(text) - length(replace(text, '{c}', ''))" for c in "abcdefgh")


@query(
    "embed_udf",
    f"""with c as (select doc_id, [{_SHARES}] as n from documents)
    select doc_id, cast(i - 1 as integer) as d, round(cast(n[i]::double / greatest(list_sum(n), 1) as float)::double, 4) as x
    from c, range(1, 9) r(i)""",
)
def embed_udf(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    out = E.embed_udf(d, "text", letter_model, 8)
    return X.unnest(out, F.col("embedding"), "doc_id", start=0).select(
        "doc_id", F.col("pos").alias("d"), F.round(F.col("item").cast("double"), 4).alias("x")
    )


@query(
    "mean_pool",
    """select label, cast(i - 1 as integer) as d, round(avg(embedding[i]::double), 6) as x
    from embeddings, range(1, 65) r(i) group by label, i""",
)
def mean_pool(spark, sf):
    return _dims(E.mean_pool(table(spark, sf, "embeddings"), "label", "embedding"), "label")


@query(
    "l2_normalize",
    """with v as (select vec_id, list_transform(embedding, lambda x: x::double * 3 + 0.5) as v from embeddings),
    n as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as l from v)
    select vec_id, cast(i - 1 as integer) as d, round(v[i] / l, 6) as x from n, range(1, 65) r(i)""",
)
def l2_normalize(spark, sf):
    """The stored vectors have unit length, so they are moved and stretched first."""
    moved = F.transform("embedding", lambda x: x.cast("double") * 3 + 0.5)
    v = table(spark, sf, "embeddings").select("vec_id", V.l2_normalize(moved).alias("embedding"))
    return _dims(v, "vec_id")


@query(
    "truncate_tokens",
    f"""with t as (select doc_id, {q_tokens('text', fold=False)} as ts from documents)
    select doc_id, cast(len(ts[1:512]) as integer) as n, array_to_string(ts[1:512], ' ') as kept from t""",
)
def truncate_tokens(spark, sf):
    d = spread(table(spark, sf, "documents"))
    kept = V.truncate_tokens(tokens(F.col("text"), fold=False))
    return d.select("doc_id", kept.alias("k")).select("doc_id", F.size("k").alias("n"), F.array_join("k", " ").alias("kept"))


@query(
    "zero_fallback",
    """select vec_id, round(case when label = 0 then 0 else list_sum(list_transform(embedding, lambda x: x::double * x)) end, 4) as sq,
    label <> 0 as embed_ok from embeddings""",
)
def zero_fallback(spark, sf):
    """Vectors of label 0 count as failed."""
    failed = F.when(F.col("label") != 0, F.transform("embedding", lambda x: x.cast("double")))
    v = table(spark, sf, "embeddings").select("vec_id", V.zero_fallback(failed, 64).alias("v"))
    return v.select("vec_id", F.round(V.dot(F.col("v"), F.col("v")), 4).alias("sq"), (V.norm(F.col("v")) > 0).alias("embed_ok"))


@query(
    "embed_dedup",
    f"with {CHUNKS}, {q_hash_vectors('v', 'chunks', 'chunk_id', 'content')} {q_dense('v', 'chunk_id', 'chunks')}",
)
def embed_dedup(spark, sf):
    """Chunks, of which equal ones are embedded once."""
    d = C.chunk_documents(inputs.docs(spark, sf)).select("chunk_id", "content")
    return _dims(E.embed_dedup(d, "content", lambda df: E.embed_hash(df, "content")), "chunk_id")


@query(
    "task_prefix",
    "select item_id, 'search_query: ' || text as as_query, 'search_document: ' || text as as_document from benchmark",
)
def task_prefix(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select(
        "item_id",
        E.task_prefix(F.col("text"), "query").alias("as_query"),
        E.task_prefix(F.col("text"), "document").alias("as_document"),
    )
