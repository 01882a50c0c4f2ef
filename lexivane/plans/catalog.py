"""Register of queries and of the SQL that checks them."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from lexivane.functions.terms import FOLD_FROM, FOLD_TO
from lexivane.functions.text import SPACES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``f(spark, sf_dir)`` and, if there is one, its check."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# ---- SQL fragments (DuckDB) ---------------------------------------------


def q_strip(x: str) -> str:
    return f"trim({x}, '{SPACES}')"


def q_lines(x: str) -> str:
    """Stripped lines of a text, as a list."""
    return f"list_transform(string_split({x}, chr(10)), lambda l: {q_strip('l')})"


def q_words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def q_tokens(x: str, fold: bool = True) -> str:
    low = f"lower({x})"
    if fold:
        low = f"translate({low}, '{FOLD_FROM}', '{FOLD_TO}')"
    return rf"regexp_extract_all({low}, '[\p{{L}}\p{{N}}]+')"


def q_sentences(x: str) -> str:
    return rf"""flatten(list_transform(
      list_filter({q_lines(x)}, lambda l: l <> ''),
      lambda l: case when l[1] in ('#', '-', '*', '+') or starts_with(l, '```') then [l]
        else list_filter(list_transform(
          string_split(regexp_replace(l, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
          lambda s: {q_strip('s')}), lambda s: s <> '') end))"""


def q_entities(x: str) -> str:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", "\xa0"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return x


DOCS = """docs as (
  select cast(doc_id as varchar) as doc_key, 'doc://' || doc_id as url,
         string_split(text, chr(10))[1] as title, text as content, source
  from documents)"""

# the sentences of the benchmark passages, each a question of its own
QUESTIONS = f"""questions as (
  select item_id * 1000 + i as query_id, ss[i] as q
  from (select item_id, {q_sentences('text')} as ss from benchmark),
       unnest(range(1, len(ss) + 1)) r(i))"""

# Packing: `p` holds running token sums. A chunk that starts at st and has i0 as
# its first new sentence ends before the first later sentence that overflows.
CHUNKS = f"""{DOCS},
long_docs as (
  select *, list_transform(ss, lambda s: length(s) // 4) as tk
  from (select doc_key, {q_sentences(q_strip('content'))} as ss from docs
        where length({q_strip('content')}) // 4 > 500)),
sums as (
  select doc_key, ss, tk, len(tk) as n,
    list_transform(range(1, len(tk) + 1), lambda i: cast(list_sum(tk[1:i]) as bigint)) as p
  from long_docs),
first_end as (
  select doc_key, 1 as seq, cast(1 as bigint) as st, cast(1 as bigint) as i0,
    list_position(list_transform(p, lambda x, k: k > 1 and x > 500), true) as nxt
  from sums),
packed as (
  with recursive step as (
    select doc_key, seq, st, i0, nxt from first_end
    union all
    select doc_key, seq + 1, st2, i2,
      list_position(list_transform(p, lambda x, k: k > i2 and x - (p[st2] - tk[st2]) > 500), true)
    from (
      select s.doc_key, s.seq, s.nxt as i2, m.p, m.tk,
        coalesce(nullif(list_position(list_transform(m.p, lambda x, k:
          k >= s.st and k < s.nxt and m.p[s.nxt - 1] - (x - m.tk[k]) <= 50), true), 0), s.nxt) as st2
      from step s join sums m using (doc_key)
      where coalesce(s.nxt, 0) > 0))
  select * from step),
parts as (
  select doc_key, seq as chunk_seq,
    array_to_string(ss[st:lst], ' ') as content,
    cast(p[lst] - (p[st] - tk[st]) as integer) as token_count
  from (select k.doc_key, k.seq, k.st, m.ss, m.tk, m.p,
               coalesce(nullif(k.nxt, 0) - 1, m.n) as lst
        from packed k join sums m using (doc_key))
  union all
  select doc_key, 1, {q_strip('content')}, cast(length({q_strip('content')}) // 4 as integer)
  from docs where length({q_strip('content')}) // 4 <= 500 and {q_strip('content')} <> ''),
chunks as (
  select doc_key || ':' || chunk_seq as chunk_id, p.doc_key, d.url as source_url, d.title,
    'Introduction' as heading_path, d.url as anchor_link, cast(1 as integer) as section_seq,
    cast(chunk_seq as integer) as chunk_seq, p.content, token_count,
    case when chunk_seq > 1 then p.doc_key || ':' || (chunk_seq - 1) end as prev_id,
    case when chunk_seq < max(chunk_seq) over (partition by p.doc_key)
         then p.doc_key || ':' || (chunk_seq + 1) end as next_id
  from parts p join docs d using (doc_key))"""

# whole documents as the rows of a text index
UNITS = f"""{DOCS},
chunks as (select doc_key as chunk_id, content, title, '' as heading_path, source as source_url from docs)"""

TERMS = f"""tok as (
  select chunk_id, unnest({q_tokens('content')}) as term from chunks
  union all select chunk_id, unnest({q_tokens('title')}) from chunks
  union all select chunk_id, unnest({q_tokens('heading_path')}) from chunks),
lens as (
  select c.chunk_id, count(t.term) as n_tokens
  from chunks c left join tok t using (chunk_id) group by c.chunk_id),
stats as (select count(*) as n_chunks, avg(n_tokens) as avgdl from lens),
post as (select term, chunk_id, count(*) as tf from tok group by term, chunk_id)"""

QUESTION_TERMS = r"""raw_terms as (
  select query_id, list_filter(list_transform(
      regexp_split_to_array(regexp_replace(lower(q), '[^\p{L}\p{M}\p{N}_\s-]', ' ', 'g'), '\s+'),
      lambda t: regexp_replace(t, '[^a-z0-9_-]', '', 'g')), lambda t: t <> '') as ts
  from questions),
qt as (
  select query_id, i as pos, ts[i] as term, length(ts[i]) >= 3 as is_prefix
  from raw_terms, unnest(range(1, len(ts) + 1)) r(i))"""

# a term with _ or - would be a phrase; the questions have none
BM25 = f"""{QUESTION_TERMS},
unit as (select distinct term as u, is_prefix as pre from qt),
vocab as (select distinct term from post),
expanded as (
  select u, pre, term from unit join vocab on term = u where not pre
  union all
  select u, pre, term from unit join vocab on starts_with(term, u) where pre),
hit as (
  select u, pre, chunk_id, sum(tf) as f
  from expanded join post using (term) group by u, pre, chunk_id),
idf as (
  select u, pre, case when raw <= 0 then 1e-6 else raw end as idf
  from (select u, pre, ln((n_chunks - count(*) + 0.5) / (count(*) + 0.5)) as raw
        from hit, stats group by u, pre, n_chunks)),
n_terms as (select query_id, count(*) as n from qt group by query_id),
matched as (
  select query_id, chunk_id, round(sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n_tokens / avgdl))), 6) as score
  from qt join hit on qt.term = hit.u and qt.is_prefix = hit.pre
       join idf using (u, pre) join lens using (chunk_id) join n_terms using (query_id), stats
  group by query_id, chunk_id, n having count(*) = n),
bm25 as (
  select * from (
    select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from matched)
  where rank <= 10)"""


def q_hash_vectors(name: str, source: str, key: str, text: str) -> str:
    """``name(key, v)``: unit vectors of hashed tokens; no row for empty texts."""
    return f"""{name}_tok as (
  select {key}, unnest({q_tokens(text, fold=False)}[1:512]) as t from {source}),
{name}_slot as (
  select {key}, h % 64 as d, case when (h // 64) % 2 = 0 then 1 else -1 end as s
  from (select {key}, cast('0x' || substr(md5(t), 1, 8) as bigint) as h from {name}_tok)),
{name}_sum as (select {key}, d, sum(s)::double as x from {name}_slot group by {key}, d),
{name}_n as (select {key}, count(*) as n from {name}_slot group by {key}),
{name}_mean as (select {key}, d, x / n as x from {name}_sum join {name}_n using ({key})),
{name}_norm as (select {key}, sqrt(sum(x * x)) as l from {name}_mean group by {key}),
{name} as (
  select {key}, d, x / l as x from {name}_mean join {name}_norm using ({key}) where l > 0)"""


VECTOR_SEARCH = f"""{q_hash_vectors('qv', 'questions', 'query_id', 'q')},
{q_hash_vectors('rv', 'chunks', 'chunk_id', 'content')},
sv as (select chunk_id, d, cast(cast(x as float) as double) as x from rv),  -- stored as float
cv as (select chunk_id, d, x / sqrt(sum(x * x) over (partition by chunk_id)) as x from sv),
vec as (
  select * from (
    select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank
    from (select query_id, chunk_id, round(coalesce(s, 0), 6) as score
          from (select distinct query_id from qv) cross join (select distinct chunk_id from cv)
          left join (select query_id, chunk_id, sum(qv.x * cv.x) as s
                     from qv join cv using (d) group by query_id, chunk_id) using (query_id, chunk_id)))
  where rank <= 10)"""

FUSED = """fused as (
  select query_id, chunk_id, v.rank as vector_rank, k.rank as keyword_rank,
    coalesce(1.0::double / (60 + v.rank), 0) + coalesce(1.0::double / (60 + k.rank), 0) as score,
    row_number() over (partition by query_id order by
      coalesce(1.0::double / (60 + v.rank), 0) + coalesce(1.0::double / (60 + k.rank), 0) desc,
      v.rank asc nulls last, k.rank asc nulls last, chunk_id) as fused_rank
  from vec v full outer join bm25 k using (query_id, chunk_id))"""
