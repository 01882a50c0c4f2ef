"""Registered queries: retrieval and what is made of its results."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexivane.functions.vectors import dot, l2_normalize
from lexivane.operators import answers as A
from lexivane.operators import bm25 as B
from lexivane.operators import context as K
from lexivane.operators import fusion as U
from lexivane.operators.chunking import sentences
from lexivane.operators.knn import knn
from lexivane.operators.postings import build_postings, term_stats, tokenize
from lexivane.operators.vector_lists import build_lists, knn_lists
from lexivane.plans import inputs
from lexivane.plans.catalog import (
    BM25,
    CHUNKS,
    FUSED,
    QUESTION_TERMS,
    QUESTIONS,
    TERMS,
    UNITS,
    VECTOR_SEARCH,
    q_sentences,
    q_tokens,
    query,
)
from lexivane.plans.retrieve import embed_queries, hybrid_retrieve, prompts
from lexivane.session import materialize
from lexivane.sources.tables import table

# Boosts that bite on the invented corpus: (words, part of the source, bonus).
RULES = ((("the", "and"), "src1", 0.02), (("de",), "src2", 0.005))


# What the registered queries ask of a model; users bring their own.
PROMPT = """You answer questions about documentation, and only from the passages given here.

Rules:
- Use nothing that is not in the passages.
- End each statement of fact with [Source: chunk_id].
- If the passages do not hold the answer, say that.
- Give steps and code from the passages where they help.

PASSAGES:
{context_chunks}

QUESTION: {user_question}
"""


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return (
        e.select(F.col("vec_id").alias("query_id"), "embedding"),
        e.select(F.col("vec_id").alias("chunk_id"), "embedding"),
    )


def _q_knn(score: str) -> str:
    return f"""select query_id, chunk_id, score, rank from (
      select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank
      from (select a.vec_id as query_id, b.vec_id as chunk_id, round({score}, 6) as score
            from (select vec_id, embedding::double[] as x from embeddings) a, (select vec_id, embedding::double[] as y from embeddings) b))
    where rank <= 10"""


def _ranked(df):
    return df.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("knn_cosine", _q_knn("list_cosine_similarity(x, y)"))
def knn_cosine(spark, sf):
    return _ranked(knn(*_vectors(spark, sf), digits=6))


@query("knn_l2_similarity", _q_knn("1 / (1 + power(list_distance(x, y), 2))"))
def knn_l2(spark, sf):
    return _ranked(knn(*_vectors(spark, sf), metric="l2sq", digits=6))


@query(
    "knn_lsh",
    "select vec_id as query_id, 10::bigint as n, true as exact_scores, true as enough_recall, true as fewer_scored from embeddings",
)
def knn_approximate(spark, sf):
    """By inverted lists, held against the exact search: for each query, how many it
    finds, whether all its scores are the exact ones, whether 0.9 of all neighbours are
    found, and whether lists were left unread."""
    q, v = _vectors(spark, sf)
    lists = build_lists(v)
    near = materialize(knn_lists(q, lists, digits=6))
    exact = materialize(knn(q, v, digits=6))
    hit = F.count_if(F.col("e.chunk_id").isNotNull() & F.col("n.chunk_id").isNotNull())
    pairs = near.alias("n").join(exact.alias("e"), ["query_id", "chunk_id"], "full")
    recall = (pairs.agg(hit.alias("h")).first()["h"]) / max(1, exact.count())
    vectors = near.join(q, "query_id").join(v.withColumnRenamed("embedding", "other"), "chunk_id")
    truth = F.round(dot(l2_normalize(F.col("embedding")), l2_normalize(F.col("other"))), 6)
    same = F.abs(truth - F.col("score")) <= 1e-6
    return vectors.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min(same).alias("exact_scores")).select(
        "*", F.lit(recall >= 0.9).alias("enough_recall"), F.lit(lists.probes < len(lists.centroids)).alias("fewer_scored")
    )


@query("parse_query", f"with {QUESTIONS}, {QUESTION_TERMS} select query_id, cast(pos as integer) as pos, term, is_prefix from qt")
def parse_query(spark, sf):
    return B.parse_query(inputs.questions(spark, sf))


@query(
    "tokenize",
    f"""with {UNITS}, t as (select chunk_id, 'content' as col, {q_tokens('content')} as ts from chunks
      union all select chunk_id, 'title', {q_tokens('title')} from chunks)
    select chunk_id, col, cast(i as integer) as pos, ts[i] as token from t, unnest(range(1, len(ts) + 1)) r(i)""",
)
def tokenize_documents(spark, sf):
    return tokenize(inputs.whole_documents(spark, sf))


@query(
    "build_postings",
    f"""with {UNITS}, t as (select chunk_id, 0 as n, {q_tokens('content')} as ts from chunks
      union all select chunk_id, 1, {q_tokens('title')} from chunks),
    o as (select chunk_id, ts[i] as term, i + n * 268435456 as pos from t, unnest(range(1, len(ts) + 1)) r(i))
    select chunk_id, term, cast(count(*) as integer) as tf, string_agg(cast(pos as varchar), ',' order by pos) as positions
    from o group by chunk_id, term""",
)
def postings(spark, sf):
    p = build_postings(inputs.whole_documents(spark, sf))
    listed = F.array_join(F.transform("positions", lambda x: x.cast("string")), ",")
    return p.select("chunk_id", "term", "tf", listed.alias("positions"))


@query("term_stats", f"with {UNITS}, {TERMS} select term, count(*) as df from post group by term")
def term_statistics(spark, sf):
    return term_stats(build_postings(inputs.whole_documents(spark, sf)))


@query(
    "corpus_stats",
    f"with {UNITS}, {TERMS} select n_chunks, round(avgdl, 6) as avgdl from stats",
)
def corpus_statistics(spark, sf):
    ix = inputs.index(spark, sf, "documents")
    return ix.stats.select("n_chunks", F.round("avgdl", 6).alias("avgdl"))


@query(
    "prefix_expand",
    f"""with {UNITS}, {TERMS}, {QUESTIONS}, {QUESTION_TERMS}
    select distinct q.term as prefix, v.term from (select distinct term from qt where is_prefix) q
    join (select distinct term from post) v on starts_with(v.term, q.term)""",
)
def prefix_expand(spark, sf):
    terms = B.parse_query(inputs.questions(spark, sf)).filter("is_prefix")
    return B.prefix_expand(terms.select(F.col("term").alias("prefix")), inputs.index(spark, sf, "documents").dictionary)


_SEARCH = f"{UNITS}, {TERMS}, {QUESTIONS}, {BM25}"


@query("match_all_terms", f"with {_SEARCH} select query_id, chunk_id from matched")
def match_all_terms(spark, sf):
    return B.match_all_terms(inputs.questions(spark, sf), inputs.index(spark, sf, "documents"))


@query("bm25_topk", f"with {_SEARCH} select query_id, chunk_id, score, rank from bm25")
def bm25_topk(spark, sf):
    return _ranked(B.bm25_topk(inputs.questions(spark, sf), inputs.index(spark, sf, "documents"), digits=6))


@query("bm25_topk_stemmed")
def bm25_stemmed(spark, sf):
    """With Porter stems, as the full-text store of the original has them."""
    return _ranked(B.bm25_topk(inputs.questions(spark, sf), inputs.index(spark, sf, "documents", stem=True), digits=6))


def _lists(spark, sf):
    q, ix = inputs.questions(spark, sf), inputs.index(spark, sf, "chunks")
    vec = inputs.once(spark, sf, "vec", lambda: knn(embed_queries(q), ix.embeddings, digits=6))
    kw = inputs.once(spark, sf, "kw", lambda: B.bm25_topk(q, ix, digits=6))
    return q, vec, kw, ix


_FUSE = f"{CHUNKS}, {TERMS}, {QUESTIONS}, {BM25}, {VECTOR_SEARCH}, {FUSED}"


@query(
    "rrf_fuse",
    f"""with {_FUSE} select query_id, chunk_id, vector_rank, keyword_rank, round(score, 9) as score, fused_rank from fused""",
)
def rrf(spark, sf):
    _, vec, kw, _ = _lists(spark, sf)
    big = lambda c: F.col(c).cast("bigint").alias(c)
    return U.rrf_fuse(vec, kw).select(
        "query_id", "chunk_id", big("vector_rank"), big("keyword_rank"), F.round("score", 9).alias("score"), big("fused_rank")
    )


def q_boosted(rules) -> str:
    bonus = " + ".join(
        "case when (" + " or ".join(f"contains(lower(q), '{h}')" for h in hints) + f") and contains(source_url, '{where}') then {amount}::double else 0 end"
        for hints, where, amount in rules
    )
    return f"""boosted as (
      select query_id, chunk_id, fused_rank, source_url, score + {bonus} as score,
        row_number() over (partition by query_id order by score + {bonus} desc, fused_rank) as final_rank
      from fused join questions using (query_id) join chunks using (chunk_id))"""


def _boosted(spark, sf):
    q, vec, kw, ix = _lists(spark, sf)
    fused = materialize(U.rrf_fuse(vec, kw))
    return q, U.domain_boost(K.lookup(fused, ix.chunks.select("bucket", "chunk_id", "source_url"), ix.n_buckets), q, RULES)


@query(
    "domain_boost",
    f"with {_FUSE}, {q_boosted(RULES)} select query_id, chunk_id, fused_rank, final_rank, round(score, 9) as score from boosted",
)
def boost(spark, sf):
    _, out = _boosted(spark, sf)
    big = lambda c: F.col(c).cast("bigint").alias(c)
    return out.select("query_id", "chunk_id", big("fused_rank"), big("final_rank"), F.round("score", 9).alias("score"))


@query(
    "top_k",
    f"""with {_FUSE}, {q_boosted(RULES)} select query_id, chunk_id, final_rank from boosted
    where final_rank <= query_id % 20 + 1""",
)
def top(spark, sf):
    """Each question asks for its own number of results."""
    q, out = _boosted(spark, sf)
    asked = q.withColumn("top_k", F.col("query_id") % 20 + 1)
    return U.top_k(out, asked).select("query_id", "chunk_id", F.col("final_rank").cast("bigint").alias("final_rank"))


@query(
    "query_filter",
    r"""with r as (select item_id as query_id, case when item_id % 3 = 0 then '  ' else text end as q, item_id % 25 as top_k from benchmark)
    select query_id, case when trim(q) = '' then 'empty query' when top_k not between 1 and 20 then 'top_k out of range' else 'ok' end as outcome from r""",
)
def query_filter(spark, sf):
    b = table(spark, sf, "benchmark")
    asked = b.select(
        F.col("item_id").alias("query_id"),
        F.when(F.col("item_id") % 3 == 0, "  ").otherwise(F.col("text")).alias("q"),
        (F.col("item_id") % 25).alias("top_k"),
    )
    good, bad = U.valid_queries(asked)
    return good.select("query_id", F.lit("ok").alias("outcome")).unionByName(
        bad.select("query_id", F.col("error").alias("outcome"))
    )


# ---- chunk level ---------------------------------------------------------

_CHUNK_SEARCH = f"{CHUNKS}, {TERMS}, {QUESTIONS}, {BM25}"
_HYBRID = f"{_CHUNK_SEARCH}, {VECTOR_SEARCH}, {FUSED}"


def _hits(spark, sf):
    """The five best chunks per question by keyword."""
    ix = inputs.index(spark, sf, "chunks")
    return ix, inputs.once(spark, sf, "hits", lambda: B.bm25_topk(inputs.questions(spark, sf), ix, k=5, digits=6))


_Q_HITS = "hits as (select * from bm25 where rank <= 5)"
_Q_WINDOW = """win as (
  select query_id, c.chunk_id, c.doc_key, c.chunk_seq, min(rank) as hit_rank,
    arg_min(c.chunk_seq - h.seq, rank * 1000 + abs(c.chunk_seq - h.seq) * 10 + (c.chunk_seq - h.seq + 2)) as "offset"
  from (select query_id, rank, string_split(chunk_id, ':')[1] as dk, cast(string_split(chunk_id, ':')[2] as integer) as seq from hits) h
  join chunks c on c.doc_key = h.dk and c.chunk_seq between h.seq - 2 and h.seq + 2
  group by query_id, c.chunk_id, c.doc_key, c.chunk_seq)"""


@query(
    "context_window",
    f"""with {_CHUNK_SEARCH}, {_Q_HITS}, {_Q_WINDOW}
    select query_id, chunk_id, doc_key, chunk_seq, hit_rank, cast("offset" as integer) as "offset" from win""",
)
def context_window(spark, sf):
    ix, hits = _hits(spark, sf)
    out = K.context_window(hits, ix.chunks)
    return out.withColumn("hit_rank", F.col("hit_rank").cast("bigint"))


@query(
    "expand_context",
    f"""with recursive {_CHUNK_SEARCH}, {_Q_HITS},
    h as (
      select query_id, rank, score, b.chunk_id, p1.chunk_id as p1, p2.chunk_id as p2, n1.chunk_id as n1, n2.chunk_id as n2
      from hits b
      join chunks c using (chunk_id)
      left join chunks p1 on p1.doc_key = c.doc_key and p1.chunk_seq = c.chunk_seq - 1
      left join chunks p2 on p2.doc_key = c.doc_key and p2.chunk_seq = c.chunk_seq - 2
      left join chunks n1 on n1.doc_key = c.doc_key and n1.chunk_seq = c.chunk_seq + 1
      left join chunks n2 on n2.doc_key = c.doc_key and n2.chunk_seq = c.chunk_seq + 2),
    walk(query_id, rank, listed, scored) as (
      select distinct query_id, 0::bigint, []::varchar[], []::varchar[] from h
      union all
      select query_id, rank, listed || case when n1 is null or list_contains(listed, n1) then []
          when n2 is null or list_contains(listed, n2) then [n1] else [n1, n2] end, scored
      from (
        select query_id, rank, scored, n1, n2, listed[:list_position(listed, chunk_id) - 1]
          || case when p1 is null or list_contains(listed, p1) then []
               when p2 is null or list_contains(listed, p2) then [p1] else [p1, p2] end
          || listed[list_position(listed, chunk_id):] as listed
        from (
          select h.*, case when list_contains(w.listed, chunk_id) then w.listed else list_append(w.listed, chunk_id) end as listed,
            case when list_contains(w.listed, chunk_id) then w.scored else list_append(w.scored, chunk_id) end as scored
          from walk w join h on h.query_id = w.query_id and h.rank = w.rank + 1))),
    done as (select * from walk qualify row_number() over (partition by query_id order by rank desc) = 1)
    select d.query_id, i as position, d.listed[i] as chunk_id,
      case when list_contains(d.scored, d.listed[i]) then h.score else 0 end as score
    from done d, unnest(range(1, len(d.listed) + 1)) r(i) left join h on h.query_id = d.query_id and h.chunk_id = d.listed[i]""",
)
def expand_context(spark, sf):
    ix, hits = _hits(spark, sf)
    return K.expand_context(hits, ix.chunks).withColumn("position", F.col("position").cast("bigint"))


@query(
    "hybrid_retrieve",
    f"""with {_HYBRID}, {q_boosted(RULES)}, hits as (
      select query_id, chunk_id, score, final_rank as rank from boosted where final_rank <= 5), {_Q_WINDOW},
    best as (select *, min(hit_rank) over (partition by query_id, doc_key) as b from win)
    select w.query_id, row_number() over (partition by w.query_id order by b, w.doc_key, w.chunk_seq) as position,
      w.chunk_id, round(coalesce(h.score, 0), 9) as score, h.rank as hit_rank, c.content, c.heading_path
    from best w join chunks c using (chunk_id) left join hits h on h.query_id = w.query_id and h.chunk_id = w.chunk_id""",
)
def hybrid(spark, sf):
    """The whole of retrieval over the chunk index, for all questions at once."""
    out = hybrid_retrieve(inputs.questions(spark, sf), inputs.index(spark, sf, "chunks"), rules=RULES, digits=6)
    return out.select(
        "query_id",
        F.col("position").cast("bigint").alias("position"),
        "chunk_id",
        F.round("score", 9).alias("score"),
        F.col("hit_rank").cast("bigint").alias("hit_rank"),
        "content",
        "heading_path",
    )


@query(
    "answer_prompts",
    rf"""with {_HYBRID}, {q_boosted(RULES)},
    asked as (select query_id, case when query_id % 10 = 3 then ' ' else q end as q, query_id % 23 as top_k from questions),
    hits as (select query_id, chunk_id, score, final_rank as rank from boosted join asked using (query_id)
      where query_id % 10 <> 3 and top_k between 1 and 20 and final_rank <= top_k), {_Q_WINDOW},
    best as (select *, min(hit_rank) over (partition by query_id, doc_key) as b from win),
    results as (select w.query_id, row_number() over (partition by w.query_id order by b, w.doc_key, w.chunk_seq) as position, c.*
      from best w join chunks c using (chunk_id)),
    contexts as (
      select query_id, count(*) as n, string_agg(chr(10) || '--- Chunk ID: ' || chunk_id || ' ---' || chr(10)
        || 'Source: ' || source_url || chr(10) || 'Section: ' || heading_path || chr(10) || 'Content:' || chr(10)
        || content || chr(10) || '---' || chr(10), chr(10) order by position) as context
      from results group by query_id)
    select query_id, case when query_id % 10 = 3 then 'empty query' when top_k not between 1 and 20 then 'top_k out of range'
        when n is null then 'no result' else 'ok' end as status,
      replace(replace('{PROMPT.replace("'", "''")}', '{{user_question}}', q), '{{context_chunks}}', context) as prompt,
      coalesce(n, 0) as chunks_retrieved, case when query_id % 2 = 1 then coalesce(n, 0) else 0 end as n_sources
    from asked left join contexts using (query_id)""",
)
def answer_prompts(spark, sf):
    """From questions to prompts, blank ones and those that ask for too much among them."""
    q = inputs.questions(spark, sf)
    asked = q.select(
        "query_id", F.when(F.col("query_id") % 10 == 3, " ").otherwise(F.col("q")).alias("q"),
        (F.col("query_id") % 23).cast("int").alias("top_k"), (F.col("query_id") % 2 == 1).alias("include_sources"),
    )
    out = prompts(asked, inputs.index(spark, sf, "chunks"), PROMPT, rules=RULES, digits=6)
    return out.select("query_id", "status", "prompt", "chunks_retrieved", F.size("sources").cast("bigint").alias("n_sources"))


# ---- answers -------------------------------------------------------------

_Q_RESULTS = """results as (
  select query_id, rank as position, score, c.* from hits join chunks c using (chunk_id))"""
_Q_CONTEXT = r"""contexts as (
  select query_id, count(*) as n_chunks, string_agg(chr(10) || '--- Chunk ID: ' || chunk_id || ' ---' || chr(10)
    || 'Source: ' || source_url || chr(10) || 'Section: ' || heading_path || chr(10) || 'Content:' || chr(10)
    || content || chr(10) || '---' || chr(10), chr(10) order by position) as context
  from results group by query_id)"""
_ANSWERS = f"{_CHUNK_SEARCH}, {_Q_HITS}, {_Q_RESULTS}"


def _results(spark, sf):
    ix, hits = _hits(spark, sf)
    placed = hits.withColumn("position", F.col("rank")).drop("rank")
    return K.lookup(placed, ix.chunks.drop("created_at"), ix.n_buckets)


@query("format_context", f"with {_ANSWERS}, {_Q_CONTEXT} select query_id, context, n_chunks from contexts")
def format_context(spark, sf):
    return A.format_context(_results(spark, sf))


@query(
    "build_prompt",
    f"""with {_ANSWERS}, {_Q_CONTEXT} select query_id, replace(replace('{PROMPT.replace("'", "''")}', '{{user_question}}', q), '{{context_chunks}}', context) as prompt
    from contexts join questions using (query_id)""",
)
def build_prompt(spark, sf):
    contexts = A.format_context(_results(spark, sf))
    return A.build_prompt(inputs.questions(spark, sf), contexts, PROMPT)


@query(
    "source_list",
    f"""with {_ANSWERS}, n as (select query_id, count(*) as chunks_retrieved from results group by query_id)
    select query_id, chunks_retrieved, position, chunk_id, title, url, relevance_score
    from n left join (select query_id, position, chunk_id, title, source_url as url, score as relevance_score
                      from results where query_id % 2 = 1) r using (query_id)""",
)
def source_list(spark, sf):
    """Every other question wants no sources; it keeps a row without one."""
    asked = inputs.questions(spark, sf).withColumn("include_sources", F.col("query_id") % 2 == 1)
    out = A.source_list(_results(spark, sf), asked)
    return out.select("query_id", "chunks_retrieved", F.explode_outer("sources").alias("s")).select(
        "query_id",
        "chunks_retrieved",
        F.col("s.position").cast("bigint").alias("position"),
        "s.chunk_id",
        "s.title",
        "s.url",
        "s.relevance_score",
    )


@query(
    "citation_audit",
    f"""with c as (select conv_id, turn, {q_sentences('text')} as ss from conversations),
    s as (select conv_id || '-' || turn as answer_id, ss[i] as s, i,
        case when i % 3 = 0 then null when i % 5 = 0 then 'nowhere' else 'u' || turn end as cited
      from c, unnest(range(1, len(ss) + 1)) r(i)),
    a as (select answer_id, count(distinct cited) as n_cited, count(distinct cited) filter (where cited = 'nowhere') as n_invalid,
        count(*) filter (where cited is null) as n_uncited from s group by answer_id),
    k as (select conv_id || '-' || turn as answer_id from conversations)
    select answer_id, coalesce(n_cited, 0) as n_cited, coalesce(n_invalid, 0) as n_invalid, coalesce(n_uncited, 0) as n_uncited,
      case when coalesce(n_invalid, 0) = 0 and coalesce(n_uncited, 0) = 0 then 'COMPLIANT' else 'NON_COMPLIANT' end as verdict
    from k left join a using (answer_id)""",
)
def citation_audit(spark, sf):
    """Turns as answers: every third sentence uncited, every fifth cites an
    unknown source, the rest the turn's own."""
    t = table(spark, sf, "conversations")
    own = F.concat(F.lit("u"), F.col("turn"))

    def cite(s, i):
        mark = F.when((i + 1) % 5 == 0, "nowhere").otherwise(own)
        cited = F.concat(F.regexp_replace(s, r"[.!?]+$", ""), F.lit(" [Source: "), mark, F.lit("]."))
        # a full stop ends every sentence, so that line joins do not merge them
        bare = F.concat(F.regexp_replace(s, r"[.!?]+$", ""), F.lit("."))
        return F.when((i + 1) % 3 == 0, bare).otherwise(cited)

    name = F.concat_ws("-", "conv_id", "turn").alias("answer_id")
    text = F.array_join(F.transform(sentences(F.col("text")), cite), "\n")
    answers = t.select(name, text.alias("answer"))
    return A.citation_audit(answers, t.select(name, own.alias("chunk_id")))


@query(
    "containment_labels",
    rf"""with d as (select cast(doc_id as varchar) as chunk_id, ' ' || regexp_replace(trim(text, ' ' || chr(10)), '\s+', ' ', 'g') || ' ' as t from documents),
    b as (select item_id as query_id, ' ' || regexp_replace(trim(text, ' ' || chr(10)), '\s+', ' ', 'g') || ' ' as p from benchmark)
    select query_id, chunk_id from b, d where contains(t, p)""",
)
def containment_labels(spark, sf):
    passages = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return A.containment_labels(passages, inputs.whole_documents(spark, sf).select("chunk_id", "content"))


@query(
    "retrieval_eval",
    rf"""with {UNITS}, {TERMS}, {QUESTIONS}, {BM25},
    d as (select cast(doc_id as varchar) as chunk_id, ' ' || regexp_replace(trim(text, ' ' || chr(10)), '\s+', ' ', 'g') || ' ' as t from documents),
    b as (select item_id, ' ' || regexp_replace(trim(text, ' ' || chr(10)), '\s+', ' ', 'g') || ' ' as p from benchmark),
    labels as (select query_id, chunk_id from b, d, questions where contains(t, p) and query_id // 1000 = item_id),
    f as (select l.query_id, l.chunk_id, r.rank from labels l left join bm25 r using (query_id, chunk_id)),
    q as (select query_id, count(*) as n, min(rank) as first, k, count(*) filter (where rank <= k) as got
      from f, (values (1), (5), (10)) t(k) group by query_id, k)
    select k, count(*) as n_queries, round(avg(got::double / n), 6) as recall,
      round(avg(case when first <= k then 1.0::double / first else 0 end), 6) as mrr from q group by k""",
)
def retrieval_eval(spark, sf):
    """Each sentence of a passage should find the documents that hold the passage."""
    q, ix = inputs.questions(spark, sf), inputs.index(spark, sf, "documents")
    passages = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    held = A.containment_labels(passages, inputs.whole_documents(spark, sf).select("chunk_id", "content"))
    labels = q.select("query_id", F.floor(F.col("query_id") / 1000).alias("item_id")).join(
        held.withColumnRenamed("query_id", "item_id"), "item_id"
    )
    out = A.retrieval_eval(B.bm25_topk(q, ix, digits=6), labels)
    return out.select("k", "n_queries", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))
