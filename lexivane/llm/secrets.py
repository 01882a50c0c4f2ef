"""Secrets in whole texts, judged by who owns them across the corpus.

Labelled secrets (``assign``), access keys (``access``) and hexadecimal runs (``hex``)
are found by pattern. Their values, and long mixed strings without a label, are hashed
and counted over the corpus by distinct owners, repositories and documents. A value that
``COPIED_OWNERS`` owners, ``COPIED_REPOSITORIES`` repositories or ``COPIED_DOCUMENTS``
documents hold, or more, is an example, and so is one that looks like a placeholder; one
held by a single owner that looks random is live. Unlabelled strings become spans
(``other``) only if they are live; spans by pattern always stay.

The owner of a document is its ``source``, its repository the source and language.
``held_by`` gives owners/repositories/documents of each of the spans, in their order.

Positions are code points, ends exclusive. Null or empty text: no spans. Null owners
count as one owner. Repeated rows are judged one by one, each a document. Texts are
searched whole; work follows their length, however many matches they have. Spans of
equal start stand in order of the kinds. An empty table gives no rows.
Columns of other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.functions.markup import scan as scan_list
from lexivane.llm.common import let, query, table, text_or_empty
from lexivane.session import materialize

# fixed values: patterns by kind, in the order of ties
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OTHER = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "other")

COPIED_OWNERS = 3
COPIED_REPOSITORIES = 4
COPIED_DOCUMENTS = 50
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx|^(.)\1*$|1234567"

_ONE = "struct<start:int,rank:int,end:int,value:string>"
_SPAN = f"array<{_ONE}>"


def spans(text: Column, pattern: str, rank: int, group: int = 0) -> Column:
    """Leftmost matches that do not overlap: (start, rank, end, value).

    Starts are sums over the pieces between matches, so repeated matches are told apart.
    """
    both = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"),
        F.split(text, pattern, -1).alias("p"),
    )

    def place(b: Column) -> Column:
        sizes = F.transform(b["m"], lambda m, i: F.struct(F.length(F.get(b["p"], i)).alias("gap"), F.length(m).alias("size"), F.get(b["v"], i).alias("v")))

        def span(at, x):
            start = at + x["gap"]
            return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + x["size"]).alias("end"), x["v"].alias("value"))

        return scan_list(sizes, F.lit(0), lambda at, x: at + x["gap"] + x["size"], span, _ONE)

    return F.when(text.rlike(pattern), let(both, place)).otherwise(F.array().cast(_SPAN))


def _random(value: Column) -> Column:
    """Whether a value has digits, letters and many different characters."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= 8
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & varied


def apart(base: Column, other: Column) -> Column:
    """The spans of ``other`` that overlap none of ``base``, by one pass in order of the
    starts (does an earlier one reach into it?) and one back (does a later one begin in it?)."""

    def of(both: Column) -> Column:
        is_base = lambda s: s["rank"] < 3
        reached = scan_list(
            both, F.lit(-1), lambda m, s: F.when(is_base(s), F.greatest(m, s["end"])).otherwise(m), lambda m, s: m > s["start"], "boolean"
        )
        far = F.lit((1 << 31) - 1)
        entered = scan_list(
            F.reverse(both), far, lambda m, s: F.when(is_base(s), F.least(m, s["start"])).otherwise(m), lambda m, s: m < s["end"], "boolean"
        )
        met = F.arrays_zip(both.alias("s"), reached.alias("a"), F.reverse(entered).alias("b"))
        return F.transform(F.filter(met, lambda x: ~is_base(x["s"]) & ~x["a"] & ~x["b"]), lambda x: x["s"])

    return let(F.array_sort(F.concat(base, other)), of)


def scan(docs: DataFrame) -> DataFrame:
    """``rid, doc_id, owner, repository, base, other``: all candidates of each row."""
    text = text_or_empty()
    base = F.array_sort(
        F.concat(
            F.filter(spans(text, ASSIGN, 0, 1), lambda s: F.length(s["value"]) >= 6), spans(text, ACCESS, 1), spans(text, HEX, 2)
        )
    )
    mixed = F.filter(
        spans(text, OTHER, 3),
        lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]"),
    )
    found = docs.select(
        "doc_id", F.coalesce(F.col("source"), F.lit("")).alias("owner"),
        F.concat_ws("/", F.coalesce(F.col("source"), F.lit("")), "lang").alias("repository"),
        base.alias("base"), mixed.alias("mixed"),
    )
    free = F.when(F.size("mixed") > 0, apart(F.col("base"), F.col("mixed"))).otherwise(F.col("mixed"))

    def hashed(column: Column) -> Column:
        return F.transform(
            column,
            lambda s: F.struct(
                s["start"], s["rank"], s["end"], F.sha2(s["value"].cast("binary"), 256).alias("hash"),
                (_random(s["value"]) & ~s["value"].rlike(PLACEHOLDER)).alias("random"),
            ),
        )

    return found.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "owner", "repository", hashed(F.col("base")).alias("base"), hashed(free).alias("other")
    )


def ownership(candidates: DataFrame) -> DataFrame:
    """``hash, owners, repositories, documents`` over the corpus, of (hash, owner,
    repository) rows, one for each document with the value; counted in steps that
    are combined before each shuffle, so a value in most documents is no hot key."""
    rows = candidates.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    owners = rows.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("r"), F.sum("n").alias("n"))
    return owners.groupBy("hash").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("r").alias("repositories"), F.sum("n").alias("documents")
    )


def _listed(column: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    rows = materialize(scan(docs))  # small: no texts; row ids stay the same from here on
    each = rows.select("rid", "owner", "repository", F.explode(F.concat("base", "other")).alias("s")).select("rid", "owner", "repository", "s.*")
    once = F.explode(F.array_distinct(F.transform(F.concat("base", "other"), lambda s: s["hash"]))).alias("hash")
    known = ownership(rows.select("owner", "repository", once))
    copied = (F.col("owners") >= COPIED_OWNERS) | (F.col("repositories") >= COPIED_REPOSITORIES) | (F.col("documents") >= COPIED_DOCUMENTS)
    verdict = F.when(copied | ~F.col("random"), "example").when(F.col("owners") == 1, "live").otherwise("shared")
    held_by = F.concat_ws("/", "owners", "repositories", "documents").alias("held_by")
    judged = (
        each.join(known, "hash")
        .groupBy("rid")
        .agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", verdict.alias("verdict"), held_by))).alias("all"))
    )
    every = F.coalesce("all", F.array().cast("array<struct<start:int,rank:int,end:int,verdict:string,held_by:string>>"))
    kept = F.filter(every, lambda s: (s["rank"] < 3) | (s["verdict"] == "live"))

    def count(rank):
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    return rows.join(judged, "rid", "left").select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(kept).alias("spans"),
        F.array_join(F.transform(kept, lambda s: s["held_by"]), ",").alias("held_by"),
        _listed(F.filter(every, lambda s: s["verdict"] == "live")).alias("live_spans"),
        _listed(F.filter(every, lambda s: s["verdict"] == "example")).alias("example_spans"),
    )


def _sql_spans(rank: int, pattern: str, group: int = 0, keep: str = "true") -> str:
    pattern = pattern.replace("'", "''")
    return rf"""
  select doc_id, source, lang, t, {rank} as rank, a as "start", a + size as "end", v from (
    select *, coalesce(sum(gap + size) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) + gap as a
    from (select doc_id, source, lang, t, unnest(range(1, len(m) + 1)) as i, unnest(list_transform(m, lambda x: length(x))) as size,
            unnest(list_transform(p[1:len(m)], lambda x: length(x))) as gap, unnest(v) as v
          from (select *, regexp_extract_all(t, '{pattern}') as m, regexp_extract_all(t, '{pattern}', {group}) as v,
                  string_split_regex(t, '{pattern}') as p from d)))
  where {keep}"""


SQL = rf"""
with d as (select doc_id, coalesce(source, '') as source, lang, coalesce(text, '') as t from documents),
base as ({_sql_spans(0, ASSIGN, 1, "length(v) >= 6")} union all {_sql_spans(1, ACCESS)} union all {_sql_spans(2, HEX)}),
mixed as ({_sql_spans(3, OTHER, 0, "regexp_matches(v, '[0-9]') and regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]')")}),
other as (select * from mixed x where not exists (select 1 from base b where b.doc_id = x.doc_id and b."start" < x."end" and x."start" < b."end")),
every as (select * from base union all select * from other),
owned as (
  select v, count(distinct source) as owners, count(distinct case when lang is null then source else source || '/' || lang end) as repositories,
    count(distinct doc_id) as documents
  from every group by v),
judged as (
  select e.*, ['assign', 'access', 'hex', 'other'][rank + 1] || ':' || cast("start" as bigint) || ':' || cast("end" as bigint) as s,
    owners || '/' || repositories || '/' || documents as held_by,
    case when owners >= 3 or repositories >= 4 or documents >= 50 or not (regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]') and len(list_distinct(string_split(v, ''))) >= 8)
      or regexp_matches(v, '(?i)example|sample|dummy|changeme|placeholder|your|xxxx|1234567') or length(replace(v, v[1], '')) = 0 then 'example'
      when owners = 1 then 'live' else 'shared' end as verdict
  from every e join owned using (v))
select d.doc_id, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
  sha256(coalesce(string_agg(s, ',' order by "start", rank) filter (rank < 3), '')) as base_sha256,
  coalesce(string_agg(s, ',' order by "start", rank) filter (rank < 3 or verdict = 'live'), '') as spans,
  coalesce(string_agg(held_by, ',' order by "start", rank) filter (rank < 3 or verdict = 'live'), '') as held_by,
  coalesce(string_agg(s, ',' order by "start", rank) filter (verdict = 'live'), '') as live_spans,
  coalesce(string_agg(s, ',' order by "start", rank) filter (verdict = 'example'), '') as example_spans
from d left join judged j using (doc_id) group by d.doc_id
"""


@query("op4_secret_scans", SQL)
def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
