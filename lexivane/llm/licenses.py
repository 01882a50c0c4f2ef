"""Licences of files: TF-IDF cosine of notices to templates, then inheritance by path.

A file's notice is all of its lines that speak of a licence. Distinct notices are
compared with the templates: terms weigh log((N + 1) / (files with the term + 1)) + 1,
counted over all notices of the corpus, and the best cosine of ``LEAST`` or more names
the licence. A file is a licence file if its name says so or if the notice is at least
``SHARE`` of its words; licence files set the licence of their directory (the most
frequent one, then the first by name). A file without a notice of its own takes the
licence of the nearest ancestor directory that has one.

Only notices and paths are shuffled, never texts. The templates are a fixed table.

Null or empty text: no notice, so the licence is inherited. Null parts of a path are
empty names. Repeated rows are judged one by one; ties of cosine go to the first name.
An empty table gives no rows. Columns of other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.llm.common import WORD, query, table, text_or_empty
from lexivane.session import materialize

# fixed values: short notices and titles by licence
TEMPLATES = (
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD license"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under the CC0 1.0 license"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License version 3"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "MIT License"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
)
LINE = r"(?i)licen[sc]e|copyright|spdx"
FILE_NAME = r"(?i)^(licen[sc]e|copying|notice)(\.[a-z]+)?$"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
LEAST = 0.5
SHARE = 0.1
PLACES = 6  # of a cosine, so that the order of summing cannot decide


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def notices(files: DataFrame) -> DataFrame:
    """path, text, doc_id -> ``rid, doc_id, path, dir, notice, whole``."""
    text = text_or_empty()
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(LINE))
    own = files.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        "path",
        F.regexp_replace("path", "/?[^/]*$", "").alias("dir"),
        F.when(text.rlike(LINE), F.array_join(lines, " ")).alias("notice"),
        F.when(text.rlike(LINE), F.regexp_count(text, F.lit(WORD))).alias("n_words"),
    )
    named = F.substring_index("path", "/", -1).rlike(FILE_NAME)
    mostly = F.regexp_count("notice", F.lit(WORD)) >= SHARE * F.col("n_words")
    return own.withColumn("whole", F.col("notice").isNotNull() & (named | mostly)).drop("n_words")


def best_templates(files: DataFrame, spark: SparkSession) -> DataFrame:
    """``notice, license, score`` of each distinct notice that a template fits."""
    distinct = files.where("notice is not null").groupBy("notice").agg(F.count(F.lit(1)).alias("times"))
    distinct = materialize(distinct.withColumn("nid", F.monotonically_increasing_id()))
    n = distinct.agg(F.sum("times")).first()[0] or 0
    tf = materialize(
        distinct.select("nid", "times", F.explode(_terms(F.col("notice"))).alias("term")).groupBy("nid", "times", "term").agg(F.count(F.lit(1)).alias("tf"))
    )
    df = tf.groupBy("term").agg(F.sum("times").alias("df"))
    known = spark.createDataFrame(list(TEMPLATES), "license string, text string")
    model = known.select("license", "text", F.explode(_terms(F.col("text"))).alias("term")).groupBy("license", "text", "term").agg(F.count(F.lit(1)).alias("t"))

    def idf(df: Column) -> Column:
        return F.log((F.lit(n) + 1.0) / (F.coalesce(df, F.lit(0)) + 1.0)) + 1.0

    weighed = tf.join(df, "term").select("nid", "term", (F.col("tf") * idf(F.col("df"))).alias("w"))
    norm = weighed.groupBy("nid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    models = model.join(df, "term", "left").select("license", "text", "term", (F.col("t") * idf(F.col("df"))).alias("m"))
    sizes = models.groupBy("license", "text").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("size"))
    models = F.broadcast(models.join(sizes, ["license", "text"]))  # the terms of TEMPLATES
    dots = weighed.join(models, "term").groupBy("nid", "license", "text", "size").agg(F.sum(F.col("w") * F.col("m")).alias("dot"))
    scores = dots.join(norm, "nid").withColumn("score", F.round(F.col("dot") / F.col("norm") / F.col("size"), PLACES))
    # the greatest score, then the first name
    best = scores.where(F.col("score") >= LEAST).groupBy("nid").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return best.join(distinct, "nid").select("notice", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def inherited(dirs: DataFrame, own: DataFrame) -> DataFrame:
    """dir -> ``dir, from_dir, from_license`` of its nearest ancestor in ``own``."""
    parts = F.split("dir", "/")
    depth = F.explode(F.sequence(F.lit(1), F.size(parts)))
    up = dirs.select("dir", parts.alias("p"), depth.alias("d")).select("dir", "d", F.array_join(F.slice("p", 1, F.col("d")), "/").alias("from_dir"))
    near = up.join(own.withColumnRenamed("dir", "from_dir"), "from_dir")
    return near.groupBy("dir").agg(F.max(F.struct("d", "from_dir", "license")).alias("b")).select("dir", "b.from_dir", F.col("b.license").alias("from_license"))


def scan_licenses(files: DataFrame) -> DataFrame:
    """``doc_id, path, license, score, origin, from_dir`` of files (doc_id, path, text)."""
    held = materialize(notices(files))
    named = materialize(
        held.join(best_templates(held, files.sparkSession), "notice", "left").select("rid", "doc_id", "path", "dir", "whole", "license", "score")
    )
    sets = named.where("whole and license is not null").groupBy("dir", "license").agg(F.count(F.lit(1)).alias("n"))
    own = sets.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "license")).alias("b")).select("dir", "b.license")
    above = inherited(named.groupBy("dir").count().select("dir"), own)
    has = F.col("license").isNotNull()
    origin = (
        F.when(has & F.col("whole"), "licence file").when(has, "header").when(F.col("from_license").isNotNull(), "inherited").otherwise("none")
    )
    return named.join(above, "dir", "left").select(
        "doc_id",
        "path",
        F.coalesce("license", "from_license").alias("license"),
        "score",
        origin.alias("origin"),
        F.when(~has, F.col("from_dir")).alias("from_dir"),
    )


_ROWS = ", ".join(f"('{k}', '{t}')" for k, t in TEMPLATES)
SQL = rf"""
with f as (
  select row_number() over () as rid, doc_id, concat_ws('/', coalesce(source, ''), coalesce(lang, ''), coalesce(cast(doc_id as varchar), '')) as path,
    coalesce(source, '') || '/' || coalesce(lang, '') as dir, coalesce(text, '') as t from documents),
h as (
  select *, len(regexp_extract_all(notice, '[^\x20\x09-\x0D]+')) >= 0.1 * len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as whole
  from (select *, array_to_string(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{LINE}')), ' ') as notice from f)
  where notice <> ''),
tf as (
  select rid, term, count(*) as tf from (select rid, unnest(regexp_extract_all(lower(notice), '{TERM}')) as term from h) group by rid, term),
df as (select term, count(*) as df from tf group by term),
n as (select count(*) as n from h),
m as (
  select license, text, term, count(*) as t from (
    select license, text, unnest(regexp_extract_all(lower(text), '{TERM}')) as term from (values {_ROWS}) v(license, text))
  group by license, text, term),
w as (select rid, term, tf * (ln((n + 1.0::double) / (df + 1)) + 1) as w from tf join df using (term), n),
mw as (select license, text, term, t * (ln((n + 1.0::double) / (coalesce(df, 0) + 1)) + 1) as m from m left join df using (term), n),
c as (
  select rid, license, round(sum(w * m) / any_value(a.s) / any_value(b.s), 6) as score
  from w join mw using (term) join (select rid, sqrt(sum(w * w)) as s from w group by rid) a using (rid)
    join (select license, text, sqrt(sum(m * m)) as s from mw group by license, text) b using (license, text)
  group by rid, license, text),
best as (select rid, license, score from c where score >= 0.5 qualify row_number() over (partition by rid order by score desc, license) = 1),
named as (select f.rid, f.doc_id, f.path, f.dir, coalesce(whole, false) as whole, license, score from f left join h using (rid) left join best using (rid)),
own as (
  select dir, license from named where whole and license is not null group by dir, license
  qualify row_number() over (partition by dir order by count(*) desc, license) = 1),
up as (
  select named.rid, own.dir as from_dir, own.license as from_license from named join own on named.dir = own.dir or starts_with(named.dir, own.dir || '/')
  qualify row_number() over (partition by named.rid order by length(own.dir) desc) = 1)
select doc_id, path, coalesce(license, from_license) as license, score,
  case when license is not null and whole then 'licence file' when license is not null then 'header'
    when from_license is not null then 'inherited' else 'none' end as origin,
  case when license is null then from_dir end as from_dir
from named left join up using (rid)
"""


@query("op6_license_scans", SQL)
def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "lang", "doc_id")]
    return scan_licenses(docs.select("doc_id", "text", F.concat_ws("/", *parts).alias("path")))
