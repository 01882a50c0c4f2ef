"""Weighted fair queueing of sources to target shares.

Documents of a source are shuffled by a hash and served in packets of at most
``PACKET`` words. A packet's virtual finish time is the words of its source up to its
end, divided by the source's target; second copies follow a source's whole first round.
All packets are range-sorted by finish time and cut at the total budget, so all sources
come to their targets together, within a packet of each.

Shuffled positions are sums over tiles of a source, so that a source with most of the
rows is spread over many tasks. The sums of sources and of ranges are one row each.

Null text: 0 words. Null source: a source of its own, last in order. Repeated rows:
queued one by one. Sources without words: target 0. Empty table: no rows. Very long
texts: many packets. Ties in finish time: by hash of the id. Columns of other names are
ignored by ``mix_digest`` and kept by ``mix_rows``, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexivane.llm.common import WORD, query, table, text_or_empty, tiles
from lexivane.session import bounded_broadcast, materialize, settled

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
PACKET = 256  # words that a document is served at a time

SQL = r"""
with d as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), '')) as u,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size
  from documents),
s as (
  select source, sum(size) as held,
    case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w
  from d group by source),
r as (
  select *, coalesce(sum(2.0::double * held) over before, 0) as full_before,
    sum(w) over (order by held / w, source rows between current row and unbounded following) as w_left,
    (select 1.5::double * sum(held) from s) as budget
  from s window before as (order by held / w, source rows between unbounded preceding and 1 preceding)),
level as (select max(case when (budget - full_before) / w_left <= 2.0 * held / w then (budget - full_before) / w_left end) as v from r),
t as (select source, cast(held as bigint) as source_size, least(2.0 * held, w * coalesce(v, 0)) as target from r, level),
q as (
  select d.*, source_size, target, row_number() over () as i,
    sum(size) over (partition by d.source order by u, doc_id rows unbounded preceding) - size as ahead
  from d join t on d.source is not distinct from t.source),
p as (
  select i, words, coalesce(sum(words) over (order by finish, u, copy, pos rows between unbounded preceding and 1 preceding), 0) as before
  from (
    select i, u, copy, pos, least(256, size - pos) as words,
      (ahead + copy * source_size + pos + least(256, size - pos))::double / target as finish
    from (select *, unnest(range(0, size, 256)) as pos from q where size > 0 and target > 0), (values (0), (1)) c(copy))),
taken as (
  select i, sum(greatest(0, least(words, (select floor(1.5 * sum(size)) from d) - before))) as n from p group by i)
select doc_id, size, source_size, target, cast(coalesce(n, 0) as bigint) as taken
from q left join taken using (i)
"""


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target`` from (source, size) rows.

    Targets are min(2 * size, weight * level); the level at which they use up the
    budget follows from prefix sums over the sources in the order they are full. It is
    that of the first source it does not fill; those of later ones are lower.
    """
    every = Window.partitionBy()
    full = Window.orderBy(F.col("held") / F.col("w"), F.col("source").asc_nulls_last())
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("held"))
        .withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int")))
        .withColumn("budget", SHARE * F.sum("held").over(every))
        .withColumn("before", F.coalesce(F.sum(MOST * F.col("held")).over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(full.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("before")) / F.col("w_left"))
    )
    level = F.max(F.when(F.col("level") <= MOST * F.col("held") / F.col("w"), F.col("level"))).over(every)
    return s.withColumn("v", F.coalesce(level, F.lit(0.0))).select(
        "source",
        F.col("held").alias("source_size"),
        F.least(MOST * F.col("held"), F.col("w") * F.col("v")).alias("target"),
    )


def queue(rows: DataFrame) -> DataFrame:
    """``rows`` (source, size, u, doc_id, key, ...) with source_size, target and the
    words of the source ahead of the row (``ahead``) in its shuffled order."""
    n = tiles(rows.count())
    # tiles are ranges of the hash, so that order by tile, then by hash, is order by hash
    place = F.conv(F.substring("u", 1, 8), 16, 10).cast("long")
    own = rows.withColumn("tile", F.floor(place * n / float(1 << 32)).cast("long"))
    sums = own.groupBy("source", "tile").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "tile", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    heads = bounded_broadcast(materialize(source_targets(own.select("source", "size"))))
    within = Window.partitionBy("source", "tile").orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    ranked = own.withColumn("upto", F.sum("size").over(within))
    return (
        ranked.alias("a")
        .join(starts.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.tile") == F.col("b.tile")))
        .join(heads.alias("h"), F.col("a.source").eqNullSafe(F.col("h.source")))
        .select("a.*", "h.source_size", "h.target", (F.col("first") + F.col("upto") - F.col("size")).alias("ahead"))
        .drop("tile", "upto")
    )


def packets(queued: DataFrame) -> DataFrame:
    """``row, copy, words, finish`` and the order of the packets of both copies.

    A packet is at most ``PACKET`` words of a document, so that a long document does
    not hold up the other sources; its finish time is that of its last word.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(PACKET).cast("long"))
    each = F.transform(
        starts, lambda s: F.struct(s.alias("at"), F.least(F.lit(PACKET), F.col("size") - s).cast("long").alias("words"))
    )
    copies = F.array(F.lit(0), F.lit(1))
    held = queued.where("size > 0 and target > 0").withColumn("copy", F.explode(copies))
    return held.withColumn("p", F.explode(each)).select(
        "row",
        "copy",
        "u",
        F.col("p.at").alias("at"),
        F.col("p.words").alias("words"),
        ((F.col("ahead") + F.col("copy") * F.col("source_size") + F.col("p.at") + F.col("p.words")) / F.col("target")).alias("finish"),
    )


def served(queued: DataFrame) -> DataFrame:
    """``row, copy, words, finish``: what the mix takes of each copy of a row.

    The packets of all sources are range-sorted by finish time and stored; sums of the
    ranges say where the total budget runs out, and only the range in which it does
    is summed packet by packet. The packet at the cut counts up to it.
    """
    held = queued.agg(F.sum("size").alias("words"), F.sum(F.ceil(F.col("size") / PACKET)).alias("packets")).first()
    budget = int(SHARE * (held["words"] or 0))
    order = ["finish", "u", "copy", "at"]
    in_order = packets(queued).repartitionByRange(tiles(2 * int(held["packets"] or 0)), *order)
    ranges = materialize(in_order.withColumn("range", F.spark_partition_id()))
    sums = ranges.groupBy("range").agg(F.sum("words").alias("n"))
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.select("range", "n", F.sum("n").over(upto).alias("upto"))
    last = ends.where(F.col("upto") > budget).orderBy("range").first()
    whole = ranges if last is None else ranges.where(F.col("range") < last["range"])
    taken = whole.select("row", "copy", "words", "finish")
    if last is not None:
        left = budget - (last["upto"] - last["n"])
        before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        some = ranges.where(F.col("range") == last["range"]).withColumn("sum", F.coalesce(F.sum("words").over(before), F.lit(0)))
        words = F.least("words", F.lit(left) - F.col("sum")).alias("words")
        taken = taken.union(some.where(F.col("sum") < left).select("row", "copy", words, "finish"))
    return taken.groupBy("row", "copy").agg(F.sum("words").alias("words"), F.max("finish").alias("finish"))


def _narrow(docs: DataFrame, *more) -> DataFrame:
    """The rows without their texts, each with a number (``row``), stored."""
    size = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size")
    u = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("u")
    return materialize(docs.select("doc_id", "source", size, u, F.monotonically_increasing_id().alias("row"), *more))


def mix_digest(docs: DataFrame) -> DataFrame:
    """One row per document, without its text: the words that the mix takes of it."""
    queued = materialize(queue(_narrow(docs)))
    words = served(queued).groupBy("row").agg(F.sum("words").alias("taken"))
    taken = F.coalesce("taken", F.lit(0).cast("long")).alias("taken")
    return queued.join(words, "row", "left").select("doc_id", "size", "source_size", "target", taken)


def mix_rows(docs: DataFrame) -> DataFrame:
    """The mixed rows, whole, in the order of their virtual finish time.

    A document that the budget cuts stays whole; one that is taken twice is two rows.
    Queues hold no texts: a row is known by two hashes of all its columns, and its text
    is shuffled to its finish times once and then to its range.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    plain = [F.to_json(F.struct(c)) if "map<" in t or "variant" in t else c for c, (_, t) in zip(columns, docs.dtypes)]
    keys = [F.xxhash64(F.lit(i), *plain).alias(f"k{i}") for i in (1, 2)]
    spark = docs.sparkSession

    def finish_times() -> DataFrame:
        queued = materialize(queue(_narrow(docs, *keys)))
        return served(queued).join(queued.select("row", "u", "k1", "k2"), "row").select("k1", "k2", "finish", "u", "copy")

    times = settled(spark, finish_times)
    texts = docs.select(F.struct(*columns).alias("whole"), *keys).groupBy("k1", "k2").agg(F.first("whole").alias("whole"))
    order = ["finish", "u", "copy"]
    mixed = texts.join(times, ["k1", "k2"]).select("whole", *order)
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).select("whole.*")


@query("op8_mixing", SQL)
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(table(spark, sf_dir, "documents"))
