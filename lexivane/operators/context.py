"""Chunk lookup and neighbour context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivane.config import DEFAULTS
from lexivane.functions.text import let
from lexivane.session import bounded_broadcast


def doc_key_of(chunk_id: Column) -> Column:
    return F.regexp_replace(chunk_id, r":\d+$", "")


def seq_of(chunk_id: Column) -> Column:
    return F.substring_index(chunk_id, ":", -1).cast("int")


def bucket_of(doc_key: Column, n_buckets: int) -> Column:
    """Storage bucket of a document."""
    return F.pmod(F.xxhash64(doc_key), F.lit(n_buckets)).cast("int")


def lookup(ids: DataFrame, chunks: DataFrame, n_buckets: int | None = None, how: str = "inner") -> DataFrame:
    """Joins chunk columns to ``ids`` (rows with ``chunk_id``).

    On a stored index the bucket follows from the id; with a small id list the
    scan then opens only the buckets that hold them.
    """
    keys = ["chunk_id"]
    if n_buckets and "bucket" in chunks.columns:
        keys = ["bucket", "chunk_id"]
        ids = ids.withColumn("bucket", bucket_of(doc_key_of(F.col("chunk_id")), n_buckets))
    if how == "inner":
        return chunks.join(bounded_broadcast(ids), keys).drop("bucket")
    found = chunks.join(bounded_broadcast(ids.select(*keys).distinct()), keys, "left_semi")
    return ids.join(found, keys, how).drop("bucket")


def fetch_chunks(ids: DataFrame, chunks: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """Chunks by id, with score 0 and rank 0; ``found`` is false for unknown ids."""
    present = chunks.withColumn("found", F.lit(True))
    rows = lookup(ids.select("chunk_id").distinct(), present, n_buckets, "left")
    return rows.withColumn("found", F.coalesce("found", F.lit(False))).select(
        "*", F.lit(0.0).alias("score"), F.lit(0).alias("rank")
    )


def _windows(hits: DataFrame, n: int) -> DataFrame:
    """Ids that may lie within ``n`` of each hit, existing or not."""
    key, seq = doc_key_of(F.col("chunk_id")), seq_of(F.col("chunk_id"))
    near = F.sequence(F.greatest(seq - n, F.lit(1)), seq + n)
    return (
        hits.select("query_id", "chunk_id", "rank", "score", key.alias("doc_key"), seq.alias("seq"), F.explode(near).alias("near_seq"))
        .withColumn("near_id", F.concat("doc_key", F.lit(":"), F.col("near_seq").cast("string")))
        .withColumn("offset", F.col("near_seq") - F.col("seq"))
    )


def context_window(hits: DataFrame, chunks: DataFrame, n: int = DEFAULTS.neighbours) -> DataFrame:
    """Every chunk within ``n`` of a hit, once per query, with the best hit it
    belongs to: ``query_id, chunk_id, doc_key, chunk_seq, hit_rank, offset``.

    Neighbour ids are spelled out from the hit, so this is an equality join.
    """
    best = (
        _windows(hits, n)
        .groupBy("query_id", F.col("near_id").alias("chunk_id"))
        .agg(F.min(F.struct("rank", F.abs("offset").alias("d"), "offset")).alias("b"))
        .select("query_id", "chunk_id", F.col("b.rank").alias("hit_rank"), F.col("b.offset").alias("offset"))
    )
    known = chunks.select("chunk_id", "doc_key", "chunk_seq")
    return known.join(bounded_broadcast(best), "chunk_id").select(
        "query_id", "chunk_id", "doc_key", "chunk_seq", "hit_rank", "offset"
    )


def _walk(hits: Column, n: int) -> Column:
    """The reading list of one query, hit by hit.

    A hit that already came in as a neighbour is not added again. Earlier chunks
    go directly before the hit, nearest first; later ones to the end of the
    list. Each direction stops at the first chunk that is missing or listed.
    """

    def has(items: Column, wanted: Column) -> Column:
        return F.exists(items, lambda x: x["chunk_id"] == wanted)

    def entry(cid: Column, score: Column) -> Column:
        return F.struct(cid.alias("chunk_id"), score.cast("double").alias("score"))

    def extend(items: Column, h: Column, ids: Column, place) -> Column:
        """Takes ids in order until one is absent or already listed."""

        def step(acc: Column, cid: Column) -> Column:
            go = acc["go"] & cid.isNotNull() & ~F.coalesce(has(acc["items"], cid), F.lit(False))
            return F.when(
                go,
                F.struct(place(acc["items"], h, entry(cid, F.lit(0.0))).alias("items"), F.lit(True).alias("go")),
            ).otherwise(F.struct(acc["items"].alias("items"), F.lit(False).alias("go")))

        start = F.struct(items.alias("items"), F.lit(True).alias("go"))
        return F.aggregate(ids, start, step, lambda acc: acc["items"])

    def before(items: Column, h: Column, e: Column) -> Column:
        at = F.array_position(F.transform(items, lambda x: x["chunk_id"]), h["chunk_id"]).cast("int")
        return F.concat(F.slice(items, 1, at - 1), F.array(e), F.slice(items, at, F.size(items)))

    def after(items: Column, h: Column, e: Column) -> Column:
        return F.concat(items, F.array(e))

    def step(items: Column, h: Column) -> Column:
        added = F.when(has(items, h["chunk_id"]), items).otherwise(
            F.concat(items, F.array(entry(h["chunk_id"], h["score"])))
        )
        return let(
            added,
            lambda a: let(
                extend(a, h, h["before"], before), lambda b: extend(b, h, h["after"], after)
            ),
        )

    empty = F.array().cast("array<struct<chunk_id:string,score:double>>")
    return F.aggregate(hits, empty, step)


def expand_context(hits: DataFrame, chunks: DataFrame, n: int = DEFAULTS.neighbours) -> DataFrame:
    """``query_id, position, chunk_id, score``: the ordered expansion.

    Per query this holds at most 20 hits with ``2n`` neighbours each.
    """
    near = _windows(hits, n)
    known = chunks.select(F.col("chunk_id").alias("near_id"))
    wanted = near.select("near_id").distinct()
    present = known.join(bounded_broadcast(wanted), "near_id", "left_semi").withColumn("there", F.lit(True))
    found = near.join(present, "near_id", "left").withColumn(
        "near_id", F.when(F.col("there"), F.col("near_id"))
    )

    def side(name: str, sign: int) -> Column:
        """Ids from the nearest on; a missing chunk stays as NULL."""
        picked = F.collect_list(
            F.when(F.signum("offset") == sign, F.struct(F.abs("offset").alias("d"), "near_id"))
        )
        return F.transform(F.array_sort(picked), lambda s: s["near_id"]).alias(name)

    per_hit = found.groupBy("query_id", "rank", "chunk_id", "score").agg(
        side("before", -1), side("after", 1)
    )
    per_query = per_hit.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score", "before", "after"))).alias("h")
    )
    return per_query.select("query_id", F.posexplode(_walk(F.col("h"), n)).alias("p", "e")).select(
        "query_id", (F.col("p") + 1).alias("position"), "e.chunk_id", "e.score"
    )
