"""Keyword search: every term required, prefixes expanded, BM25 order.

Small sides of joins are stored tables here, so Spark knows their sizes and broadcasts
those below its own threshold.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivane.config import BM25_B, BM25_K1, BM25_MIN_IDF, DEFAULTS
from lexivane.functions.terms import query_terms, stemmed
from lexivane.functions.text import unnest
from lexivane.operators.postings import HEAD, TextIndex, bucket_of_term, slot_names, slot_rows, slots_of, tile_ranges
from lexivane.session import bounded_broadcast, freed_shuffles, materialize, materialize_in_turn

ROUNDS = 16  # in which the tiles are read, at most
CHUNKS_PER_ROUND = 32_768  # where that takes fewer


def parse_query(queries: DataFrame) -> DataFrame:
    """``query_id, pos, term, is_prefix`` of every required term."""
    return unnest(queries, query_terms(F.col("q")), "query_id").select(
        "query_id", "pos", F.col("item.raw").alias("term"), "item.is_prefix"
    )


def query_units(queries: DataFrame, stem: bool = False) -> DataFrame:
    """``query_id, unit, parts, is_prefix, weight, n_units``.

    A unit is what is looked up: a word, a prefix or a phrase. Equal units of
    different queries are matched once. ``weight`` counts repeats in a query.
    A query with a term that holds no word at all matches nothing; it has no
    rows here.
    """
    terms = unnest(queries, query_terms(F.col("q")), "query_id").select(
        "query_id", "item.parts", "item.is_prefix"
    )
    if stem:  # of the questions alone; the index keeps terms, and their stems in its dictionary
        terms = terms.withColumn("parts", stemmed(F.col("parts")))
    unit = F.concat(F.array_join("parts", " "), F.when(F.col("is_prefix"), "*").otherwise(""))
    grouped = (
        terms.withColumn("unit", unit)
        .groupBy("query_id", "unit")
        .agg(
            F.first("parts").alias("parts"),
            F.first("is_prefix").alias("is_prefix"),
            F.count(F.lit(1)).alias("weight"),
        )
    )
    per_query = Window.partitionBy("query_id")
    return (
        grouped.withColumn("n_units", F.count(F.lit(1)).over(per_query))
        .withColumn("_empty", F.max((F.size("parts") == 0).cast("int")).over(per_query))
        .filter("_empty = 0")
        .drop("_empty")
    )


def prefix_expand(prefixes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``prefix`` -> ``prefix, term`` for every term whose stem begins with it."""
    wanted = prefixes.select(F.col("prefix").alias("wanted"), F.lit(True).alias("is_prefix")).distinct()
    return _look_up(wanted, dictionary).select(F.col("wanted").alias("prefix"), "term")


def _look_up(wanted: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``wanted, is_prefix, term`` of (wanted, is_prefix) rows.

    A dictionary block is sorted and knows its first and last stem. Blocks are met by
    the first letters, then by their ends; only the entries of these are compared, so
    the vocabulary is never unnested.
    """
    head = F.left("wanted", F.lit(HEAD))
    asked = bounded_broadcast(wanted.withColumn("head", head))
    named = dictionary.select("first", "last", "entries", F.explode("heads").alias("head"))
    past = F.when(F.col("is_prefix"), F.concat("wanted", F.lit("\U0010ffff"))).otherwise(F.col("wanted"))
    met = named.join(asked, "head").where((F.col("last") >= F.col("wanted")) & (F.col("first") <= past))
    fits = F.filter(
        "entries",
        lambda e: (e["stem"] == F.col("wanted")) | (F.col("is_prefix") & e["stem"].startswith(F.col("wanted"))),
    )
    rows = met.select("wanted", "is_prefix", F.explode(fits).alias("e"))
    return rows.select("wanted", "is_prefix", F.col("e.term").alias("term")).distinct()


def expand_units(units: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``unit, n_parts, part_pos, term``: index terms of each part of a unit."""
    parts = units.select(
        "unit", F.size("parts").alias("n_parts"), "is_prefix", F.posexplode("parts").alias("part_pos", "wanted")
    ).withColumn("is_prefix", F.col("is_prefix") & (F.col("part_pos") == F.col("n_parts") - 1))
    found = _look_up(parts.select("wanted", "is_prefix").distinct(), dictionary)
    return parts.join(found, ["wanted", "is_prefix"]).select("unit", "n_parts", "part_pos", "term")


def asked_blocks(expanded: DataFrame, index: TextIndex, buckets: list[int], *columns: str) -> DataFrame:
    """The blocks of the terms of ``expanded`` with its columns. Buckets of terms that
    nobody asks for are not opened."""
    rows = index.blocks.where(F.col("term_bucket").isin(buckets)).select("term_bucket", "term", "tile", *columns)
    return rows.join(expanded, ["term_bucket", "term"]).drop("term_bucket")


def in_rounds(index: TextIndex) -> list[tuple[Column, TextIndex]]:
    """The index by ranges of tiles. Its blocks are joined and grouped range by range, so
    that what is shuffled for it at a time is at most about a ``ROUNDS``-th of them."""
    n = index.tiles.agg(F.sum(F.bit_count("present"))).first()[0] or 0
    ranges = tile_ranges(index.tiles, max(1, min(ROUNDS, -(-n // CHUNKS_PER_ROUND))))
    return [(r, replace(index, blocks=index.blocks.where(r), tiles=index.tiles.where(r))) for r in ranges]


_BITS = ("present", "max_tf", "min_len")


def unit_tiles(expanded: DataFrame, index: TextIndex, buckets: list[int], any_phrase: bool) -> tuple[DataFrame, DataFrame | None]:
    """``unit, tile, present, max_tf, min_len``, and the hits (unit, tile, slot, f) of
    phrases, if there are any.

    The chunks that have a unit are the union of its terms' bitmaps; postings
    themselves are read for phrases alone, where all parts are in one chunk.
    """
    both = {"max_tf": F.sum("max_tf").alias("max_tf"), "min_len": F.min("min_len").alias("min_len")}
    single = (
        asked_blocks(expanded.where("n_parts = 1"), index, buckets, *_BITS)
        .groupBy("unit", "tile")
        .agg(F.bit_or("present").alias("present"), *both.values())
    )
    phrases = expanded.where("n_parts > 1")
    if not any_phrase:
        return single, None
    parts = asked_blocks(phrases, index, buckets, *_BITS).groupBy("unit", "n_parts", "part_pos", "tile").agg(
        F.bit_or("present").alias("present"), F.min("min_len").alias("min_len")
    )
    maybe = (
        parts.groupBy("unit", "tile")
        .agg(F.count(F.lit(1)).alias("n"), F.max("n_parts").alias("n_parts"), F.bit_and("present").alias("wanted"), F.min("min_len").alias("min_len"))
        .where("n = n_parts and wanted <> 0")
    )
    maybe = materialize(maybe.select("unit", "tile", "wanted", "min_len"))
    opened = asked_blocks(phrases, index, buckets, "held", "slots", "tfs", "positions").join(maybe, ["unit", "tile"])
    starts = (
        slot_rows(opened, "unit", "tile", "n_parts", "part_pos", "min_len", wanted="wanted")
        .select("unit", "tile", "slot", "n_parts", "min_len", F.explode(F.transform("positions", lambda p: p - F.col("part_pos"))).alias("start"))
        .groupBy("unit", "tile", "slot", "start")
        .agg(F.count(F.lit(1)).alias("found"), F.max("n_parts").alias("n_parts"), F.min("min_len").alias("min_len"))
        .where("found = n_parts")
    )
    hits = starts.groupBy("unit", "tile", "slot").agg(F.count(F.lit(1)).alias("f"), F.min("min_len").alias("min_len"))
    hits = materialize(hits)
    found = hits.groupBy("unit", "tile").agg(
        F.bit_or(F.expr("shiftleft(1L, slot)")).alias("present"), F.max("f").alias("max_tf"), F.min("min_len").alias("min_len")
    )
    return single.unionByName(found), hits.drop("min_len")


def idf(n_rows: Column, n_hits: Column) -> Column:
    raw = F.log((n_rows - n_hits + 0.5) / (n_hits + 0.5))
    return F.when(raw <= 0, F.lit(BM25_MIN_IDF)).otherwise(raw)


@dataclass(frozen=True)
class Matches:
    """What all of a query's terms are in, by tile: ``tiles`` has query_id, tile, the
    matching slots (``present``) and a bound no score of the tile exceeds."""

    tiles: DataFrame
    units: DataFrame  # query_id, unit, weight, n_units, n_hits
    expanded: DataFrame
    buckets: list[int]  # those of the asked terms
    phrases: DataFrame | None


def matching_tiles(queries: DataFrame, index: TextIndex, bound: Column | None = None, rounds=None) -> Matches:
    """Boolean AND of all units of each query, as an AND of bitmaps.

    A query's tiles are those of its rarest unit; the other units are looked up for
    just these by (unit, tile), so common words neither multiply rows nor crowd a task.
    ``bound``: the greatest part of a score that a unit can have in a tile. ``rounds``: the
    index by ``in_rounds``, where that is known.
    """
    # Read several times below, so each step is computed once and stored.
    qu = materialize(query_units(queries, index.stem))
    units = qu.select("unit", "parts", "is_prefix").dropDuplicates(["unit"])
    bucket = bucket_of_term(F.col("term"), index.term_buckets)
    expanded = bounded_broadcast(materialize(expand_units(units, index.dictionary).withColumn("term_bucket", bucket)))
    asked = expanded.groupBy("term_bucket").agg(F.max("n_parts").alias("n")).collect()  # at most term_buckets
    buckets, any_phrase = [r["term_bucket"] for r in asked], any(r["n"] > 1 for r in asked)
    rounds = rounds or in_rounds(index)
    found = [unit_tiles(expanded, part, buckets, any_phrase) for _, part in rounds]
    held = materialize_in_turn(rows for rows, _ in found)
    phrases = reduce(DataFrame.unionByName, [hits for _, hits in found]) if any_phrase else None
    counts = held.groupBy("unit").agg(F.sum(F.bit_count("present")).alias("n_hits"))
    known = qu.drop("parts", "is_prefix").join(counts, "unit")
    whole = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    ranked = materialize(known.withColumn("_n", whole).where("_n = n_units").drop("_n"))
    rarest = ranked.groupBy("query_id").agg(F.min_by("unit", F.struct("n_hits", "unit")).alias("unit"))
    candidates = held.join(rarest, "unit").select("query_id", "tile")
    parts = candidates.join(ranked, "query_id").join(held, ["unit", "tile"])
    tiles = (
        parts.groupBy("query_id", "tile")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("n_units").alias("n_units"),
            F.bit_and("present").alias("present"),
            F.sum(F.lit(0.0) if bound is None else bound).alias("bound"),
        )
        .where("n = n_units and present <> 0")
        .drop("n", "n_units")
    )
    return Matches(tiles, ranked, expanded, buckets, phrases)


def match_all_terms(queries: DataFrame, index: TextIndex) -> DataFrame:
    """``query_id, chunk_id`` of chunks that hold every term of the query."""
    tiles = matching_tiles(queries, index).tiles.withColumn("slot", F.explode(slots_of("present")))
    return tiles.join(slot_names(index.tiles), ["tile", "slot"]).select("query_id", "chunk_id")


def _part(f: Column, length: Column, weight_idf: Column, avgdl: Column, k1: float, b: float) -> Column:
    return weight_idf * (f * (k1 + 1) / (f + k1 * (1 - b + b * length / avgdl)))


def first_tiles(tiles: DataFrame, k: int) -> DataFrame:
    """The ``k`` tiles of greatest bound of each query. A tile has one match at least,
    so they have ``k`` matches or all."""
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "tile")
    return tiles.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def score_tiles(tiles: DataFrame, matches: Matches, index: TextIndex, weight_idf: Column, avgdl: float, k1: float, b: float, digits: int | None) -> DataFrame:
    """``query_id, chunk_id, score`` of all matches in ``tiles``; only the postings of
    the asked terms in these tiles are read."""
    pairs = tiles.select("query_id", "tile", "present").join(matches.units.select("query_id", "unit"), "query_id")
    wanted = pairs.groupBy("unit", "tile").agg(F.bit_or("present").alias("wanted"))
    wanted = materialize(wanted)
    opened = asked_blocks(matches.expanded.where("n_parts = 1"), index, matches.buckets, "held", "present", "slots", "tfs").join(
        wanted, ["unit", "tile"]
    )
    live = opened.withColumn("wanted", F.col("wanted").bitwiseAND(F.col("present")))
    found = slot_rows(live, "unit", "tile", wanted="wanted").groupBy("unit", "tile", "slot").agg(F.sum("tf").cast("long").alias("f"))
    if matches.phrases is not None:
        found = found.unionByName(matches.phrases.join(wanted.select("unit", "tile"), ["unit", "tile"], "left_semi"))
    slots = tiles.select("query_id", "tile", F.explode(slots_of("present")).alias("slot"))
    names = index.tiles.join(tiles.select("tile").distinct(), "tile", "left_semi")
    total = F.sum(_part(F.col("f"), F.col("n_tokens"), weight_idf, F.lit(avgdl), k1, b))
    return (
        slots.join(slot_names(names), ["tile", "slot"])
        .join(matches.units, "query_id")
        .join(found, ["unit", "tile", "slot"])
        .groupBy("query_id", "chunk_id")
        .agg((total if digits is None else F.round(total, digits)).alias("score"))
    )


def bm25_topk(
    queries: DataFrame,
    index: TextIndex,
    k: int = DEFAULTS.top_k_keyword,
    k1: float = BM25_K1,
    b: float = BM25_B,
    digits: int | None = None,
) -> DataFrame:
    """``query_id, chunk_id, score, rank`` of the best ``k`` chunks per query. With
    ``digits`` scores are rounded before they are ranked.

    First the ``k`` tiles of greatest bound are scored, then those others whose bound
    reaches the score at ``k``, in rounds. The rest cannot be among the
    best and their postings are not read.
    """
    with freed_shuffles(queries.sparkSession):
        sums = index.stats.first()
        avgdl = sums["avgdl"] or 0.0
        weight_idf = F.col("weight") * idf(F.lit(sums["n_chunks"]), F.col("n_hits"))
        bound = _part(F.col("max_tf"), F.col("min_len"), weight_idf, F.lit(avgdl), k1, b)
        rounds = in_rounds(index)
        matches = matching_tiles(queries, index, bound, rounds)
        tiles = materialize(matches.tiles)
        first = materialize(first_tiles(tiles, k))

        def best(some: DataFrame) -> DataFrame:
            scored = (score_tiles(some.where(r), matches, part, weight_idf, avgdl, k1, b, digits) for r, part in rounds)
            return materialize_in_turn(top_ranked(rows, k).drop("rank") for rows in scored)

        found = materialize(top_ranked(best(first), k))
        second = materialize(open_tiles(tiles, first, found, k, digits))
        if second.limit(1).count():
            found = top_ranked(found.drop("rank").unionByName(best(second)), k)
    return found


def open_tiles(tiles: DataFrame, first: DataFrame, found: DataFrame, k: int, digits: int | None) -> DataFrame:
    """The tiles beyond ``first`` that may hold one of the best ``k``, by their bound."""
    least = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    slack = 1e-9 if digits is None else 10.0**-digits  # sums in another order, rounding
    rest = tiles.join(first.select("query_id", "tile"), ["query_id", "tile"], "left_anti")
    return rest.join(least, "query_id").where(F.col("bound") * (1 + 1e-9) + slack >= F.col("least")).drop("least")


def top_ranked(scored: DataFrame, k: int) -> DataFrame:
    """Best ``k`` rows per query by score, then id. Each task keeps its own best
    ``k`` before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
