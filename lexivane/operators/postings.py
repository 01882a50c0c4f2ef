"""Inverted index tables: postings, vocabulary and corpus statistics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.functions.terms import tokens, with_stems
from lexivane.functions.text import let, unnest
from lexivane.session import materialize

# (rows, name of their text) -> rows with ``embedding``
Embed = Callable[[DataFrame, str], DataFrame]

INDEXED = ("content", "title", "heading_path")
# Positions of one column start this far after the last column's, so that no
# phrase reaches across columns.
COLUMN_GAP = 1 << 28
TILE = 64  # chunks of a tile: the bits of a bitmap
TILE_BITS = 6
DICTIONARY_BLOCK = 256
TOKENS_PER_TASK = 8_000_000  # of those that group postings
HEAD = 3  # letters by which dictionary blocks are found


@dataclass(frozen=True)
class TextIndex:
    """Tables that retrieval reads.

    Chunks are numbered by tile and slot; a tile has up to ``TILE`` of them.
    ``blocks`` has a row for each term and tile: the slots with the term as a bitmap
    (``held``, and ``present`` without deleted chunks), the greatest tf and the least
    length among them, and ``slots``, ``tfs`` and ``positions`` in order of the slots. ``tiles`` names the
    chunks of each slot, ``dictionary`` has the terms by stem in sorted blocks.
    ``fold`` and ``stem`` tell how terms were made, so that queries are analysed the
    same way.
    """

    chunks: DataFrame
    blocks: DataFrame
    dictionary: DataFrame
    tiles: DataFrame
    stats: DataFrame
    embeddings: DataFrame | None = None
    fold: bool = True
    stem: bool = False
    n_buckets: int | None = None
    embed: Embed | None = None  # what made ``embeddings``; None: hashed words
    term_buckets: int = 1

    @property
    def postings(self) -> DataFrame:
        """``term, chunk_id, tf, n_tokens, positions``, a row for each posting."""
        rows = slot_rows(self.blocks, "term", "tile")
        return rows.join(slot_names(self.tiles), ["tile", "slot"]).select("term", "chunk_id", "tf", "n_tokens", "positions")

    @property
    def vocab(self) -> DataFrame:
        """``term, df`` of the terms that chunks have."""
        return self.blocks.groupBy("term").agg(F.sum(F.bit_count("present")).alias("df"))

    @property
    def lengths(self) -> DataFrame:
        return slot_names(self.tiles).select("chunk_id", "n_tokens")


def tokenize(chunks: DataFrame, cols=INDEXED, fold: bool = True, stem: bool = False) -> DataFrame:
    """``chunk_id, col, pos, token``: one row per token occurrence."""
    def of_column(c: str) -> Column:
        return F.transform(
            tokens(F.coalesce(F.col(c), F.lit("")), fold),
            lambda t, i: F.struct(F.lit(c).alias("col"), (i + 1).alias("pos"), t.alias("token")),
        )

    parts = [of_column(c) for c in cols]
    rows = unnest(chunks, F.concat(*parts), "chunk_id").select("chunk_id", "item.*")
    if not stem:
        return rows
    stems = with_stems(rows.select(F.col("token").alias("term")).distinct())
    return rows.join(stems, F.col("token") == F.col("term")).select("chunk_id", "col", "pos", F.col("stem").alias("token"))


def _term_runs(occurrences: Column) -> Column:
    """Sorted ``struct(term, pos)`` list to ``struct(term, tf, positions)``."""

    def build(s: Column, starts: Column) -> Column:
        def one(b: Column, j: Column) -> Column:
            end = F.coalesce(F.get(starts, j + 1), F.size(s))
            run = F.slice(s, b + 1, end - b)
            return F.struct(
                F.get(s, b)["term"].alias("term"),
                (end - b).alias("tf"),
                F.transform(run, lambda o: o["pos"]).alias("positions"),
            )

        return F.transform(starts, one)

    def starts_of(s: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i)["term"] != F.get(s, i - 1)["term"]),
        )

    return let(occurrences, lambda s: let(starts_of(s), lambda starts: build(s, starts)))


def chunk_terms(chunks: DataFrame, cols=INDEXED, fold: bool = True, keep=()) -> DataFrame:
    """``chunk_id, n_tokens, terms``: the terms of each chunk, found in its row."""
    def of_column(n: int, c: str) -> Column:
        return F.transform(
            tokens(F.coalesce(F.col(c), F.lit("")), fold),
            lambda t, i: F.struct(t.alias("term"), (i + 1 + n * COLUMN_GAP).alias("pos")),
        )

    occurrences = F.concat(*[of_column(n, c) for n, c in enumerate(cols)])
    listed = chunks.select("chunk_id", *keep, occurrences.alias("occ"))
    n = F.size("occ")
    return listed.select(
        "chunk_id", *keep, n.alias("n_tokens"), F.when(n > 0, _term_runs(F.sort_array("occ"))).alias("terms")
    )


def postings_of(terms: DataFrame, keep=()) -> DataFrame:
    """``chunk_terms`` rows to postings. The chunk's length travels along, so
    ranking needs no join to fetch it."""
    return unnest(terms, F.col("terms"), "chunk_id", *keep, "n_tokens").select(
        *keep, "item.term", "chunk_id", "item.tf", "n_tokens", "item.positions"
    )


def build_postings(chunks: DataFrame, cols=INDEXED, fold: bool = True) -> DataFrame:
    """``term, chunk_id, tf, n_tokens, positions``. No shuffle."""
    return postings_of(chunk_terms(chunks, cols, fold))


def term_stats(postings: DataFrame) -> DataFrame:
    """``term, df``; counted before the shuffle, so common terms stay cheap."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: ``n_chunks, avgdl`` over all chunks, empty ones included."""
    return lengths.agg(
        F.count(F.lit(1)).alias("n_chunks"), F.avg(F.col("n_tokens").cast("double")).alias("avgdl")
    )


def bucket_of_term(term: Column, n: int) -> Column:
    """Storage bucket of a term."""
    return F.pmod(F.xxhash64(term), F.lit(n)).cast("int")


def with_place(chunks: DataFrame, base: int = 0) -> DataFrame:
    """Adds ``tile`` and ``slot`` by the place of a row in its partition. To be stored at
    once: another run may place rows otherwise."""
    row = F.monotonically_increasing_id()
    return chunks.withColumns({"tile": F.shiftright(row, TILE_BITS) + F.lit(base), "slot": (row % TILE).cast("int")})


def term_blocks(terms: DataFrame, parts: int | None = None) -> DataFrame:
    """Blocks of ``chunk_terms`` rows that carry ``tile`` and ``slot``: grouped by term
    and tile, so at most ``TILE`` postings meet, however common a term is. ``parts``: the
    number of tasks that group, if it is not to be the session's."""
    rows = unnest(terms, F.col("terms"), "tile", "slot", "n_tokens").select("tile", "slot", "n_tokens", "item.*")
    if parts is not None:
        rows = rows.repartition(parts, "term", "tile")
    grouped = rows.groupBy("term", "tile").agg(
        F.bit_or(F.expr("shiftleft(1L, slot)")).alias("held"),
        F.max("tf").alias("max_tf"),
        F.min("n_tokens").alias("min_len"),
        F.sort_array(F.collect_list(F.struct("slot", "tf", "positions"))).alias("hits"),
    )
    return grouped.select(
        "term", "tile", "held", "max_tf", "min_len",
        F.transform("hits", lambda h: h["slot"]).alias("slots"),
        F.transform("hits", lambda h: h["tf"]).alias("tfs"),
        F.transform("hits", lambda h: h["positions"]).alias("positions"),
    )


def block_parts(terms: DataFrame) -> int | None:
    """Tasks for ``term_blocks`` where the session's number would be too small."""
    n = terms.agg(F.sum("n_tokens")).first()[0] or 0
    needed = -(-n // TOKENS_PER_TASK)
    return needed if needed > _usual_parts(terms.sparkSession) else None


def _usual_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_of(spark: SparkSession, n_tokens: int) -> int:
    """Tasks among which so many tokens are dealt out."""
    return max(_usual_parts(spark), -(-n_tokens // TOKENS_PER_TASK))


def tile_ranges(rows: DataFrame, n: int) -> list[Column]:
    """At most ``n`` conditions on ``tile``, one of which each tile meets, with about as
    many of ``rows`` each. Blocks are stored by such ranges, so that most files of others
    are passed over."""
    ends = rows.approxQuantile("tile", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    ends = [None, *sorted({int(x) for x in ends}), None]
    tile, ranges = F.col("tile"), []
    for lo, hi in zip(ends, ends[1:]):
        after = F.lit(True) if lo is None else tile > lo
        ranges.append(after if hi is None else after & (tile <= hi))
    return ranges


def token_counts(blocks: DataFrame) -> DataFrame:
    """``tile, slot, n_tokens`` of the chunks that have tokens."""
    rows = slot_rows(blocks.select("tile", "held", "slots", "tfs"), "tile", wanted="held")
    return rows.groupBy("tile", "slot").agg(F.sum("tf").cast("int").alias("n_tokens"))


def slots_of(bitmap: str) -> Column:
    """The slots of a bitmap, ascending."""
    return F.expr(f"filter(sequence(0, {TILE - 1}), s -> (shiftright({bitmap}, s) & 1L) = 1L)")


def slot_rows(blocks: DataFrame, *keep, wanted: str = "present") -> DataFrame:
    """``keep, slot, tf, positions``: the postings of blocks whose bit is in ``wanted``."""
    lists = [c for c in ("slots", "tfs", "positions") if c in blocks.columns]
    some = blocks.where(F.col(wanted).bitwiseAND(F.col("held")) != 0)
    rows = some.select(*keep, F.col(wanted).alias("_wanted"), F.explode(F.arrays_zip(*lists)).alias("h"))
    live = rows.where(F.expr("(shiftright(_wanted, h.slots) & 1L) = 1L"))
    names = {"slots": "slot", "tfs": "tf", "positions": "positions"}
    return live.select(*keep, *[F.col(f"h.{c}").alias(names[c]) for c in lists])


def tiles_of(terms: DataFrame) -> DataFrame:
    """``tile, held, chunk_ids, lens``: what stands in each slot."""
    listed = F.sort_array(F.collect_list(F.struct("slot", "chunk_id", "n_tokens")))
    grouped = terms.groupBy("tile").agg(F.bit_or(F.expr("shiftleft(1L, slot)")).alias("held"), listed.alias("l"))
    return grouped.select(
        "tile", "held", F.transform("l", lambda x: x["chunk_id"]).alias("chunk_ids"), F.transform("l", lambda x: x["n_tokens"]).alias("lens")
    )


def slot_names(tiles: DataFrame) -> DataFrame:
    """``tile, slot, chunk_id, n_tokens`` of the chunks that are not deleted."""
    zipped = F.arrays_zip(slots_of("held").alias("slot"), "chunk_ids", "lens")
    rows = tiles.select("tile", "present", F.explode(zipped).alias("h")).where(F.expr("(shiftright(present, h.slot) & 1L) = 1L"))
    return rows.select("tile", F.col("h.slot").alias("slot"), F.col("h.chunk_ids").alias("chunk_id"), F.col("h.lens").alias("n_tokens"))


def dictionary_of(terms: DataFrame, stem: bool = False) -> DataFrame:
    """``first, last, heads, entries``: distinct terms in blocks, in the order of their
    stems. ``heads`` are the beginnings of up to ``HEAD`` letters that the block has."""
    distinct = terms.select("term").distinct()
    keyed = with_stems(distinct) if stem else distinct.withColumn("stem", F.col("term"))
    ordered = keyed.repartitionByRange("stem", "term").sortWithinPartitions("stem", "term")
    placed = ordered.withColumn("block", F.floor(F.monotonically_increasing_id() / DICTIONARY_BLOCK))
    entries = F.sort_array(F.collect_list(F.struct("stem", "term"))).alias("entries")
    heads = F.array_distinct(F.flatten(F.collect_set(F.array(*[F.left("stem", F.lit(n)) for n in range(1, HEAD + 1)])))).alias("heads")
    return placed.groupBy("block").agg(F.min("stem").alias("first"), F.max("stem").alias("last"), heads, entries).drop("block")


def corpus_sums(tiles: DataFrame) -> DataFrame:
    """One row: ``n_chunks, avgdl`` of the chunks that are not deleted."""
    kept = F.expr("aggregate(filter(arrays_zip(_s, lens), h -> (shiftright(present, h._s) & 1L) = 1L), 0L, (a, h) -> a + h.lens)")
    rows = tiles.withColumn("_s", slots_of("held")).select(F.bit_count("present").cast("long").alias("n"), kept.alias("t"))
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n_chunks"), (F.sum("t") / F.sum("n")).alias("avgdl"))


def derive_index(chunks: DataFrame, fold: bool = True, stem: bool = False) -> TextIndex:
    """Index tables as plans over ``chunks``, of which only the places are stored."""
    terms = materialize(chunk_terms(materialize(with_place(chunks)), fold=fold, keep=("tile", "slot")))
    blocks = materialize(term_blocks(terms)).withColumns({"present": F.col("held"), "term_bucket": F.lit(0)})
    tiles = tiles_of(terms).withColumn("present", F.col("held"))
    return TextIndex(chunks, blocks, dictionary_of(blocks, stem), tiles, corpus_sums(tiles), None, fold, stem)
