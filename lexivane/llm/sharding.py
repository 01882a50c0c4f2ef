"""Shards of near equal bytes, cut at sampled splitters of a text key.

Records are ordered by a hash of their text, so equal texts stand side by side and
stay in one shard. The cuts come from size-weighted samples: a first sample makes
``RANGES`` ranges whose bytes are then counted exactly; a range that holds a cut is
overfull for it and is subdivided by a sample of its own, until the piece around
the cut is small or is one text. A text whose copies exceed ``GROUP_LIMIT`` of a
shard is subdivided too, by a hash of the document id.

Only samples of about ``DRAWS`` draws and the sums of ranges reach the driver.

Null or empty text: one byte, checksum 0. Null ids: ordinary rows. Repeated rows:
each has a slot. Empty table: no rows. Columns of other names are ignored by
``shard_digest`` and kept by ``shard_rows``; ``shard``, ``slot`` of the input are replaced.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexivane.llm.common import query, table, text_or_empty, tiles
from lexivane.session import materialize

RANGES = 128
DRAWS = 8192
FINE = 0.002  # of a shard: a cut this near to its place is not refined
GROUP_LIMIT = 0.25  # of a shard: larger groups of equal texts may be cut
ROUNDS = 8

KEY, PLACE, SIZE = "key", "place", "bytes"


def keyed(docs: DataFrame) -> DataFrame:
    """Adds the sort key, a place among equal keys, and the size."""
    text = text_or_empty()
    return docs.withColumns(
        {
            KEY: F.xxhash64(text),
            PLACE: F.xxhash64(F.col("doc_id").cast("string"), F.lit(1)),
            SIZE: F.octet_length(text).cast("long") + 1,
        }
    )


def _draw(rows: DataFrame, groups: list[str], bytes_by: dict, draws: int) -> dict:
    """Size-weighted key samples: {group: [(key, draws)]} in order of the key.

    A row is drawn floor(size * rate + u) times, ``u`` a hash of the row in [0, 1).
    """
    rate = F.lit(0.0)
    for g, total in bytes_by.items():
        rate = F.when(F.col(groups[0]) == g, F.lit(draws / max(total, 1))).otherwise(rate) if groups else F.lit(draws / max(total, 1))
    u = F.pmod(F.xxhash64(KEY, PLACE), F.lit(1 << 30)) / float(1 << 30)
    hits = rows.withColumn("n", F.floor(F.col(SIZE) * rate + u).cast("long")).where("n > 0")
    out: dict = {}
    for r in hits.groupBy(*groups, KEY).agg(F.sum("n").alias("n")).collect():
        out.setdefault(r[groups[0]] if groups else None, []).append((r[KEY], r["n"]))
    return {g: sorted(x) for g, x in out.items()}


def _splitters(sample: list[tuple[int, int]], n: int) -> list[int]:
    """At most n - 1 keys that cut the sample's draws into equal parts."""
    total, cuts, seen = sum(x for _, x in sample), [], 0
    for key, x in sample:
        if seen and seen * n // total > len(cuts):
            cuts += [key] * (seen * n // total - len(cuts))
        seen += x
    return sorted(set(cuts))


def _search(key: Column, cuts: list[int], low: int = 0) -> Column:
    """How many of ``cuts`` are at or below ``key``: a binary search as CASE."""
    if not cuts:
        return F.lit(low)
    m = len(cuts) // 2
    return F.when(key < F.lit(cuts[m]), _search(key, cuts[:m], low)).otherwise(_search(key, cuts[m + 1 :], low + m + 1))


def _sums(rows: DataFrame, groups: list[str]) -> list[tuple]:
    """(first key, last key, bytes) of each range, in key order."""
    got = rows.groupBy(*groups).agg(F.min(KEY).alias("a"), F.max(KEY).alias("z"), F.sum(SIZE).alias("b")).collect()
    return sorted((r["a"], r["z"], r["b"]) for r in got)


def boundaries(rows: DataFrame, n_shards: int) -> list[tuple[int, int | None]]:
    """Ascending cuts (key, place): a row is at or past a cut if its key is larger,
    or is equal and its place is not below the cut's (None: all places are past)."""
    total = rows.agg(F.sum(SIZE)).first()[0]
    if not total or n_shards < 2:
        return []
    share = total / n_shards
    cuts = _splitters(_draw(rows, [], {None: total}, DRAWS).get(None, []), RANGES)
    pieces = _sums(rows.withColumn("r", _search(F.col(KEY), cuts)), ["r"])
    wanted = [share * j for j in range(1, n_shards)]
    for _ in range(ROUNDS):
        starts, seen = [], 0
        for p in pieces:
            starts.append(seen)
            seen += p[2]
        ends = [s + p[2] for s, p in zip(starts, pieces)]
        at = [min(bisect_left(ends, w), len(pieces) - 1) for w in wanted]
        rough = {i for w, i in zip(wanted, at) if pieces[i][0] < pieces[i][1] and min(w - starts[i], ends[i] - w) > FINE * share}
        if not rough:
            break
        todo = sorted(rough)
        inside = F.lit(-1)
        for i in todo:
            inside = F.when(F.col(KEY).between(pieces[i][0], pieces[i][1]), F.lit(i)).otherwise(inside)
        part = rows.withColumn("p", inside).where("p >= 0")
        drawn = _draw(part, ["p"], {i: pieces[i][2] for i in todo}, max(64, DRAWS // len(todo)))
        finer = F.lit(0)
        for i in todo:
            own = _splitters(drawn.get(i, []), 64) or [pieces[i][1]]
            if own[0] == pieces[i][0]:
                own = [*own[1:], pieces[i][1]]
            finer = F.when(F.col("p") == i, _search(F.col(KEY), sorted(set(own)))).otherwise(finer)
        pieces = sorted([p for i, p in enumerate(pieces) if i not in rough] + _sums(part.withColumn("r", finer), ["p", "r"]))
    out: list[tuple[int, int | None]] = []
    for w, i in zip(wanted, at):
        first, last, held = pieces[i]
        if first == last and held > GROUP_LIMIT * share:  # one text, too large to stay whole
            part = (w - starts[i]) / held
            out.append((first, int(part * 2.0**64 - 2.0**63) if 0 < part < 1 else None))
        elif w - starts[i] <= ends[i] - w or i + 1 == len(pieces):
            out.append((first, None))
        else:
            out.append((pieces[i + 1][0], None))
    return sorted(out, key=lambda c: (c[0], -(1 << 64) if c[1] is None else c[1]))


def shard_of(cuts: list[tuple[int, int | None]]) -> Column:
    past = F.lit(0)
    for key, place in cuts:
        at = F.col(KEY) >= F.lit(key)
        if place is not None:
            at = (F.col(KEY) > F.lit(key)) | ((F.col(KEY) == F.lit(key)) & (F.col(PLACE) >= F.lit(place)))
        past = past + at.cast("int")
    return past


def number_rows(rows: DataFrame, n_rows: int, n_shards: int) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard.

    A shard is numbered tile by tile; the tiles' first slots come from their counts,
    so no task orders a whole shard.
    """
    rows = rows.withColumn("tile", F.pmod(F.xxhash64(KEY, PLACE, F.lit(3)), F.lit(tiles(n_rows, n_shards))))
    tile = ["shard", "tile"]
    ahead = Window.partitionBy("shard").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        rows.groupBy(*tile)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*tile, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    )
    rank = F.row_number().over(Window.partitionBy(*tile).orderBy(KEY, PLACE))
    return (
        rows.withColumn("rank", rank)
        .join(firsts, tile)
        .withColumn("slot", (F.col("first") + F.col("rank") - 1).cast("long"))
        .drop("tile", "rank", "first")
    )


def shard_digest(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """One row per document, without its text: the place it is stored at."""
    digest = materialize(
        keyed(docs).select("doc_id", KEY, PLACE, SIZE, F.crc32(text_or_empty().cast("binary")).alias("text_crc32"))
    )
    placed = digest.withColumn("shard", shard_of(boundaries(digest, n_shards)))
    return number_rows(placed, digest.count(), n_shards).select(
        "doc_id",
        F.col(SIZE).alias("size"),
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_rows(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """The rows themselves with ``shard`` and ``slot``."""
    docs = docs.drop("shard", "slot")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = keyed(docs.select(whole, "doc_id", "text")).select("row", KEY, PLACE, SIZE)
    digest = materialize(rows.select(KEY, PLACE, SIZE))
    placed = rows.withColumn("shard", shard_of(boundaries(digest, n_shards)))
    return number_rows(placed, digest.count(), n_shards).select("row.*", "shard", "slot")


@query("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(table(spark, sf_dir, "documents"))
