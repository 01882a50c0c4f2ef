"""Benchmark items in training texts: n-gram seeds, then Smith-Waterman scores.

Words are runs of letters and digits in lower case. An item's seeds are its three-word
windows, and all of them are looked up in every text: the more a part of an item is
copied, the more common its seeds are, so none may be left out for that. Items too few
of whose words are in the text, or around the hits, cannot reach the score and are not
aligned. Around the other hits the text's words are aligned with the item's words: ``MATCH`` for equal words, ``MISS`` and ``GAP``
otherwise. A text holds the item if the best local score reaches ``LEAST`` of the
score of the whole item, and that of ``LEAST_WORDS`` equal words or of the whole item.

Items are taken in blocks of about ``BLOCK_WORDS`` words, which bound what is sent to
the executors; each block is held against all texts, and nothing is shuffled.

Null or empty texts and items without a word: never a leak. Null ids are kept as they
are. Repeated rows are judged one by one; repeated items count as one. Items of fewer
than three words are one seed. Empty tables give no leak. Columns of other names are
ignored by ``leaks`` and kept by ``without_leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.llm import hashing
from lexivane.llm.common import fresh, query, table
from lexivane.session import materialize, ship_package

SEED = 3
MATCH, MISS, GAP = 2, -1, -1
LEAST = 0.5
LEAST_WORDS = 8
BLOCK_WORDS = 1_000_000


@dataclass
class Block:
    """Items with their words, and the seeds to look up, sorted by hash."""

    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray  # sorted; one entry for each (seed, item, place in the item)
    item: np.ndarray
    place: np.ndarray


def read_block(rows) -> Block:
    ids, words, seeds, item, place = [r["item_id"] for r in rows], [], [], [], []
    texts = pa.array([r["text"] for r in rows], pa.large_string())
    for i, (_, h, _, _) in enumerate(hashing.batch_words(texts, hashing.NOT_ALNUM)):
        g = hashing.grams(h, SEED)
        words.append(h)
        seeds.append(g)
        item.append(np.full(len(g), i))
        place.append(np.arange(len(g)))
    if not seeds:
        return Block([], [], *[np.zeros(0, np.int64)] * 3)
    s = np.concatenate(seeds)
    order = np.argsort(s, kind="stable")
    return Block(ids, words, s[order], np.concatenate(item)[order], np.concatenate(place)[order])


def _hits(block: Block, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the text, rows of the block's seeds) of all matches."""
    g = hashing.grams(h, SEED)
    low = np.searchsorted(block.seeds, g)
    at = np.flatnonzero(block.seeds[np.minimum(low, len(block.seeds) - 1)] == g) if len(block.seeds) else np.zeros(0, np.int64)
    low = low[at]
    n = np.searchsorted(block.seeds, g[at], "right") - low
    seed = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(at, n), seed


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local score of two word sequences, and where in ``text`` it ends.

    One item word at a time; gaps along the text are a running maximum.
    """
    slope = np.arange(len(text) + 1) * -GAP
    row, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for w in item:
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(text == w, MATCH, MISS))
        row = np.maximum.accumulate(new + slope) - slope
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def _least(m: int) -> int:
    """Equal words that an item of ``m`` words needs to be found."""
    return max(-(-int(LEAST * MATCH * m * 2) // (2 * MATCH)), min(m, LEAST_WORDS))


def align(item: np.ndarray, text: np.ndarray, starts: np.ndarray) -> tuple[int, int]:
    """Best score near the places where the item would start, and where it ends; places
    around which too few words are the item's are left out, as they cannot reach it."""
    m, best, end = len(item), 0, 0
    starts = np.unique(starts)
    for s in starts:  # an exact copy needs no table
        if s >= 0 and s + m <= len(text) and text[s] == item[0] and np.array_equal(text[s : s + m], item):
            return MATCH * m, int(s) + m
    slack, low, high = m // 2 + 2, None, None
    spans = []
    for s in starts:
        a, z = max(0, int(s) - slack), min(len(text), int(s) + m + slack)
        if low is not None and a <= high:
            high = max(high, z)
        else:
            if low is not None:
                spans.append((low, high))
            low, high = a, z
    words = np.unique(item)
    for a, z in [*spans, (low, high)]:
        own = text[a:z]
        shared = words[np.minimum(np.searchsorted(words, own), len(words) - 1)] == own
        # each equal word of an alignment takes one word of the text and one of the item
        if shared.sum() < _least(m) or np.isin(item, own[shared]).sum() < _least(m):
            continue
        score, at = smith_waterman(item, own)
        if score > best:
            best, end = score, a + at
    return best, end


def found(block: Block, h: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(item, seeds hit, score, end) of each item that the text's words hold."""
    at, seed = _hits(block, h)
    if not len(at):
        return
    order = np.argsort(block.item[seed], kind="stable")
    at, seed = at[order], seed[order]
    items, first = np.unique(block.item[seed], return_index=True)
    # items of which enough words are anywhere in the text
    size = np.array([len(block.words[i]) for i in items])
    every, own = np.unique(h), np.concatenate([block.words[i] for i in items])
    met = every[np.minimum(np.searchsorted(every, own), len(every) - 1)] == own
    met = np.add.reduceat(met.astype(np.int64), np.cumsum(size) - size)
    edge = np.append(first, len(at))
    for k, i in enumerate(items):
        words = block.words[i]
        m = len(words)
        if met[k] < _least(m):
            continue
        own = slice(edge[k], edge[k + 1])
        score, end = align(words, h, at[own] - block.place[seed[own]])
        if score >= LEAST * MATCH * m and score >= MATCH * min(m, LEAST_WORDS):
            yield int(i), len(np.unique(seed[own])), score, end


def _find(shared, id_type):
    def run(batches):
        block = shared.value
        for batch in batches:
            docs, out = [], []
            for k, (_, h, _, _) in enumerate(hashing.batch_words(batch.column("text"), hashing.NOT_ALNUM)):
                for i, n, score, end in found(block, h):
                    docs.append(k)
                    out.append((block.ids[i], n, score, score / (MATCH * len(block.words[i])), end))
            cols = list(zip(*out)) or [()] * 5
            kinds = (id_type, pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(docs, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, kinds)]],
                ["doc_id", "item_id", "n_seeds", "score", "score_ratio", "end_word"],
            )

    return run


def _clean(shared, names):
    def run(batches):
        block = shared.value
        for batch in batches:
            words = hashing.batch_words(batch.column(len(names)), hashing.NOT_ALNUM)
            keep = [next(found(block, h), None) is None for _, h, _, _ in words]
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    return run


def _lower():
    return F.lower(F.col("text").cast("string"))


def blocks(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """Broadcast blocks of items with their seeds."""
    spark = docs.sparkSession
    ship_package(spark)
    items = benchmark.select("item_id", _lower().alias("text")).distinct()
    items = materialize(items.withColumn("n", F.size(F.split("text", " "))))
    total = items.agg(F.sum("n")).first()[0]
    n = -(-(total or 0) // BLOCK_WORDS)
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        yield spark.sparkContext.broadcast(read_block(rows))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_seeds, score, score_ratio, end_word`` of each leak."""
    kinds = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("item_id", benchmark.schema["item_id"].dataType),
            *[T.StructField(c, T.LongType()) for c in ("n_seeds", "score")],
            T.StructField("score_ratio", T.DoubleType()),
            T.StructField("end_word", T.LongType()),
        ]
    )
    id_type = pa.from_numpy_dtype("int64") if isinstance(kinds["item_id"].dataType, T.LongType) else None
    out = docs.sparkSession.createDataFrame([], kinds)
    for shared in blocks(docs, benchmark):
        out = out.union(docs.select("doc_id", _lower().alias("text")).mapInArrow(_find(shared, id_type), kinds))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    out = docs
    for shared in blocks(docs, benchmark):
        out = out.withColumn(fresh(docs, "lower"), _lower()).mapInArrow(_clean(shared, docs.columns), docs.schema)
    return out


@query("op2_benchmark_decontamination")
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
