"""Term blocks of whole tiles, made where the texts of a tile lie.

Texts are dealt out by tile, so all postings of a tile are in one task from the start:
what is shuffled are texts and finished blocks, never single postings. A task encodes
its terms as numbers and finds postings and blocks as runs of sorted numbers.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.functions.terms import tokens
from lexivane.operators.postings import COLUMN_GAP, INDEXED
from lexivane.session import ship_package

BLOCKS = "term string, tile bigint, held bigint, max_tf int, min_len int, slots array<int>, tfs array<int>, positions array<array<int>>"
TOKENS_AT_ONCE = 1 << 20  # of those that are sorted together; a tile is never cut


def blocks_of_tiles(chunks: DataFrame, parts: int, cols=INDEXED, fold: bool = True) -> DataFrame:
    """The blocks of ``chunks`` (with ``tile`` and ``slot``), as ``term_blocks`` gives them,
    by ``parts`` tasks."""
    ship_package(chunks.sparkSession)
    dealt = chunks.select("tile", "slot", *cols).repartition(parts, "tile").sortWithinPartitions("tile", "slot")
    found = [tokens(F.coalesce(F.col(c), F.lit("")), fold).alias(f"words{n}") for n, c in enumerate(cols)]
    return dealt.select("tile", "slot", *found).mapInArrow(_blocks_of_task, BLOCKS)


def _blocks_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = None  # the last tile so far, which the next batch may go on with
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = (rows if kept is None else pa.concat_tables([kept, rows])).combine_chunks()
        tile = rows.column("tile").to_numpy()
        last = int(np.searchsorted(tile, tile[-1]))
        yield from _blocks_of_rows(rows.slice(0, last))
        kept = rows.slice(last)
    if kept is not None:
        yield from _blocks_of_rows(kept)


def _blocks_of_rows(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Blocks of whole tiles, about ``TOKENS_AT_ONCE`` tokens at a time."""
    if not rows.num_rows:
        return
    rows = rows.combine_chunks()
    tile, slot, *words = [c.chunk(0) for c in rows.columns]
    tile, slot = tile.to_numpy(), slot.to_numpy()
    lengths = [w.value_lengths().to_numpy() for w in words]
    first = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
    ends = np.cumsum(np.add.reduceat(sum(lengths).astype(np.int64), first))
    cut = np.flatnonzero(np.diff(ends // TOKENS_AT_ONCE)) + 1
    bounds = [0, *first[cut].tolist(), len(tile)]
    for lo, hi in zip(bounds, bounds[1:]):
        made = _blocks(tile[lo:hi], slot[lo:hi], [w.slice(lo, hi - lo) for w in words], [n[lo:hi] for n in lengths])
        if made is not None:
            yield made


def _runs(changes: np.ndarray) -> np.ndarray:
    """Where runs begin, and the end of the last."""
    return np.r_[np.flatnonzero(np.r_[True, changes]), len(changes) + 1]


def _blocks(tile: np.ndarray, slot: np.ndarray, words: list[pa.Array], lengths: list[np.ndarray]) -> pa.RecordBatch | None:
    row, pos = [], []
    for n, length in enumerate(lengths):
        begin = np.cumsum(length) - length
        row.append(np.repeat(np.arange(len(length)), length))
        pos.append(np.arange(length.sum()) - np.repeat(begin, length) + 1 + n * COLUMN_GAP)
    row, pos, n_tokens = np.concatenate(row), np.concatenate(pos), sum(lengths)
    if not len(row):
        return None
    coded = pa.concat_arrays([w.flatten() for w in words]).dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    # a run of equal keys is a posting, one of equal keys without their row a block; the
    # order of equal keys is that of their positions
    key = (np.cumsum(np.r_[0, tile[1:] != tile[:-1]])[row] * len(coded.dictionary) + code) * len(tile) + row
    order = np.argsort(key, kind="stable")
    key = key[order]
    posting = _runs(key[1:] != key[:-1])
    at = posting[:-1]
    tf, row_of = np.diff(posting).astype(np.int32), row[order[at]]
    block_key = key[at] // len(tile)
    block = _runs(block_key[1:] != block_key[:-1])
    start = block[:-1]
    slots = slot[row_of].astype(np.int32)
    lists = lambda values: pa.ListArray.from_arrays(pa.array(block, pa.int32()), values)
    each = pa.ListArray.from_arrays(pa.array(posting, pa.int32()), pa.array(pos[order], pa.int32()))
    return pa.RecordBatch.from_arrays(
        [
            coded.dictionary.take(pa.array(code[order[at[start]]])),
            pa.array(tile[row_of[start]]),
            pa.array(np.bitwise_or.reduceat(np.left_shift(np.int64(1), slots.astype(np.int64)), start)),
            pa.array(np.maximum.reduceat(tf, start)),
            pa.array(np.minimum.reduceat(n_tokens[row_of], start).astype(np.int32)),
            lists(pa.array(slots)),
            lists(pa.array(tf)),
            lists(each),
        ],
        names=["term", "tile", "held", "max_tf", "min_len", "slots", "tfs", "positions"],
    )
