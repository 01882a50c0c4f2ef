"""Hard-negative mining with exact integer scores from Kronecker-packed products.

Components are ``floor(SCALE * x)``. Several candidates are put into one wide integer:
their components are biased to be non-negative and set into fields wide enough for a
whole inner product, so that one multiplication by an anchor's component serves all of
them and the sums of products stay apart. The fields are read back from the top of the
sums, and the bias is taken off again; scores are exact. Wide integers of up to 53 bits
are carried as doubles, so that a matrix product multiplies them; where components are
too large for two fields of that, Python's integers carry ``FIELDS`` fields.

Anchors are worked in blocks of ``ANCHOR_BLOCK``, which is what a task is sent; vectors
stay where they are and are passed twice for each block. A task keeps the best rows of
each anchor: first those of its own label (positives), then, between the bounds that
each positive's score sets, those of other labels. Only these leave the task.

Rows with a null id, label or vector, or with a null or non-finite component, take no
part; neither do rows with a component of 2**24 or more after scaling, whose scores may
not fit 64 bits. Vectors are compared with those of their own length; empty ones score
0. Ties: by smaller id. Repeated rows are candidates of their own, but an anchor is never
found by rows of its own id, and repeated anchors count once. Empty tables give no rows.
Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexivane.llm.common import query, table
from lexivane.session import materialize, scratch_path, ship_package

SCALE = 256
LARGEST = 1 << 24
ANCHOR_BLOCK = 1024
SLICE = 1024  # candidates scored at a time
EXACT = 53  # bits of an integer that a double holds
FIELDS = 8  # candidates in one of Python's integers

FOUND = "anchor int, asked int, vec_id long, score long"


def _width(most_candidate: int, most_anchor: int, length: int) -> int:
    """Bits of a field: any sum of ``length`` products of a biased candidate component
    (0 to 2 * most_candidate) and an anchor component, with its sign."""
    return (2 * most_candidate * most_anchor * max(length, 1)).bit_length() + 1


def pack(v: np.ndarray, bias: int, width: int, fields: int) -> np.ndarray:
    """Rows of ``v``, ``fields`` at a time, as the columns of one matrix of integers."""
    n = -(-len(v) // fields)
    kind = np.float64 if fields * width <= EXACT else object
    held = np.zeros((n * fields, v.shape[1]), np.int64)
    held[: len(v)] = v + bias
    held = held.reshape(n, fields, v.shape[1]).astype(kind)
    out = held[:, 0]
    for k in range(1, fields):
        out = out + held[:, k] * kind(1 << (k * width)) if kind is np.float64 else out + held[:, k] * (1 << (k * width))
    return out.T


def unpack(sums: np.ndarray, width: int, fields: int) -> np.ndarray:
    """The signed fields of ``sums`` (anchors, packs) as (anchors, packs * fields)."""
    if sums.dtype == object:
        half, mask, rest, out = 1 << (width - 1), (1 << width) - 1, sums, []
        for _ in range(fields):
            low = ((rest + half) & mask) - half
            out.append(low.astype(np.int64))
            rest = (rest - low) >> width
    else:
        half, mask, rest, out = np.int64(1 << (width - 1)), np.int64((1 << width) - 1), sums.astype(np.int64), []
        for _ in range(fields):
            low = ((rest + half) & mask) - half
            out.append(low)
            rest = (rest - low) >> np.int64(width)
    return np.stack(out, axis=2).reshape(len(sums), -1)


def scores(anchors: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of all ``anchors`` with all rows of ``v``, as int64."""
    if not v.shape[1] or not len(v) or not len(anchors):
        return np.zeros((len(anchors), len(v)), np.int64)
    bias = int(-min(v.min(), 0))
    width = _width(max(bias, int(v.max()), 1), int(max(abs(anchors).max(), 1)), v.shape[1])
    fields = EXACT // width
    if fields < 2:
        fields = FIELDS
    packed = pack(v, bias, width, fields)
    sums = anchors.astype(packed.dtype) @ packed
    return unpack(sums, width, fields)[:, : len(v)] - bias * anchors.sum(axis=1)[:, None]


def best(rows: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the best ``k`` of each row number: score down, then id up."""
    order = np.lexsort((ids, -score, rows))
    r = rows[order]
    first = np.searchsorted(r, r)
    return order[np.arange(len(r)) - first < k]


def _pool(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the allowed cells that may be among their row's best ``k``."""
    least = np.iinfo(np.int64).min
    held = np.where(allowed, score, least)
    if score.shape[1] > k:
        floor = np.partition(held, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        allowed = allowed & (held >= floor[:, None])
    return np.nonzero(allowed)


def read_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row is usable, its length, all scaled components) of a column of arrays."""
    n = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    gone = flat.is_null().to_numpy(zero_copy_only=False)
    with np.errstate(all="ignore"):
        x = np.floor(flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    bad = gone | ~np.isfinite(x) | (np.abs(x) >= LARGEST)
    ends = np.cumsum(np.maximum(n, 0))
    held = np.concatenate([[0], np.cumsum(bad)])
    usable = (n >= 0) & (held[ends] - held[ends - np.maximum(n, 0)] == 0)
    return usable, n, np.where(bad, 0, x).astype(np.int64)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, ids, labels, components) of the usable rows, by length of vector."""
    usable, n, flat = read_vectors(batch.column("vector"))
    ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
    starts = np.cumsum(np.maximum(n, 0)) - np.maximum(n, 0)
    for length in np.unique(n[usable]):
        rows = np.flatnonzero(usable & (n == length))
        cells = starts[rows][:, None] + np.arange(length)[None, :]
        yield int(length), ids[rows], labels[rows], flat[cells]


def _search(shared, k: int, low: int, high: int, positives: bool):
    """Best ``k`` rows of the batches for each anchor (``asked`` 0), or for each of the
    scores asked of it."""

    def run(batches):
        blocks, held = shared.value, {}
        for batch in batches:
            for length, ids, labels, v in _groups(batch):
                if length not in blocks:
                    continue
                rows, a_ids, a_labels, a, asked = blocks[length]
                for at in range(0, len(v), SLICE):
                    part = slice(at, at + SLICE)
                    score = scores(a, v[part])
                    same = a_labels[:, None] == labels[part][None, :]
                    other = a_ids[:, None] != ids[part][None, :]
                    for j in range(1 if positives else asked.shape[1]):
                        if positives:
                            allowed = same & other
                        else:
                            top = asked[:, j][:, None]
                            allowed = ~same & other & (top != np.iinfo(np.int64).min)
                            allowed &= (score <= top) & (high * score >= low * top)
                        r, c = _pool(score, allowed, k)
                        new = (rows[r], score[r, c], ids[part][c])
                        if (length, j) in held:
                            new = tuple(np.concatenate(x) for x in zip(held[length, j], new))
                        keep = best(*new, k)
                        held[length, j] = tuple(x[keep] for x in new)
        for (_, j), (r, s, i) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(r, pa.int32()), pa.array(np.full(len(r), j, np.int32)), pa.array(i, pa.int64()), pa.array(s, pa.int64())],
                ["anchor", "asked", "vec_id", "score"],
            )

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "asked").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _usable(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id is not null and label is not null and embedding is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("vector")
    )


def _anchor_block(rows: list) -> dict:
    """Anchors by length of vector: numbers in the block, ids, labels, components."""
    kind = pa.list_(pa.float64())
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r["vec_id"] for r in rows], pa.int64()), pa.array([r["label"] for r in rows], pa.int64()), pa.array([r["vector"] for r in rows], kind)],
        ["vec_id", "label", "vector"],
    )
    out, n = {}, 0
    for length, ids, labels, v in _groups(batch):
        _, one = np.unique(np.column_stack([ids, labels, v]), axis=0, return_index=True)
        out[length] = [np.arange(n, n + len(one), dtype=np.int32), ids[one], labels[one], v[one], None]
        n += len(one)
    return out


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    For each row of ``anchors`` and each of its ``n_positives`` best rows of the same
    label, the ``n_negatives`` best rows of other labels whose score is at least ``low``
    of ``high`` parts of the positive's and not above it.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    vectors = _usable(vectors)
    anchors = materialize(_usable(anchors).withColumn("block", F.xxhash64("vec_id")))
    n_blocks = -(-anchors.count() // ANCHOR_BLOCK)
    out, path = None, scratch_path(spark, "negatives")
    kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    for b in range(n_blocks):
        block = _anchor_block(anchors.where(F.pmod("block", F.lit(n_blocks)) == b).drop("block").collect())
        names = {int(r): int(i) for rows, ids, *_ in block.values() for r, i in zip(rows, ids)}
        shared = spark.sparkContext.broadcast(block)
        found = vectors.mapInArrow(_search(shared, n_positives, low, high, True), FOUND)
        near = _ranked(found, n_positives).collect()  # at most n_positives for each anchor of the block
        wanted: dict[int, list[tuple[int, int]]] = {}
        for r in sorted(near, key=lambda r: r["rank"]):
            if (r["vec_id"], r["score"]) not in wanted.setdefault(r["anchor"], []):
                wanted[r["anchor"]].append((r["vec_id"], r["score"]))
        for part in block.values():
            part[4] = np.full((len(part[0]), n_positives), np.iinfo(np.int64).min)
            for i, row in enumerate(part[0]):
                for j, (_, score) in enumerate(wanted.get(int(row), ())):
                    part[4][i, j] = score
        shared.unpersist()
        again = spark.sparkContext.broadcast(block)
        found = vectors.mapInArrow(_search(again, n_negatives, low, high, False), FOUND)
        pairs = [(a, j, names[a], i, s) for a, ps in wanted.items() for j, (i, s) in enumerate(ps)]
        asked = spark.createDataFrame(pairs, "anchor int, asked int, anchor_id long, positive_id long, positive_score long")
        rows = _ranked(found, n_negatives).join(F.broadcast(asked), ["anchor", "asked"])
        rows.select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ).write.mode("append").parquet(path)
        again.unpersist()
        out = path
    return spark.read.schema(kinds).parquet(out) if out else spark.createDataFrame([], kinds)


SQL = r"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
    cast(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i])) as bigint) as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over w as integer) as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id)
where not same and 80 * positive_score <= 100 * score and score <= positive_score
window w as (partition by anchor_id, positive_id order by score desc, vec_id)
qualify row_number() over w <= 5
"""


@query("op12_hard_negatives", SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", label)
    return hard_negatives(rows, rows.where(F.col("vec_id") % 100 == 0))
