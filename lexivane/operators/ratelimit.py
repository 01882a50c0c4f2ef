"""Request limiting over a table of requests.

A request is admitted if fewer than ``limit`` requests of its client were
admitted in the window before it; refused requests do not count.
"""

from __future__ import annotations

from collections import deque
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.config import RATE_LIMIT_REQUESTS, RATE_LIMIT_WINDOW_SECONDS
from lexivane.session import materialize, ship_package

# intervals into which a window is cut for counting
WINDOW_PIECES = 8
# A busy stretch of more requests than this is worked in slices.
SLICE_ROWS = 2_000_000


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970. Times without a zone are taken as they stand, so
    clock changes of the session's zone do not bend them."""
    if isinstance(df.schema[ts].dataType, T.TimestampType):
        return F.unix_micros(F.col(ts))
    since = F.col(ts) - F.lit("1970-01-01").cast("timestamp_ntz")
    part = lambda unit: F.extract(F.lit(unit), since)
    minutes = (part("DAY").cast("bigint") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return minutes * 60_000_000 + (part("SECOND") * 1_000_000).cast("bigint")


def _bucketed(events: DataFrame, ts: str, window_us: int) -> DataFrame:
    us = micros(events, ts)
    return events.withColumn("_us", us).withColumn("_b", F.floor(us / F.lit(window_us)))


def window_count(
    events: DataFrame,
    key: str,
    ts: str,
    window_seconds: int = RATE_LIMIT_WINDOW_SECONDS,
    pieces: int = WINDOW_PIECES,
) -> DataFrame:
    """Adds ``n_recent``: requests of the client in the window that ends with
    this request, refused ones included; null where the time is null.

    It is the client's requests up to now less those up to a window ago. Time is cut
    into ``pieces`` intervals a window: requests before an interval are a prefix sum of
    counts made before the shuffle, and only the interval in which a time lies is
    opened. No frame runs over a client's requests, so one with most of them is spread
    over its intervals; requests of one time are one row with a count.
    """
    width = window_seconds * 1_000_000
    piece = lambda us: F.floor(us / F.lit(max(1, width // pieces)))
    rows = events.withColumn("_us", micros(events, ts))
    times = rows.where("_us is not null").groupBy(F.col(key).alias("_k"), "_us").agg(F.count(F.lit(1)).alias("_n"))
    times = materialize(times)
    past = F.col("_us") - width
    none = F.lit(0).cast("bigint")
    marks = times.select("_k", "_us", F.col("_us").alias("_t"), "_n", F.lit(0).alias("_asked")).unionByName(
        times.select("_k", "_us", past.alias("_t"), none.alias("_n"), F.lit(1).alias("_asked"))
    )
    marks = marks.withColumn("_b", piece(F.col("_t")))
    along = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = marks.groupBy("_k", "_b").agg(F.sum("_n").alias("_n"))
    before = sums.select(F.col("_k").alias("_k2"), F.col("_b").alias("_b2"), F.coalesce(F.sum("_n").over(along), none).alias("_before"))
    # a request at the very time that is asked for counts as past
    inside = Window.partitionBy("_k", "_b").orderBy("_t", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    upto = marks.withColumn("_in", F.sum("_n").over(inside)).join(
        before, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_b") == F.col("_b2"))
    )
    sign = F.when(F.col("_asked") == 1, -1).otherwise(1)
    counts = upto.groupBy("_k", "_us").agg(F.sum(sign * (F.col("_before") + F.col("_in"))).alias("n_recent"))
    counts = counts.withColumnRenamed("_us", "_us2")
    met = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_us") == F.col("_us2"))
    return rows.join(counts, met, "left").drop("_us", "_us2", "_k")


def _admit(us: np.ndarray, held: deque, limit: int, width: int) -> np.ndarray:
    """Admissions of one client's next requests; ``held`` keeps the last
    ``limit`` admitted times. Refused stretches are skipped by search."""
    out = np.zeros(len(us), bool)
    i = 0
    while i < len(us):
        if len(held) == limit and us[i] < held[0] + width:
            i = int(np.searchsorted(us, held[0] + width, side="left"))
            continue
        out[i] = True
        if len(held) == limit:
            held.popleft()
        held.append(int(us[i]))
        i += 1
    return out


def _stretches(per_bucket: DataFrame, key: str, limit: int, slice_rows: int) -> DataFrame:
    """Which buckets need the requests taken in order.

    Where a bucket and the one before it hold at most ``limit`` requests
    together, everything in it is admitted. The other, busy buckets form
    stretches; the bucket before a stretch is not busy, so its requests are all
    admitted and give the state to start from (``_warm_for``). A stretch is cut
    into slices of whole buckets (``_slice``). All of this reads one row per
    client and bucket.
    """
    order = Window.partitionBy(key).orderBy("_b")
    adjacent = F.lag("_b").over(order) == F.col("_b") - 1
    before = F.when(adjacent, F.lag("n").over(order)).otherwise(F.lit(0))
    marked = per_bucket.withColumn("_busy", F.col("n") + before > limit).withColumn("_adj", adjacent)
    opens = F.col("_busy") & ~(
        F.coalesce(F.col("_adj"), F.lit(False)) & F.coalesce(F.lag("_busy").over(order), F.lit(False))
    )
    named = marked.withColumn("_opens", opens).withColumn(
        "_seg",
        F.when(
            F.col("_busy"),
            F.max(F.when(F.col("_opens"), F.col("_b"))).over(
                order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        ),
    )
    next_busy = F.coalesce(F.lead("_busy").over(order), F.lit(False)) & (
        F.lead("_b").over(order) == F.col("_b") + 1
    )
    warm = F.when(~F.col("_busy") & next_busy, F.col("_b") + 1)
    before_in_stretch = F.sum("n").over(
        Window.partitionBy(key, "_seg").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    )
    return named.withColumn("_warm_for", warm).select(
        key,
        "_b",
        "_busy",
        "_seg",
        "_warm_for",
        F.when(
            F.col("_busy"), F.floor(F.coalesce(before_in_stretch, F.lit(0)) / slice_rows).cast("int")
        ).alias("_slice"),
    )


def _in_order(rows: DataFrame, key: str, order_by: str, limit: int, width: int) -> DataFrame:
    """Adds ``admitted``, slice by slice in order of time. Partitions are
    streamed; the state is the last ``limit`` admitted times of the slice."""
    groups = [key, "_seg", "_slice"]
    ordered = rows.repartition(*groups).sortWithinPartitions(*groups, "_us", order_by)
    schema = T.StructType([*rows.schema.fields, T.StructField("admitted", T.BooleanType())])
    at = {c: rows.columns.index(c) for c in (*groups, "_us")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, deque()
        for batch in batches:
            if not batch.num_rows:
                continue
            values = lambda c: batch.column(at[c]).to_numpy(zero_copy_only=False)
            us, marks = values("_us"), [values(c) for c in groups]
            differs = np.zeros(len(us) - 1, bool)
            for m in marks:
                differs |= m[1:] != m[:-1]
            edges = [0, *(np.flatnonzero(differs) + 1).tolist(), len(us)]
            admitted = np.zeros(len(us), bool)
            for lo, hi in zip(edges, edges[1:]):
                name = tuple(m[lo] for m in marks)
                if name != current:
                    current, held = name, deque()
                admitted[lo:hi] = _admit(us[lo:hi], held, limit, width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(admitted)], names=schema.names)

    return ordered.mapInArrow(run, schema)


def _in_slices(
    rows: DataFrame, stretches: DataFrame, depth: int, key: str, order_by: str, limit: int, width: int
) -> DataFrame:
    """Long stretches, their slices worked side by side.

    A slice ends with a whole bucket, and the window reaches no further back
    than one bucket, so what a slice must know of the one before are the requests
    admitted in its last bucket, at most ``limit``. All slices start with a
    guess (nothing); those that were told something else by their predecessor
    are worked again, until none is. After ``n`` rounds the first ``n`` slices of
    a stretch are certain, so this ends with the exact result; in practice
    limiters forget their start within a few windows and so it ends early.
    """
    name = [key, "_seg", "_slice"]
    rows = materialize(rows)
    last = materialize(stretches.filter("_busy").groupBy(*name).agg(F.max("_b").alias("_b")))
    following = last.select(*name)
    verdict = materialize(_in_order(rows, key, order_by, limit, width))
    told = None
    for turn in range(depth + 1):
        handed = (
            verdict.filter("admitted and not _warm")
            .join(last, [*name, "_b"], "left_semi")
            .select(key, "_seg", (F.col("_slice") + 1).alias("_slice"), "_us")
            .groupBy(*name)
            .agg(F.sort_array(F.collect_list("_us")).alias("_carry"))
            .join(following, name, "left_semi")
        )
        handed = materialize(handed)
        if told is None:
            changed = handed
        else:
            changed = handed.join(told.withColumnRenamed("_carry", "_old"), name, "full").filter(
                ~F.col("_carry").eqNullSafe(F.col("_old"))
            )
        changed = materialize(changed.select(*name, "_carry"))
        if changed.isEmpty():
            break
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in (*name, "_us", "_warm")]
        carried = changed.select(*name, F.explode("_carry").alias("_us"), F.lit(True).alias("_warm"), *nothing)
        again = rows.join(changed, name, "left_semi").unionByName(carried.select(*rows.columns))
        fresh = materialize(_in_order(again, key, order_by, limit, width))
        verdict = verdict.join(changed, name, "left_anti").unionByName(fresh)
        if turn % 5 == 4:
            verdict = materialize(verdict)
        told = handed
    return verdict


def rate_limit(
    events: DataFrame,
    key: str,
    ts: str,
    order_by: str,
    limit: int = RATE_LIMIT_REQUESTS,
    window_seconds: int = RATE_LIMIT_WINDOW_SECONDS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Adds ``admitted``. Requests of one time are taken by ``order_by``. Requests
    without a client or a time cannot be judged: their ``admitted`` is NULL.

    Counts per client and bucket, made before the shuffle, decide most requests.
    Only busy stretches are taken in order, and long ones in slices.
    """
    ship_package(events.sparkSession)
    width = window_seconds * 1_000_000
    known = F.col(key).isNotNull() & F.col(ts).isNotNull()
    unknown = events.where(~known).withColumn("admitted", F.lit(None).cast("boolean"))
    events = events.where(known)
    if limit <= 0:
        return events.withColumn("admitted", F.lit(False)).unionByName(unknown)
    rows = _bucketed(events, ts, width)
    per_bucket = rows.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("n"))
    stretches = materialize(_stretches(per_bucket, key, limit, slice_rows))
    placed = rows.join(stretches, [key, "_b"])
    quiet = placed.filter(~F.col("_busy")).select(*events.columns, F.lit(True).alias("admitted"))
    marks = ("_us", "_b", "_seg", "_slice", "_warm")
    busy = placed.filter("_busy").withColumn("_warm", F.lit(False))
    warm = (
        placed.filter("_warm_for is not null")
        .drop("_seg", "_slice")
        .withColumn("_seg", F.col("_warm_for"))
        .withColumn("_slice", F.lit(0))
        .withColumn("_warm", F.lit(True))
    )
    together = busy.select(*events.columns, *marks).unionByName(warm.select(*events.columns, *marks))
    depth = stretches.agg(F.max("_slice").alias("d")).first()["d"] or 0
    if depth == 0:
        judged = _in_order(together, key, order_by, limit, width)
    else:
        judged = _in_slices(together, stretches, depth, key, order_by, limit, width)
    return quiet.unionByName(judged.filter("not _warm").select(*events.columns, "admitted")).unionByName(unknown)
