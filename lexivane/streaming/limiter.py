"""The request limiter on a stream: keyed state, one short list per client."""

from __future__ import annotations

from bisect import bisect_right, insort
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lexivane.config import RATE_LIMIT_REQUESTS, RATE_LIMIT_WINDOW_SECONDS
from lexivane.operators.ratelimit import micros
from lexivane.session import ship_package

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Limiter(StatefulProcessor):
    """Holds the admitted times that a request may still be compared with: those of a
    window before the watermark, and later ones. Never more than ``limit`` a window.

    A timer clears the state of a client that has been silent for a window.
    """

    def __init__(self, limit: int, window_us: int, order_by: str, names: list[str]):
        self.limit, self.window_us, self.order_by, self.names = limit, window_us, order_by, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        schema = T.StructType([T.StructField("us", T.LongType())])
        self.admitted = handle.getListState("admitted", schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = sorted(int(row[0]) for row in self.admitted.get())  # a late request may come between
        # rows of one client and one trigger, whose size the source options set
        batch = pd.concat(list(rows), ignore_index=True)
        batch.columns = self.names
        batch = batch.sort_values(["_us", self.order_by], kind="stable")
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        verdicts = []
        for us in batch["_us"].tolist():
            if us < mark:  # what it would be compared with may be forgotten
                verdicts.append(None)
                continue
            recent = bisect_right(held, us) - bisect_right(held, us - self.window_us)
            verdicts.append(recent < self.limit)
            if verdicts[-1]:
                insort(held, us)
        # later requests may still be as late as the watermark allows
        del held[: bisect_right(held, min(mark, held[-1]) - self.window_us) if held else 0]
        if held:
            self.admitted.put([(us,) for us in held])
        else:
            self.admitted.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if held:
            self.handle.registerTimer((held[-1] + self.window_us) // 1000 + 1)
        late = ["late" if v is None else None for v in verdicts]
        yield batch.drop(columns="_us").assign(admitted=pd.array(verdicts, dtype="boolean"), reason=late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.admitted.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limit_stream(
    requests: DataFrame,
    key: str,
    ts: str,
    order_by: str,
    limit: int = RATE_LIMIT_REQUESTS,
    window_seconds: int = RATE_LIMIT_WINDOW_SECONDS,
    delay: str = "10 minutes",
) -> DataFrame:
    """Adds ``admitted`` and ``reason`` to a stream of requests. Set ``STATE_PROVIDER`` as
    ``spark.sql.streaming.stateStore.providerClass`` first. Requests later than
    ``delay`` are not judged any more: they come with a null ``admitted`` and the reason
    ``late``."""
    ship_package(requests.sparkSession)
    fields = [*requests.schema.fields, T.StructField("admitted", T.BooleanType()), T.StructField("reason", T.StringType())]
    schema = T.StructType(fields)
    return (
        # the watermark is kept on a copy, so that late rows reach the processor
        requests.withColumn("_mark", F.col(ts))
        .withWatermark("_mark", delay)
        .withColumn("_us", micros(requests, ts))
        .drop("_mark")
        .groupBy(key)
        .transformWithStateInPandas(
            _Limiter(limit, window_seconds * 1_000_000, order_by, [*requests.columns, "_us"]),
            schema,
            "Append",
            "EventTime",
        )
    )


def window_count_stream(
    requests: DataFrame, key: str, ts: str, window: str = "60 seconds", slide: str | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """``window, key, n``: requests per client and event-time window."""
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    return requests.withWatermark(ts, delay).groupBy(span, key).agg(F.count(F.lit(1)).alias("n"))
