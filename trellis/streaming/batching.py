"""Count-or-time batches: a batch closes with its n-th row or t after its first row, whichever is first.

Rows of a key (a topic partition, a consumer) are gathered in keyed state and leave as whole batches, so a sink
writes and commits one batch at a time. Two clocks:

* event time: a row's own time decides. Rows of a micro-batch are taken in time order; the row that is t or
  more later than a batch's first row opens the next one, and the watermark closes the last (a timer at the
  due time). Independent of how rows fall into micro-batches, as long as no row is later than ``delay``.
* processing time: the time of the micro-batch is the time of its rows; a timer closes a batch when no row comes.

State per key: the number of the open batch, its due time and at most n rows. A hot key is one key's sequence by
definition; give it more keys (partitions) to spread it. The output is a file sink, whose log
makes every row appear once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Rows and seconds of the stages' batches.
SCAN, EVENTS, SUMMARIES = (100, 2.0), (20, 5.0), (10, 3.0)
STAMP = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
FRAME_ROWS = 10_000  # a stream's closed batches leave together, in frames of about this many rows: a frame a batch costs more than its rows
NAMES = ["batch_no", "place", "closed_by", "body"]


class CountOrTime(StatefulProcessor):
    """Rows ``(key, at_us, body)`` in, rows ``(key, batch_no, place, closed_by, body)`` of closed batches out, whole batches up to ``frame_rows`` a frame."""

    def __init__(self, key: str, rows: int, seconds: float, event_time: bool, frame_rows: int = 1):
        self.key, self.most, self.wait, self.event_time, self.frame_rows = key, rows, int(seconds * 1_000_000), event_time, frame_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "batch_no bigint, due_us bigint, timer_ms bigint")
        self.held = handle.getListState("held", "body string")

    def _out(self, key, no: np.ndarray, place: np.ndarray, why: np.ndarray, bodies) -> pd.DataFrame:
        return pd.DataFrame({self.key: np.full(len(no), key[0]), "batch_no": no, "place": place, "closed_by": why, "body": bodies})

    def _closed(self, key, no: int, cuts: list[tuple[int, str]], body: pa.ChunkedArray) -> Iterator[pd.DataFrame]:
        """The closed batches; ``cuts`` are their ends in ``body`` and why they closed."""
        ends, why = np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], object)
        starts = np.concatenate([[0], ends[:-1]])
        lo = 0
        while lo < len(cuts):
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + self.frame_rows, "right")))
            n = ends[lo:hi] - starts[lo:hi]
            at = np.arange(starts[lo], ends[hi - 1])
            yield self._out(key, np.repeat(np.arange(no + lo, no + hi), n), (at - np.repeat(starts[lo:hi], n)).astype(np.int32),
                            np.repeat(why[lo:hi], n), body.slice(starts[lo], len(at)).to_pandas())
            lo = hi

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pa.concat_tables([pa.table({"at": pa.array(pdf["at_us"], pa.int64()), "body": pa.array(pdf["body"], pa.large_string())}) for pdf in rows])
        came = came.sort_by([("at", "ascending"), ("body", "ascending")])  # bytes of UTF-8 sort as code points do
        no, due, timer = self.open.get() if self.open.exists() else (0, 0, -1)
        held = [r[0] for r in self.held.get()] if self.held.exists() else []
        body = pa.chunked_array([pa.array(held, pa.large_string()), *came["body"].chunks])
        at = came["at"].to_numpy() if self.event_time else np.full(len(came), timerValues.getCurrentProcessingTimeInMs() * 1000)
        at, had, n = np.concatenate([np.zeros(len(held), np.int64), at]), len(held), len(body)  # held rows' times are not looked at
        cuts, first, i = [], 0, had
        while i < n:
            if first == i:
                due, i = int(at[i]) + self.wait, i + 1
            end = bisect_left(at, due, i, max(i, min(n, first + self.most)))
            if end < n or end == first + self.most:
                cuts.append((end, "count" if end == first + self.most else "time"))
                first = end
            i = end
        if timer >= 0 and cuts:
            self.handle.deleteTimer(timer)
            timer = -1
        if first < n and timer < 0:
            timer = -(-due // 1000)
            self.handle.registerTimer(timer)
        self.open.update((no + len(cuts), due, timer))
        if cuts or n > had:
            self.held.put([(b,) for b in body.slice(first).to_pylist()]) if first < n else self.held.clear()
        return self._closed(key, no, cuts, body)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        no, due, timer = self.open.get()
        if timer != expiredTimerInfo.getExpiryTimeInMs() or not self.held.exists():
            return
        bodies = [r[0] for r in self.held.get()]
        self.open.update((no + 1, 0, -1))
        self.held.clear()
        n = len(bodies)
        yield self._out(key, np.full(n, no), np.arange(n, dtype=np.int32), np.full(n, "time", object), bodies)


def count_or_time(events: DataFrame, key: str, rows: int, seconds: float, time: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """Streaming frame of closed batches: ``key, batch_no, place, closed_by`` and the other columns of ``events``.

    ``time`` names the event-time column; without it batches go by processing time. Rows with a NULL
    key or time are not batched: route them aside before.
    """
    kind = events.schema[key].dataType.simpleString()
    body = F.to_json(F.struct(*[c for c in events.columns if c != key]), STAMP).alias("body")
    rest = events.drop(key).schema
    keep = f"{key} IS NOT NULL" + (f" AND {time} IS NOT NULL" if time else "")
    events = events.where(keep)
    if time:
        events = events.withWatermark(time, delay)
    at = (F.unix_micros(time) if time else F.lit(0).cast("bigint")).alias("at_us")
    grouped = events.select(key, at, body, *([F.col(time).alias("event_time")] if time else [])).groupBy(key)
    out = grouped.transformWithStateInPandas(CountOrTime(key, rows, seconds, time is not None, FRAME_ROWS),
                                             f"{key} {kind}, batch_no bigint, place int, closed_by string, body string", "append",
                                             "EventTime" if time else "ProcessingTime")
    return out.withColumn("row", F.from_json("body", rest, STAMP)).select(key, "batch_no", "place", "closed_by", "row.*")


def batch_stream(events: DataFrame, key: str, rows: int, seconds: float, sink: str, checkpoint: str, time: str | None = None,
                 delay: str = "0 seconds", trigger: dict | None = None) -> StreamingQuery:
    """Start ``count_or_time`` into a file sink (``availableNow`` unless another trigger is given)."""
    return (count_or_time(events, key, rows, seconds, time, delay).writeStream.outputMode("append").format("parquet")
            .option("path", sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
