"""Marker events of takes whose frames come late and in any order (R2), on the stateful processor interface.

Frames wait in a map by number, so one that arrives is one write and no rewriting of what waits with it. A
timer at a frame's time fires once the watermark has passed it: then no earlier frame can come any more, and
all that is due is read in order. Another timer ends a take. What the events need is a small state of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from actionline.streaming.stream import EVENTS

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Last status and its first time, time and number of the last frame read, events told, the event that waits.
PROGRESS = "status string, since double, last_t double, last_no long, n int, kind string, start double, stop double, scroll double"
FRESH = (None, 0.0, 0.0, -1, 0, None, 0.0, 0.0, None)


class Marks(StatefulProcessor):
    """One take. An event is told when the next one begins, as an orange run may still extend it."""

    def __init__(self, end_ms: int, noise: float):
        self.end_ms, self.noise = end_ms, noise

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "frame_no long", "at long, t double, status string")
        self.progress = handle.getValueState("progress", PROGRESS)
        self.last = handle.getValueState("last", "at long")  # the latest time of any frame

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        read = self.progress.get() or FRESH
        before = (self.last.get() or (None,))[0]
        due = set()
        for batch in rows:
            times = batch["ts"].astype("datetime64[ms]").astype("int64")
            for no, fps, status, at in zip(batch["frame_no"], batch["fps"], batch["status"], times, strict=True):
                if no > read[3]:
                    self.waiting.updateValue((int(no),), (int(at), float((no + 1) / (fps if fps > 0 else 30.0)), status))
                    due.add(int(at))
        if due:
            # one timer for what came together: at its latest time all of it is due
            self.handle.registerTimer(max(due) + 1)
            if before is None or max(due) > before:
                if before is not None:
                    self.handle.deleteTimer(before + self.end_ms)
                self.handle.registerTimer(max(due) + self.end_ms)
                self.last.update((max(due),))
        yield pd.DataFrame([], columns=COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, since, last_t, last_no, n, kind, start, stop, scroll = (None if x != x else x for x in self.progress.get() or FRESH)
        out: list[tuple] = []

        def flush() -> None:
            nonlocal kind, scroll, n
            if kind is not None:
                out.append((key[0], n, kind, start, stop, scroll, scroll is not None))
                n += 1
            kind, scroll = None, None

        def change(t: float, following: str | None) -> None:
            """The end of a run at t, and the mark of a red one that follows."""
            nonlocal kind, start, stop, scroll
            if status == "green" and (following in (None, "red") or t - since > self.noise):
                flush()
                kind, start, stop = "duration", since, t
            if following == "red":
                flush()
                kind, start, stop = "point", t, t
            if status == "orange" and kind is not None:
                scroll = t

        mark = timerValues.getCurrentWatermarkInMs()
        for (no,), (at, t, seen) in sorted(self.waiting.iterator()):
            if at >= mark:
                continue
            self.waiting.removeKey((no,))
            if no > last_no:
                if seen != status:
                    change(t, seen)
                    status, since = seen, t
                last_t, last_no = t, int(no)
        latest = self.last.get()
        if latest is not None and expiredTimerInfo.getExpiryTimeInMs() >= latest[0] + self.end_ms:
            change(last_t, None)
            flush()
            for state in (self.waiting, self.progress, self.last):
                state.clear()
        else:
            self.progress.update((status, since, last_t, last_no, n, kind, start, stop, scroll))
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


COLUMNS = [x.split()[0] for x in EVENTS.split(", ")]


def stream_events_in_order(frames: DataFrame, late: str = "10 minutes", end: str = "10 minutes", noise: float = 0.1) -> DataFrame:
    """R2: the marker events of T16 from frames (take_id, frame_no, fps, status, ts) that come in any order.

    Frames count that come while the watermark, ``late`` behind the latest ts, has not passed theirs; ts grows
    with frame_no in a take. A take without frames for ``end`` of event time is over. Frames that come twice
    count once. A query over it needs the RocksDB state store: see ``started``."""
    w = frames.withWatermark("ts", late).groupBy("take_id")
    return w.transformWithStateInPandas(Marks(int(pd.Timedelta(end).total_seconds() * 1000), noise), EVENTS, "append", "eventtime")


def started(spark: SparkSession, events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, then the end, with the state store that timers need; the next call goes on."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return events.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    finally:
        spark.conf.set(PROVIDER, before)


def with_end(frames: DataFrame, days: int = 30) -> DataFrame:
    """A batch that ends a stored stream: one frame of no take, ``days`` after the last, which moves the watermark."""
    return frames.agg((F.max("ts") + F.make_dt_interval(F.lit(days))).alias("ts")).select(F.lit(None).cast("string").alias("take_id"), F.lit(0).cast("long").alias("frame_no"), F.lit(1).alias("fps"), F.lit("other").alias("status"), "ts")
