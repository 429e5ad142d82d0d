"""Marker events from frame series (T16), as gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def detect_events(frames: DataFrame, only_green: bool = False, noise: float = 0.1) -> DataFrame:
    """take_id, event_no, type, start, end, scroll_end, if_scroll from (take_id, frame_no, fps, status).

    A red run is a point at its first frame. A green run is a duration up to the next run, longer than
    ``noise`` unless red cuts it or the series ends. The end of an orange run is the scroll end of the
    latest event by then, a red one at that very frame included. Only frames where the status changes,
    and each series' last frame, are left after the first window. only_green: green durations alone, as
    scrolling ones.
    """
    w = Window.partitionBy("take_id").orderBy("frame_no")
    f = frames.select("take_id", "frame_no", ((F.col("frame_no") + 1) / F.when(F.col("fps") > 0, F.col("fps")).otherwise(30.0)).alias("t"), "status")
    if only_green:
        f = f.withColumn("status", F.when(F.col("status") == "green", "green").otherwise("other"))
    f = f.withColumn("changed", F.lag("status").over(w).isNull() | (F.lag("status").over(w) != F.col("status"))).withColumn("last_t", F.max("t").over(Window.partitionBy("take_id")))
    runs = f.where("changed").withColumn("next_t", F.lead("t").over(w)).withColumn("next_status", F.lead("status").over(w))
    stop, open_ = F.coalesce("next_t", "last_t"), F.col("next_t").isNull()
    green = (F.col("status") == "green") & (open_ | (F.col("next_status") == "red") | (F.col("next_t") - F.col("t") > noise))
    red, orange = F.col("status") == "red", F.col("status") == "orange"
    # a run makes one mark at most, so marks are rows of the same frame, with no union that would have to be dealt anew
    marks = runs.where(green | red | orange).select(
        "take_id", F.when(red, F.col("t")).otherwise(stop).alias("at"), F.when(red, 1).when(orange, 2).when(open_, 3).otherwise(0).alias("rank"),
        F.when(red, "point").when(orange, "scroll").otherwise("duration").alias("type"), F.when(orange, stop).otherwise(F.col("t")).alias("start"),
        F.when(red, F.col("t")).otherwise(stop).alias("end"), open_.alias("open"),
    )
    order = Window.partitionBy("take_id").orderBy("at", "rank")
    if only_green:
        out = marks.withColumn("event_no", F.row_number().over(order) - 1)
        return out.select("take_id", "event_no", "type", "start", "end", F.when(~F.col("open"), F.col("end")).alias("scroll_end"), (~F.col("open")).alias("if_scroll"))
    event = F.col("type") != "scroll"
    marks = marks.withColumn("event_no", F.sum(event.cast("int")).over(order) - 1)
    scrolls = marks.where(~event & (F.col("event_no") >= 0)).groupBy("take_id", "event_no").agg(F.max("end").alias("scroll_end"))
    out = marks.where(event).join(scrolls, ["take_id", "event_no"], "left")
    return out.select("take_id", F.col("event_no").cast("int").alias("event_no"), "type", "start", "end", "scroll_end", F.col("scroll_end").isNotNull().alias("if_scroll"))


def detect_events_in_chunks(frames: DataFrame, noise: float = 0.1, chunk: int = 100_000) -> DataFrame:
    """T16 for takes of any length: the rows of ``detect_events``, by a scan over chunks of ``chunk`` frames.

    Every chunk gives a small state: its last status, its first change, its last time and how many events it
    counts. States of a take are combined in order, and each chunk is finished from what the chunks before
    and after it give, so no task holds a take. frame_no counts the frames of a take from 0."""
    key = ["take_id", "chunk"]
    chunks = Window.partitionBy("take_id").orderBy("chunk")
    f = frames.select("take_id", "frame_no", ((F.col("frame_no") + 1) / F.when(F.col("fps") > 0, F.col("fps")).otherwise(30.0)).alias("t"), "status")
    f = f.withColumn("chunk", F.floor(F.col("frame_no") / chunk))
    state = f.groupBy(*key).agg(F.max_by("status", "frame_no").alias("last"), F.max("t").alias("last_t"))
    state = state.withColumn("before", F.lag("last").over(chunks)).withColumn("last_t", F.max("last_t").over(Window.partitionBy("take_id"))).drop("last")
    w = Window.partitionBy(*key).orderBy("frame_no")
    f = f.withColumn("prev", F.lag("status").over(w)).join(state, key)
    prev = F.coalesce("prev", "before")
    runs = f.where(prev.isNull() | (prev != F.col("status"))).select(*key, "frame_no", "t", "status", "last_t")

    first = runs.groupBy(*key).agg(F.min(F.struct("frame_no", "t", "status")).alias("first"))
    first = first.select(*key, F.lead("first").over(chunks).alias("after"))
    runs = runs.withColumn("next", F.lead(F.struct("frame_no", "t", "status")).over(w)).join(first, key).withColumn("next", F.coalesce("next", "after"))
    stop, open_ = F.coalesce("next.t", "last_t"), F.col("next").isNull()
    green = (F.col("status") == "green") & (open_ | (F.col("next.status") == "red") | (F.col("next.t") - F.col("t") > noise))
    red, orange = F.col("status") == "red", F.col("status") == "orange"
    at_frame = F.when(red, F.col("frame_no")).otherwise(F.coalesce("next.frame_no", F.lit((1 << 62) - 1)))  # an open run ends after all
    marks = runs.where(green | red | orange).select(
        "take_id", F.floor(at_frame / chunk).alias("chunk"), F.when(red, F.col("t")).otherwise(stop).alias("at"), F.when(red, 1).when(orange, 2).when(open_, 3).otherwise(0).alias("rank"),
        F.when(red, "point").when(orange, "scroll").otherwise("duration").alias("type"), F.when(orange, stop).otherwise(F.col("t")).alias("start"), F.when(red, F.col("t")).otherwise(stop).alias("end"),
    )
    event = F.col("type") != "scroll"
    count = marks.groupBy(*key).agg(F.count_if(event).alias("n"))
    count = count.select(*key, F.coalesce(F.sum("n").over(chunks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("events_before"))
    marks = marks.withColumn("here", F.sum(event.cast("int")).over(Window.partitionBy(*key).orderBy("at", "rank"))).join(count, key)
    marks = marks.withColumn("event_no", F.col("events_before") + F.col("here") - 1)
    scrolls = marks.where(~event & (F.col("event_no") >= 0)).groupBy("take_id", "event_no").agg(F.max("end").alias("scroll_end"))
    out = marks.where(event).join(scrolls, ["take_id", "event_no"], "left")
    return out.select("take_id", F.col("event_no").cast("int").alias("event_no"), "type", "start", "end", "scroll_end", F.col("scroll_end").isNotNull().alias("if_scroll"))
