"""Clip plans and frame samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampling in seconds: the stride, before an action, after a click, after an action that scrolls.
STRIDE, BEFORE, AFTER_CLICK, AFTER_SCROLL = 0.5, 0.5, 1.2, 0.3
KNOWN = ("click", "input_duration", "init_scroll")


def plan_clips(ops: DataFrame, stem: str = "id") -> DataFrame:
    """clip_path of each operation with a window of positive length; the others keep null."""
    good = F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("end") - F.col("start") > 0)
    return ops.withColumn("clip_path", F.when(good, F.format_string("%s/%s_%.2f_%.2f.mp4", stem, stem, "start", "end")))


def clip_list(ops: DataFrame) -> DataFrame:
    """clip_video_list of each recording in the order of its operations."""
    clips = F.sort_array(F.collect_list(F.when(F.col("clip_path").isNotNull(), F.struct("seg_idx", "op_idx", "clip_path"))))
    return ops.groupBy("id").agg(F.transform(clips, lambda c: c["clip_path"]).alias("clip_video_list"))


def _steps(begin: Column, limit: Column, kind: str) -> Column:
    """Frames at begin, begin + stride, ... as long as they are at most limit, both to two decimals."""
    n = F.floor((F.round(limit, 2) - F.round(begin, 2)) / STRIDE + 2).cast("int")
    times = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: begin + i * STRIDE)
    kept = F.filter(times, lambda t: F.round(t, 2) <= F.round(limit, 2))
    return F.coalesce(F.transform(kept, lambda t: F.struct(t.alias("t"), F.lit(kind).alias("frame_type"))), _none())


def _one(t: Column, kind: str) -> Column:
    return F.filter(F.array(F.struct(t.cast("double").alias("t"), F.lit(kind).alias("frame_type"))), lambda f: f["t"].isNotNull())


def _none() -> Column:
    return F.array().cast("array<struct<t:double,frame_type:string>>")


def plan_frames(ops: DataFrame) -> DataFrame:
    """Id, seg_idx, op_idx, frame_idx, time_seconds, frame_type from subtype, action and if_scroll.

    Operations without a start give no rows. An initial scroll without an end gives one extra ERROR row.
    """
    s, e, ge, f = F.col("start"), F.col("end"), F.col("global_end_time"), F.col("finish")
    a = F.coalesce("global_start_time", "start")
    scroll, select = F.coalesce("if_scroll", F.lit(False)), F.coalesce(F.col("action") == "select", F.lit(False))
    lead = F.greatest(F.lit(0.0), a - BEFORE)
    kind = F.col("subtype")
    frames = (
        F.when((kind == "input_duration") & select & scroll, _steps(lead, F.coalesce(e, a), "during_select_scroll"))
        .when((kind == "input_duration") & select, F.concat(_one(lead, "before_select"), _steps(a, F.coalesce(ge, e, a), "during_select")))
        .when((kind == "input_duration") & scroll, F.concat(_one(lead, "before_input_duration"), F.when(e.isNotNull() & f.isNotNull(), _steps(f + AFTER_SCROLL, e, "after_input_scroll_duration")).otherwise(_none())))
        .when(kind == "input_duration", F.concat(_one(lead, "before_input"), _one(e, "after_input")))
        .when((kind == "click") & scroll, F.concat(_one(lead, "before_click_duration"), F.when(e.isNotNull(), _steps(a + AFTER_SCROLL, e, "after_click_scroll_duration")).otherwise(_none())))
        .when(kind == "click", F.concat(_one(lead, "before_instant_click"), _one(a + AFTER_CLICK, "after_instant_click")))
        .when(kind == "init_scroll", F.concat(_one(s, "before_init_scroll"), F.when(e.isNotNull(), _steps(s + STRIDE, e, "during_init_scroll")).otherwise(_one(s, "ERROR"))))
    )
    rows = ops.where(s.isNotNull()).select("id", "seg_idx", "op_idx", F.posexplode(frames).alias("frame_idx", "f"))
    return rows.select("id", "seg_idx", "op_idx", "frame_idx", F.col("f.t").alias("time_seconds"), "f.frame_type")


def reject_unknown_subtypes(ops: DataFrame) -> DataFrame:
    """Recordings with an operation that has a start and an unknown subtype go as a whole."""
    bad = ops.where(F.col("start").isNotNull() & ~F.coalesce(F.col("subtype"), F.lit("")).isin(*KNOWN)).select("id").distinct()
    return ops.join(bad, "id", "left_anti")


def group_frames(frames: DataFrame) -> DataFrame:
    """C4: the frames of each operation in order, with their image paths."""
    path = F.format_string("%s_seg%d_op%d_t%.2f_%s.jpg", "id", "seg_idx", "op_idx", "time_seconds", "frame_type")
    one = F.struct("frame_idx", "time_seconds", "frame_type", path.alias("image_path"))
    return frames.groupBy("id", "seg_idx", "op_idx").agg(F.sort_array(F.collect_list(one)).alias("extracted_frames"))


def step_frames(frames: DataFrame, step: int, group: str = "take_id", order: str = "frame_no", least: int = 2) -> DataFrame:
    """Every step-th frame of a group, the first included; groups of under ``least`` frames go."""
    w = Window.partitionBy(group)
    out = frames.withColumn("rn", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w))
    return out.where((F.col("n") >= least) & (F.col("rn") % step == 0)).drop("rn", "n")


def uniform_frames(frames: DataFrame, k: int, group: str = "take_id", order: str = "frame_no") -> DataFrame:
    """At most k frames of each group, evenly spread, first and last kept; ties of the spread go to even."""
    w = Window.partitionBy(group)
    out = frames.withColumn("rn", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w))
    if k <= 1:
        return out.where((F.col("rn") == 0) & (k > 0)).drop("rn", "n")
    index = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (F.col("n") - 1) / (k - 1)).cast("int"))
    return out.where((F.col("n") <= k) | F.array_contains(index, F.col("rn"))).drop("rn", "n")


def cap_frames(frames: DataFrame, policy: str = "head", total: int = 49, most_expected: int = 30, cut_expected: int = 26, group: str = "take_id", order: str = "frame_no") -> DataFrame:
    """Image budget over rows with side expected or actual.

    More than 30 expected frames are cut to the first 26; the actual ones get what is left of 49, the
    first ones (head) or evenly spread (uniform)."""
    w = Window.partitionBy(group, "side")
    f = frames.withColumn("rn", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w))
    expected = F.max(F.when(F.col("side") == "expected", F.col("n"))).over(Window.partitionBy(group))
    f = f.withColumn("exp", F.coalesce(F.when(expected > most_expected, cut_expected).otherwise(expected), F.lit(0)).cast("int"))
    left = F.greatest(F.lit(0), total - F.col("exp"))
    index = F.transform(F.sequence(F.lit(0), F.greatest(left - 1, F.lit(1))), lambda i: F.rint(i * (F.col("n") - 1) / F.greatest(left - 1, F.lit(1))).cast("int"))
    spread = (F.col("n") <= left) | ((left > 1) & F.array_contains(index, F.col("rn"))) | ((left == 1) & (F.col("rn") == 0))
    actual = spread if policy == "uniform" else F.col("rn") < left
    return f.where(F.when(F.col("side") == "expected", F.col("rn") < F.col("exp")).otherwise(actual)).drop("rn", "n", "exp")
