"""Timelines: operation windows, balanced splits of long recordings, idle-gap cuts, takes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of a scrolling operation, target weight of a part, padding after a part, the least idle gap.
SCROLL_WEIGHT, TARGET, PADDING, GAP = 4, 10, 0.5, 1.0
#: The time fields of an operation that move with its recording's clock.
OP_TIMES = ("start", "end", "global_start_time", "global_end_time", "global_scroll_end_time")
UNKNOWN_DURATION = 999999.0
#: What the operations of a take are called.
LABELS = {"init": "Init Scroll Operation", "old": "Old Operation", "new": "New Operation"}


def normalize_time(t: Column, unit: float = 0.1) -> Column:
    """To the grid of ``unit`` seconds, half to even, two decimals; null is 0."""
    return F.coalesce(F.round(F.rint(t / unit) * unit, 2), F.lit(0.0))


def seeded(n: int, *parts: Column | str) -> Column:
    """A whole number below n from an md5 of the parts: the same on every run and engine."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % n


def op_windows(ops: DataFrame, seed: int = 7) -> DataFrame:
    """Start, end, finish and the kept offsets of each operation; operations without a window go."""
    key = [F.col("id"), F.col("seg_idx"), F.col("op_idx")]
    before, after = (F.round(seeded(51, *key, side, str(seed)) / 100.0 + 1.0, 2) for side in ("b", "a"))
    g, ge, se = F.col("global_start_time"), F.col("global_end_time"), F.col("global_scroll_end_time")
    kind, scroll = F.col("subtype"), F.coalesce("if_scroll", F.lit(False))
    lead = F.greatest(F.lit(0.0), g - before)
    start = F.when(kind.isin("input_duration", "click"), lead).when(kind == "init_scroll", F.greatest(F.lit(0.0), g)).otherwise(0.0)
    end = F.when(kind.isin("input_duration", "init_scroll"), F.when(scroll, se).otherwise(ge)).when(kind == "click", F.when(scroll, se).otherwise(g + after)).otherwise(0.0)
    finish = F.when(kind.isin("input_duration", "init_scroll") & scroll, ge)
    used = (kind == "click") & ~scroll | ~F.coalesce(kind, F.lit("")).isin("click", "input_duration", "init_scroll")
    out = ops.where(g.isNotNull()).withColumn("before", before).withColumn("after", F.when(used, after).otherwise(0.0))
    out = out.withColumn("start", normalize_time(start)).withColumn("end", F.when(end.isNotNull(), normalize_time(end)))
    finish = F.when(finish.isNotNull(), normalize_time(finish))
    return out.withColumn("finish", F.when(finish != 0, finish)).where(F.col("end").isNotNull())


def nest(ops: DataFrame, *fields: str) -> DataFrame:
    """One row a recording: segments ARRAY<STRUCT<seg_idx, ops ARRAY<STRUCT<op_idx, fields>>>>, in order."""
    segs = ops.groupBy("id", "seg_idx").agg(F.sort_array(F.collect_list(F.struct("op_idx", *fields))).alias("ops"))
    return segs.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("seg_idx", "ops"))).alias("segments"))


def build_timeline_dataset(ops: DataFrame, inventory: DataFrame, seed: int = 7) -> DataFrame:
    """Nested recordings whose file exists; segments and recordings left without operations are gone."""
    fields = ["subtype", "action", "if_scroll", "start", "end", "finish", "before", "after"]
    return nest(op_windows(ops.join(inventory.select("id"), "id", "left_semi"), seed), *fields)


def segment_weight(ops: Column) -> Column:
    """T4: operations of a segment, a scrolling one counted as four."""
    return F.aggregate(ops, F.lit(0), lambda s, o: s + F.when(o["if_scroll"], SCROLL_WEIGHT).otherwise(1))


def assign_parts(weights: Column, target: int = TARGET) -> Column:
    """T5: the part (from 0) of each segment, from the array of segment weights.

    ceil(total / target) parts of contiguous segments; a part closes where it is nearer to the even share
    without the next segment; the last takes the rest. Each step needs the one before, so it is one pass over
    the recording's own array in Arrow batches, in time proportional to its length, and no shuffle.
    """

    @F.pandas_udf("array<int>")
    def walk(arrays: pd.Series) -> pd.Series:
        def parts(found: list[int] | None) -> list[int] | None:
            if found is None:
                return None
            total = int(sum(found))
            count = 1 if total <= target else -(-total // target)
            share, part, now, out = total / count, 0, 0, []
            for w in found:
                if part < count - 1 and now > 0 and abs(now - share) < abs(now + w - share):
                    part, now = part + 1, 0
                out.append(part)
                now += w
            return out

        return arrays.map(parts)

    return walk(weights)


def split_recordings(recordings: DataFrame) -> DataFrame:
    """id, part, segments of each part, from nested recordings."""
    weights = F.transform("segments", lambda s: segment_weight(s["ops"]))
    placed = recordings.withColumn("parts", assign_parts(weights))
    first = F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: (i == 0) | (F.get("parts", i) != F.get("parts", i - 1)))
    placed = placed.where(F.size("parts") > 0).withColumn("first", first)
    pieces = F.transform("first", lambda at, k: F.slice("segments", at + 1, F.coalesce(F.get("first", k + 1), F.size("parts")) - at))
    return placed.select("id", F.posexplode(pieces).alias("part", "segments"))


def part_bounds(parts: DataFrame, durations: DataFrame) -> DataFrame:
    """Start and end of each part (the last has no end), from its first start and last end.

    A part that begins within 0.1 s of the recording's end goes, unless it is the last, and then later
    parts keep its start; a part without positive length goes, but the next starts at its end."""
    p = parts.withColumn("first_start", F.expr("segments[0].ops[0].start")).withColumn("last_end", F.expr("element_at(element_at(segments, -1).ops, -1).end"))
    p = p.join(durations.select("id", "duration"), "id", "left").withColumn("duration", F.coalesce(F.when(F.col("duration") > 0, F.col("duration")), F.lit(UNKNOWN_DURATION)))
    w = Window.partitionBy("id").orderBy("part")
    following = F.lead("first_start").over(w)
    split = F.least(F.greatest(F.least(F.col("last_end") + PADDING, following), F.col("last_end")), F.col("duration"))
    p = p.withColumn("stop", F.when(following.isNotNull(), split))
    p = p.withColumn("begin", F.coalesce(F.lag("stop").over(w), F.lit(0.0)))
    late = F.first(F.when(F.col("begin") >= F.col("duration") - 0.1, F.col("begin")), ignorenulls=True).over(w)
    p = p.withColumn("begin", F.coalesce(late, "begin"))
    gone = F.col("stop").isNotNull() & ((F.col("begin") >= F.col("duration") - 0.1) | (F.col("stop") <= F.col("begin")))
    return p.where(~gone).drop("first_start", "last_end", "duration")


def rebase_times(segments: Column, offset: Column, names: tuple[str, ...] = OP_TIMES, fields: tuple[str, ...] = (), shift_finish: bool = False) -> Column:
    """max(0, t - offset) on the time fields of each operation; the finish stays on the old clock
    unless asked for. fields: those of the operation struct, so that only existing ones are touched."""
    moved = [n for n in names + (("finish",) if shift_finish else ()) if n in fields]

    def op(o: Column) -> Column:
        for n in moved:
            o = o.withField(n, F.greatest(F.lit(0.0), o[n] - offset))
        return o

    return F.transform(segments, lambda s: s.withField("ops", F.transform(s["ops"], op)))


def prepend_init_scroll(parts: DataFrame, recordings: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Parts (id, part, begin, segments) that lack the recording's first init_scroll segment get it,
    rebased to 0, in front; their own times move by begin less its length. A recording without one gives them nothing."""
    is_init = lambda s: F.get(s["ops"], F.lit(0))["subtype"].eqNullSafe("init_scroll")
    init = recordings.select("id", F.get(F.filter("segments", is_init), F.lit(0)).alias("init"))  # null where there is none
    p = parts.join(init, "id", "left")
    start = F.col("init.ops")[0]["start"]
    length = F.coalesce(F.element_at(F.col("init.ops"), -1)["end"], start + 3.0) - start
    wanted = F.col("init").isNotNull() & ~F.exists("segments", is_init)
    p = p.withColumn("with_init", wanted).withColumn("offset", F.col("begin") - F.when(wanted, length).otherwise(0.0))
    body = rebase_times(F.col("segments"), F.col("offset"), fields=fields)
    head = rebase_times(F.array("init"), start, fields=fields)
    return p.withColumn("segments", F.when(wanted, F.concat(head, body)).otherwise(body)).drop("init")


def idle_cuts(segments: DataFrame, gap: float = GAP) -> DataFrame:
    """Id, start, end of each cut. segments: id, pos, n_ops, subtype, if_scroll, first_start, last_end.

    After a segment of one click without scrolling, a longer pause than ``gap`` is cut to ``gap``."""
    following = F.lead("first_start").over(Window.partitionBy("id").orderBy("pos"))
    special = (F.col("n_ops") == 1) & F.col("subtype").contains("click") & ~F.coalesce("if_scroll", F.lit(False))
    s = segments.withColumn("next_start", following).where(special & (F.col("next_start") - F.col("last_end") > gap))
    return s.select("id", (F.col("last_end") + gap / 2).alias("start"), (F.col("next_start") - gap / 2).alias("end"))


def apply_cuts(t: Column, cuts: Column) -> Column:
    """A time with all cuts before it taken out, and as much as it is inside of one; not below 0."""
    gone = F.aggregate(cuts, F.lit(0.0), lambda s, c: s + F.when(t >= c["end"], c["end"] - c["start"]).when(t > c["start"], t - c["start"]).otherwise(0.0))
    return F.greatest(F.lit(0.0), t - F.coalesce(gone, F.lit(0.0)))


def cut_times(times: DataFrame, cuts: DataFrame, column: str = "start", block: float = 600.0) -> DataFrame:
    """T10 as tables: times (id, column, any others) with ``column`` shifted by the cuts (id, start, end) of its id.

    A sweep: cuts open and close between the times, and a running window over them tells how much has closed
    and what is open. No pair of a time and a cut is ever made. The sweep goes by blocks of ``block`` seconds,
    so a recording of any length is spread over tasks; a block takes what came before it from the sums of the
    earlier blocks, of which there is one row each. A null time stays null; a null id has no cuts."""
    rows = times.select(F.col("id").alias("__id"), F.col(column).cast("double").alias("__at"), F.struct("*").alias("__row"))
    length, none = F.col("end") - F.col("start"), F.lit(None).cast(rows.schema["__row"].dataType)
    marks = cuts.where((length > 0) & F.col("id").isNotNull()).select(
        F.col("id").alias("__id"),
        F.explode(F.array(
            F.struct(F.col("start").cast("double").alias("__at"), F.lit(0.0).alias("__gone"), F.lit(1).alias("__open"), F.col("start").cast("double").alias("__since")),
            F.struct(F.col("end").cast("double").alias("__at"), length.cast("double").alias("__gone"), F.lit(-1).alias("__open"), (-F.col("start")).cast("double").alias("__since")),
        )).alias("__m"),
    ).select("__id", "__m.*", none.alias("__row"))
    sweep = rows.select("__id", "__at", F.lit(0.0).alias("__gone"), F.lit(0).alias("__open"), F.lit(0.0).alias("__since"), "__row").union(marks.select("__id", "__at", "__gone", "__open", "__since", "__row"))
    sums = ["__gone", "__open", "__since"]
    sweep = sweep.withColumn("__block", F.floor(F.col("__at") / block))
    earlier = Window.partitionBy("__id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    # a block that cuts touch brings its sums along; the next ones take them from the latest such block
    carry = sweep.where("__row is null").groupBy("__id", "__block").agg(*(F.sum(c).alias(c) for c in sums))
    carry = carry.select("__id", "__block", *((F.coalesce(F.sum(c).over(earlier), F.lit(0)) + F.col(c)).alias(f"{c}_by") for c in sums))
    blocks = sweep.select("__id", "__block").distinct().join(carry, ["__id", "__block"], "left")
    before = [F.last(f"{c}_by", ignorenulls=True).over(earlier).alias(f"{c}_before") for c in sums]
    within = Window.partitionBy("__id", "__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = sweep.join(blocks.select("__id", "__block", *before), ["__id", "__block"], "left")
    gone, count, since = (F.coalesce(f"{c}_before", F.lit(0)) + F.sum(c).over(within) for c in sums)
    out = out.select("__row", "__at", gone.alias("gone"), count.alias("open"), since.alias("since")).where("__row is not null")
    shifted = F.greatest(F.lit(0.0), F.col("__at") - F.col("gone") - F.when(F.col("open") > 0, F.col("open") * F.col("__at") - F.col("since")).otherwise(0.0))
    shifted = F.when(F.col("__at").isNotNull(), F.coalesce(shifted, F.greatest(F.lit(0.0), F.col("__at"))))
    return out.select(*(shifted.alias(c) if c == column else F.col("__row")[c].alias(c) for c in times.columns))


def keep_intervals(cuts: DataFrame, durations: DataFrame, least: float = 0.1) -> DataFrame:
    """What the cuts leave of [0, duration): id, start, end; pieces of ``least`` seconds or less go."""
    marks = cuts.select("id", "start", "end").unionByName(durations.select("id", F.col("duration").alias("start"), F.col("duration").alias("end"))).repartition("id")
    before = F.coalesce(F.lag("end").over(Window.partitionBy("id").orderBy("start", "end")), F.lit(0.0))
    kept = marks.withColumn("before", before).select("id", F.col("before").alias("start"), F.col("start").alias("end"))
    return kept.where(F.col("end") - F.col("start") > least)


def finalize_parts(parts: DataFrame, fields: tuple[str, ...] = ()) -> DataFrame:
    """The part's own id and path, segments numbered anew, times to three decimals."""

    def op(o: Column) -> Column:
        for n in fields:
            o = o.withField(n, F.round(o[n], 3))
        return o

    segments = F.transform("segments", lambda s, i: s.withField("seg_idx", i).withField("ops", F.transform(s["ops"], op)))
    number = (F.col("part") + 1).cast("string")
    path = F.concat(F.lit("./splitted_videos/"), F.col("id"), F.lit("_part"), number, F.lit(".mp4"))
    return parts.withColumn("segments", segments).withColumn("video_path", path).withColumn("id", F.concat("id", F.lit("_part"), number))


def drop_prefix_takes(takes: DataFrame) -> DataFrame:
    """Takes whose name is a proper beginning of another take's name of the recording go.

    In binary order all extensions of a name follow it at once, so one look ahead decides."""
    names = takes.select("id", "name").distinct()
    ahead = F.lead("name").over(Window.partitionBy("id").orderBy("name"))
    gone = names.withColumn("next", ahead).where(F.col("next").startswith(F.col("name"))).select("id", "name")
    return takes.join(gone, ["id", "name"], "left_anti")


def op_labels() -> Column:
    """The operations that a take should show, of is_init_scroll, old_moments and new_moments."""
    many = lambda label, c: F.array_repeat(F.lit(label), F.size(F.coalesce(F.col(c), F.array().cast("array<double>"))))
    return F.when(F.coalesce("is_init_scroll", F.lit(False)), F.array(F.lit(LABELS["init"]))).otherwise(F.concat(many(LABELS["old"], "old_moments"), many(LABELS["new"], "new_moments")))


def take_events(takes: DataFrame, events: DataFrame, green: DataFrame) -> DataFrame:
    """The events (T16) of each take by id and take_no; take_id names a take's frames.

    Of a take that is the first scroll all green durations are one, from the first start to the last end."""
    named = takes.select("id", "take_no", "take_id", F.coalesce("is_init_scroll", F.lit(False)).alias("init"))
    whole = green.groupBy("take_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    whole = whole.select("take_id", F.lit(0).alias("event_no"), F.lit("duration").alias("type"), "start", "end", F.col("end").alias("scroll_end"), F.lit(True).alias("if_scroll"))
    out = events.join(named.where(~F.col("init")), "take_id").unionByName(whole.join(named.where("init"), "take_id"))
    return out.select("id", "take_no", "event_no", "type", "start", "end", "scroll_end", "if_scroll")


def accept_takes(takes: DataFrame, events: DataFrame) -> DataFrame:
    """Passed takes with as many events (take_events) as operations they should show."""
    n = events.groupBy("id", "take_no").agg(F.count("*").alias("__n"))
    return takes.where("pass_flag").join(n, ["id", "take_no"], "left").where(F.size(op_labels()) == F.coalesce("__n", F.lit(0))).drop("__n")


def assemble_timeline(takes: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """The segments of a recording's timeline: accepted takes (all without accepted) one after another.
    A segment's index counts the takes that were not accepted too."""
    t = takes.withColumn("__ok", F.lit(True))
    if accepted is not None:
        t = takes.join(accepted.select("id", "take_no", F.lit(True).alias("__ok")), ["id", "take_no"], "left").withColumn("__ok", F.coalesce("__ok", F.lit(False)))
    order = Window.partitionBy("id").orderBy("take_no")
    start = F.coalesce(F.sum(F.when(F.col("__ok"), F.col("duration")).otherwise(0.0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    t = t.withColumn("__start", start).withColumn("segment_index", F.row_number().over(order) - 1).where("__ok")
    return t.select("id", "take_no", "name", "segment_index", F.round("__start", 3).alias("segment_start_time"), F.round(F.col("__start") + F.col("duration"), 3).alias("segment_end_time"))


def assemble_operations(timeline: DataFrame, events: DataFrame, takes: DataFrame) -> DataFrame:
    """Operation rows of the timeline: the events of each take (take_events) with its labels and
    actions_detail by position. A point's global start is one second after its mark; its global end has no
    such second. The first scroll has no action and always scrolls."""
    labels = takes.select("id", "take_no", op_labels().alias("labels"), "actions_detail")
    e = timeline.join(events, ["id", "take_no"]).join(labels, ["id", "take_no"]).withColumn("label", F.get("labels", F.col("event_no"))).where("label is not null")
    point, init = F.col("type") == "point", F.col("label") == LABELS["init"]
    base, scroll = F.col("segment_start_time"), F.coalesce("if_scroll", F.lit(False)) | init
    return e.select(
        "id", "segment_index", F.col("event_no").alias("op_idx"), F.col("label").alias("type"), F.when(point, "click").when(init, "init_scroll").otherwise("input_duration").alias("subtype"),
        (~point | scroll).alias("is_duration"), scroll.alias("if_scroll"), F.round(base + F.when(point, F.col("start") + 1.0).otherwise(F.col("start")), 3).alias("global_start_time"),
        F.round(base + F.col("end"), 3).alias("global_end_time"), F.when(scroll, F.round(base + F.col("scroll_end"), 3)).alias("global_scroll_end_time"),
        F.when(~point, F.round(F.col("end") - F.col("start"), 3)).alias("duration_seconds"), F.when(~init, F.get("actions_detail", F.col("event_no"))).alias("action_detail"),
    )
