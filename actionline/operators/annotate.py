"""Annotation inputs and the round controller."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actionline.operators.membership import not_in

#: What an operation acts on when the page gives no text.
GENERIC = {"click": "a button", "input": "an input field", "select": "a select box"}
#: Kinds of frames and what they show; all others are transitions.
FRAME_LABELS = {
    "before_click_duration": "before the operation", "before_instant_click": "before the operation", "before_input": "before the operation",
    "before_init_scroll": "before the operation", "before_select": "before the operation", "after_click_scroll_duration": "scrolling through new content",
    "during_init_scroll": "scrolling only", "after_instant_click": "right after the operation", "after_input": "final state",
    "during_select": "while selecting", "during_select_scroll": "while selecting and scrolling",
}


def _blank(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c))


def describe_action(action: str = "action", text: str = "dom_text", value: str | None = None, chosen: str | None = None) -> Column:
    """The action in words, with the element's text or a generic name for it; a scroll without action.
    value: the column of what was typed; chosen: that of what was selected."""
    target = _blank(text)
    for k, v in GENERIC.items():
        target = F.coalesce(target, F.when(F.col(action) == k, v))
    target = F.coalesce(target, F.lit("an element"))
    given, picked = (F.coalesce(F.col(c), F.lit("")) if c else F.lit("") for c in (value, chosen))
    return (
        F.when(F.col(action).isNull(), "scrolls the page without a mouse operation").when(F.col(action) == "click", F.concat(F.lit("clicks '"), target, F.lit("'")))
        .when(F.col(action) == "input", F.concat(F.lit("enters '"), given, F.lit("' into '"), target, F.lit("'")))
        .when(F.col(action) == "select", F.concat(F.lit("selects '"), picked, F.lit("' in '"), target, F.lit("'")))
        .otherwise(F.concat(F.lit("does "), F.col(action), F.lit(" on '"), target, F.lit("'")))
    )


def op_nature(variant: str = "reasoning") -> Column:
    """The nature of an operation; the reasoning variant tells selections apart, the tool_call one doesn't."""
    kind, scroll = F.col("subtype"), F.coalesce("if_scroll", F.lit(False))
    select = F.coalesce(F.col("action") == "select", F.lit(False)) if variant == "reasoning" else F.lit(False)
    return (
        F.when(kind == "init_scroll", "scroll").when((kind == "click") & scroll, "instant then scroll").when((kind == "input_duration") & select & scroll, "selection then scroll")
        .when((kind == "input_duration") & select, "selection").when((kind == "input_duration") & scroll, "continuous then scroll").when(kind == "input_duration", "continuous").otherwise("instant")
    )


def frame_label(column: str = "frame_type") -> Column:
    """What a frame shows, by its type."""
    out = F.lit("transition")
    for k, v in FRAME_LABELS.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def number_ops_images(ops: DataFrame, n_frames: str = "n_frames", skip_open: bool = True) -> DataFrame:
    """op_no, first_img, last_img over the recording. skip_open: operations without start or end take no
    number and no images (tool calls); else they count (reasoning). Without frames: a number, no images."""
    o = ops.where(F.col("start").isNotNull() & F.col("end").isNotNull()) if skip_open else ops
    w = Window.partitionBy("id").orderBy("seg_idx", "op_idx").rowsBetween(Window.unboundedPreceding, 0)
    n = F.coalesce(F.col(n_frames), F.lit(0)).cast("long")
    last = F.sum(n).over(w)
    return o.withColumn("op_no", F.count("*").over(w)).withColumn("first_img", F.when(n > 0, last - n + 1)).withColumn("last_img", F.when(n > 0, last))


def build_annotation_inputs(ops: DataFrame, frames: DataFrame, variant: str = "reasoning", legacy: bool = False) -> DataFrame:
    """P5: id, instruction, images of a recording.

    variant: tool_call (times, only operations with frames are told), reasoning (all operations, each
    frame told), page_code (by segment). legacy: the page-code variant then tells every action as a
    scroll, as data without action details does. frames: the grouped frames of C4. ops: typed and selected
    values are told where it has the columns input_val and value.
    """
    o = ops.join(frames, ["id", "seg_idx", "op_idx"], "left").withColumn("n_frames", F.coalesce(F.size("extracted_frames"), F.lit(0)))
    o = o.withColumn("n_frames", F.greatest("n_frames", F.lit(0)))
    o = number_ops_images(o, skip_open=variant == "tool_call")
    action = F.lit("scrolls the page without a mouse operation") if legacy and variant == "page_code" else describe_action(value="input_val" if "input_val" in ops.columns else None, chosen="value" if "value" in ops.columns else None)
    span = F.format_string("images %d to %d", "first_img", "last_img")
    told = F.transform("extracted_frames", lambda f, i: F.concat(F.lit("    * image "), (F.col("first_img") + i).cast("string"), F.lit(": "), _label_of(f["frame_type"])))
    if variant == "tool_call":
        line = F.when(F.col("n_frames") > 0, F.concat(F.format_string("## %d\n  - from %.1f to %.1f\n  - ", "op_no", "start", "end"), action, F.lit(" ("), op_nature("tool_call"), F.lit(")\n  - "), span, F.lit("\n"))).otherwise("")
    elif variant == "reasoning":
        body = F.when(F.col("n_frames") > 0, F.concat(F.lit("\n  - "), span, F.lit("\n"), F.array_join(told, "\n"))).otherwise("")
        line = F.concat(F.format_string("## %d ", "op_no"), action, F.lit(" - "), op_nature(), body, F.lit("\n"))
    else:
        w = Window.partitionBy("id", "seg_idx").orderBy("op_idx")
        head = F.when(F.row_number().over(w) == 1, F.format_string("## segment %d:\n", F.col("seg_idx") + 1)).otherwise("")
        o = o.where("n_frames > 0")
        line = F.concat(head, F.format_string("  - %d: ", F.col("op_idx") + 1), action, F.lit("\n    "), span, F.lit("\n"), F.array_join(told, "\n"))
    o = o.withColumn("line", line)
    images = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seg_idx", "op_idx", F.coalesce(F.transform("extracted_frames", lambda f: f["image_path"]), F.array().cast("array<string>")).alias("p")))), lambda x: x["p"]))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("seg_idx", "op_idx", "line"))), lambda x: x["line"])
    return o.groupBy("id").agg(F.array_join(lines, "\n").alias("instruction"), images.alias("images"))


def _label_of(kind: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in FRAME_LABELS.items() for x in pair])
    return F.coalesce(F.element_at(names, kind), F.lit("transition"))


def remaining(items: DataFrame, done: DataFrame, key: str = "id", large: bool = False) -> DataFrame:
    """Rows whose key is not among the finished ones; null keys match null keys.

    large: for sets of finished keys that no task can hold; a filter keeps rows that are surely left from
    being shuffled."""
    if large:
        return not_in(items, done, key)
    d = done.select(F.col(key).alias("__done")).distinct()
    return items.join(d, items[key].eqNullSafe(d["__done"]), "left_anti")


def run_rounds(items: DataFrame, step: Callable[[DataFrame, int], DataFrame], write: Callable[[DataFrame, int], DataFrame], max_rounds: int = 3, stop_ratio: float = 0.0, key: str = "id") -> DataFrame:
    """Step on what is left, round after round; the union of all outputs.

    write stores a round's output and reads it back, so lineage stays short. Ends after max_rounds or as
    soon as the share of items left is at most stop_ratio. The driver sees counts alone.
    """
    total, left, out = items.count(), items, None
    for k in range(max_rounds):
        got = write(step(left, k), k)
        out = got if out is None else out.unionByName(got)
        left = remaining(left, got, key)
        if not total or left.count() / total <= stop_ratio:
            break
    return out


def quality_gate(df: DataFrame, text: str, n_ops: str, min1: int = 0, min2: int = 0) -> DataFrame:
    """Texts of at least min1 characters for one operation, min2 for more; 0 turns a limit off."""
    least = F.when(F.col(n_ops) >= 2, min2).otherwise(min1)
    return df.where(F.coalesce(F.length(text), F.lit(0)) >= least)
