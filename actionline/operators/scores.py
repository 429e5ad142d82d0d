"""Evaluation scores: from verifier text and replay reports to task, directory and global means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actionline.functions.rounding import exact_ratio, fixed


def parse_scores(df: DataFrame, column: str = "output") -> DataFrame:
    """visual_score from the first \\score{...} (-1 stays, others clamp to 0..100, unreadable gives 0) and
    functional_score from \\passed{...} (success or failed; failed by default)."""
    body = F.trim(F.regexp_extract(column, r"\\score\{([^}]*)\}", 1))
    number = F.regexp_extract(body, r"(-?\d+)", 1).try_cast("int")
    visual = F.when(number == -1, -1).when(number.isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), number)))
    passed = F.lower(F.trim(F.regexp_extract(column, r"\\passed\{([^}]*)\}", 1)))
    return df.withColumn("visual_score", visual.cast("int")).withColumn("functional_score", F.when(passed == "success", "success").otherwise("failed"))


def report_entries(reports: DataFrame) -> DataFrame:
    """Functional (success, failed or null), visual and homepage without the sentinel -1, is_match.

    A success without comparable visuals (-1) is a failure."""
    known = F.when(F.col("functional_score").isin("success", "failed"), F.col("functional_score"))
    functional = F.when((known == "success") & (F.coalesce("visual_score", F.lit(0)) == -1), "failed").otherwise(known)
    clean = lambda c: F.when(F.col(c) != -1, F.col(c))
    return (
        reports.withColumn("functional", functional).withColumn("visual", clean("visual_score")).withColumn("homepage", clean("homepage_score"))
        .withColumn("is_match", F.coalesce(F.col("visual") >= 60, F.lit(False))).drop("functional_score", "visual_score", "homepage_score")
    )


def resolve_candidates(entries: DataFrame) -> DataFrame:
    """One entry per (dir, task_id, base_timeline).

    Of equal slots the last path counts. The candidate replaces the original only where it succeeds and
    the original does not, or where there is no original."""
    slot = Window.partitionBy("dir", "task_id", "base_timeline", "is_candidate").orderBy(F.desc("path"))
    pick = Window.partitionBy("dir", "task_id", "base_timeline").orderBy(F.desc(F.coalesce(F.col("functional") == "success", F.lit(False))), "is_candidate")
    last = entries.withColumn("rn", F.row_number().over(slot)).where("rn = 1")
    return last.withColumn("rn", F.row_number().over(pick)).where("rn = 1").drop("rn")


def task_scores(entries: DataFrame) -> DataFrame:
    """Per (dir, task_id) the visual mean over successes, with the mean homepage score as one more point
    where there is any normal one, and the functional mean over all entries. Scores are whole numbers; means
    are rounded on the exact ratio, ties to even."""
    won = F.col("functional") == "success"
    g = entries.groupBy("dir", "task_id").agg(
        F.count("*").alias("n_entries"), F.count_if(won).alias("n_success"), F.count(F.when(won, F.col("visual"))).alias("n_visual"),
        F.coalesce(F.sum(F.when(won, F.col("visual")).cast("long")), F.lit(0)).alias("visual_sum"), F.count("homepage").alias("n_home"),
        F.coalesce(F.sum(F.col("homepage").cast("long")), F.lit(0)).alias("home_sum"), F.sum("no_action").alias("n_no_action"),
    )
    # with the homepage's mean as one more point, all over its count
    some, n = F.col("n_home") > 0, F.greatest(F.col("n_home"), F.lit(1))
    top = F.col("visual_sum") * n + F.when(some, F.col("home_sum")).otherwise(0)
    visual = F.when(F.col("n_visual") > 0, exact_ratio(top, n * (F.col("n_visual") + some.cast("int")), 2))
    return g.select(
        "dir", "task_id", "n_entries", "n_success", "n_visual", visual.alias("visual_mean"), exact_ratio(F.col("n_success"), F.col("n_entries"), 4).alias("functional_mean"),
        F.format_string("%d/%d", "n_success", "n_entries").alias("rate"), F.col("n_no_action").cast("long").alias("n_no_action"),
    )


def _mean(column: str, digits: int) -> Column:
    """The mean of rounded values, from the exact sum of their last places."""
    return exact_ratio(F.sum(fixed(F.col(column), digits)), F.count(column) * 10**digits, digits)


def dir_scores(tasks: DataFrame) -> DataFrame:
    """E5: means of the rounded task means of a directory, with the counts of tasks behind them; exact sums,
    ties to even, so no order of the tasks gives another mean."""
    return tasks.groupBy("dir").agg(
        _mean("visual_mean", 2).alias("visual_mean"), _mean("functional_mean", 4).alias("functional_mean"),
        F.count("*").alias("n_tasks"), F.count("visual_mean").alias("n_tasks_visual"),
    )


def global_scores(dirs: DataFrame) -> DataFrame:
    """Means of directory means, by the same rule."""
    return dirs.agg(
        _mean("visual_mean", 2).alias("visual_mean"), _mean("functional_mean", 4).alias("functional_mean"),
        F.count("*").alias("n_dirs"), F.coalesce(F.sum("n_tasks"), F.lit(0)).alias("n_tasks"),
    )


def task_detail(entries: DataFrame) -> DataFrame:
    """The entries of a task in the order of their timelines, as one text."""
    part = F.concat_ws(":", "base_timeline", F.coalesce("functional", F.lit("-")), F.coalesce(F.col("visual").cast("string"), F.lit("-")))
    number = F.regexp_extract("base_timeline", r"(\d+)$", 1).try_cast("int")
    listed = F.sort_array(F.collect_list(F.struct(number.alias("n"), part.alias("part"))))
    return entries.groupBy("dir", "task_id").agg(F.array_join(F.transform(listed, lambda x: x["part"]), ",").alias("detail"))


def numeric_prefix(column: str) -> Column:
    return F.regexp_extract(column, r"^(\d+)", 1).try_cast("long")


def task_order(df: DataFrame, column: str = "task_id") -> DataFrame:
    """Rows in the order of the leading number of the id, ids without one last, then by text."""
    return df.orderBy(numeric_prefix(column).asc_nulls_last(), column)


def step_counts(steps: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run the steps by outcome and the actions that were executed."""
    t = F.col("type")
    return steps.groupBy(run).agg(
        F.count("*").alias("total_steps"), F.count_if(t == "success").alias("success"), F.count_if(t == "skip").alias("no_action"),
        F.count_if(t == "fail").alias("failed"), F.count_if(t != "skip").alias("executed"),
    )


def match_tasks(pages: DataFrame, frames: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The ids that both have, and those that only one has, with the side (page or frames)."""
    p, f = pages.select(key).distinct(), frames.select(key).distinct()
    only = p.join(f, key, "left_anti").withColumn("side", F.lit("page")).union(f.join(p, key, "left_anti").withColumn("side", F.lit("frames")))
    return p.join(f, key, "left_semi"), only


def frame_sets(frames: DataFrame) -> DataFrame:
    """Id and its segments ARRAY<STRUCT<segment_name, operations>>, both in the order of the numbers that
    their names end in. frames: id, segment_name, operation_name; names without a number come last, by name."""
    number = lambda c: F.coalesce(F.regexp_extract(c, r"_(\d+)$", 1).try_cast("long"), F.lit((1 << 63) - 1))
    rows = frames.select("id", "segment_name", "operation_name").distinct()
    ops = rows.groupBy("id", "segment_name").agg(F.sort_array(F.collect_list(F.struct(number("operation_name").alias("no"), F.col("operation_name").alias("name")))).alias("ops"))
    ops = ops.select("id", F.struct(number("segment_name").alias("no"), "segment_name", F.transform("ops", lambda x: x["name"]).alias("operations")).alias("s"))
    return ops.groupBy("id").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: F.struct(s["segment_name"].alias("segment_name"), s["operations"].alias("operations"))).alias("segments"))


def replay_set(solid: DataFrame, matched: DataFrame, key: str = "id") -> DataFrame:
    """Tasks to run again: solid-coloured ones that can be matched."""
    return matched.join(solid.select(key), key, "left_semi")


def pending_tasks(tasks: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Tasks without a finished run."""
    return tasks.join(done.select(key), key, "left_anti")


def append_run(history: DataFrame, results: DataFrame, run: str) -> DataFrame:
    """History with this run's counts by status."""
    now = results.groupBy(F.col("type").alias("status")).agg(F.count("*").alias("n")).select(F.lit(run).alias("run"), "status", "n")
    return history.unionByName(now)


def homepage_targets(ops: DataFrame) -> DataFrame:
    """Of each recording the first operation of the first segment, unless its first action is a scroll."""
    first = Window.partitionBy("id").orderBy("seg_idx", "op_idx")
    return ops.withColumn("rn", F.row_number().over(first)).where("rn = 1").where(F.coalesce(F.col("action"), F.lit("scroll")) != "scroll").drop("rn")
