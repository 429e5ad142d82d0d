"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actionline.operators.assemble import last_by_id, strip  # noqa: F401
from actionline.schemas import RECORDING, REPORT
from actionline.sources import files
from actionline.sources.shared import stored


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a file; id is the file's name without suffix. Files that can't be read go."""
    df = spark.read.schema(RECORDING).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").json(path)
    return df.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("id"), "*")


def recording_ops(recordings: DataFrame) -> DataFrame:
    """Operation rows (id, seg_idx, op_idx, the operation's fields) of recordings as read."""
    s = recordings.select("id", F.posexplode("action_frames_timeline_filtered").alias("seg_idx", "s"))
    o = s.select("id", "seg_idx", F.posexplode("s.operations").alias("op_idx", "o"))
    text = F.coalesce(F.when(F.col("action_detail.dom_info.attrs")["text"] != "", F.col("action_detail.dom_info.attrs")["text"]), F.col("action_detail.dom_info.visible_text"))
    out = o.select("id", "seg_idx", "op_idx", "o.*").withColumn("dom_text", F.coalesce(text, F.lit("")))
    return out.withColumns({x: F.col(f"action_detail.{x}") for x in ("action", "input_val", "value")})


def read_jsonl(spark: SparkSession, path: str, schema: str, count_bad: bool = False) -> DataFrame:
    """JSON lines; blank and unreadable lines are left out, or kept in _bad with count_bad."""
    if count_bad:
        return spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def load_urls(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct trimmed urls at their first place (line_no, url), and the count of lines without one."""
    clean = lines.withColumn("url", strip(F.col("url")))
    bad = F.coalesce(F.col("url"), F.lit("")) == ""
    first = clean.where(~bad).groupBy("url").agg(F.min("line_no").alias("line_no"))
    return first.select("line_no", "url"), clean.where(bad).agg(F.count("*").alias("n_bad"))


def merge_worker_outputs(outputs: list[DataFrame], key: str = "id") -> DataFrame:
    """All workers' rows in the order of their ids: numbers first, then text."""
    out = outputs[0]
    for o in outputs[1:]:
        out = out.unionByName(o, allowMissingColumns=True)
    return out.orderBy(F.col(key).try_cast("long").asc_nulls_last(), key)


def placed(df: DataFrame, name: str = "place") -> DataFrame:
    """The place (from 1) of each row of a sorted frame. Rows keep their order in partitions and partitions
    keep theirs; they are stored with it once, so only the partitions' sizes meet in one task."""
    local = stored(df.withColumn("__at", F.monotonically_increasing_id()), "placed").withColumn("__part", F.shiftright("__at", 33))
    sizes = local.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))  # a row for each partition
    rank = F.col("__at") - F.shiftleft(F.col("__part"), 33) + 1
    return local.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + rank).drop("__at", "__part", "__before")


def success_counts(merged: DataFrame) -> DataFrame:
    """Rows and successful ones."""
    return merged.agg(F.count("*").alias("n"), F.count_if("success").alias("n_success"))


#: Where a report lies: task_<t>/segment_<s>/operation_<o>, or task_<t>/timeline_<n>[_candidate].
LAYOUTS = {
    "synthesis": (r"task_([^/]+)/segment_(\d+)/operation_(\d+)", ("task_id", "segment", "operation")),
    "real": (r"task_([^/]+)/(timeline_\d+)(_candidate)?/", ("task_id", "base_timeline", "candidate")),
}


def parsed(texts: DataFrame, schema: str) -> DataFrame:
    """The rows that Spark's reader of whole JSON files finds in texts (path, content), malformed ones dropped: the value
    of a file, or each element where it is a list; a file with a malformed element goes as a whole."""
    items = F.when(F.col("content").rlike(r"^[ \t\r\n]*\["), F.from_json("content", "array<string>")).otherwise(F.array("content"))
    rows = F.transform(items, lambda x: F.from_json(x, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    df = texts.select("path", rows.alias("rows")).where(F.forall("rows", lambda r: r.isNotNull() & r["_bad"].isNull()))
    return df.select("path", F.inline("rows")).drop("_bad")


def read_reports(spark: SparkSession, path: str, layout: str = "real") -> DataFrame:
    """Reports below a folder with the parts of their path; files elsewhere are left out.

    real: dir, task_id, base_timeline, is_candidate, path and the scores that E2 takes."""
    pattern, names = LAYOUTS[layout]
    found = files.read_texts(spark, path, ".json", pattern)
    if found is None:  # a store that only Spark can list, a pattern of paths, or no such folder
        df = spark.read.schema(REPORT).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
        df = df.select("*", F.col("_metadata.file_path").alias("path"))
    else:
        df = parsed(found, REPORT)
    for i, n in enumerate(names):
        df = df.withColumn(n, F.regexp_extract("path", pattern, i + 1))
    df = df.where(F.col("task_id") != "").withColumn("dir", F.regexp_extract("path", r"([^/]+)/task_[^/]+/", 1))
    scores = [F.col("global_verification.functional_score").alias("functional_score"), F.col("global_verification.visual_score").alias("visual_score"), F.col("homepage_similarity.visual_score").alias("homepage_score"), F.coalesce("summary.no_action", F.lit(0)).alias("no_action")]
    if layout == "real":
        return df.select("dir", "task_id", "base_timeline", (F.col("candidate") != "").alias("is_candidate"), "path", *scores)
    return df.select("dir", "task_id", F.col("segment").cast("int").alias("segment"), F.col("operation").cast("int").alias("operation"), "path", *scores)


def require_media(records: DataFrame, inventory: DataFrame, path: str = "path") -> DataFrame:
    """Records whose file exists."""
    return records.join(inventory.select(path), path, "left_semi")


def missing_media(records: DataFrame, inventory: DataFrame, path: str = "path") -> DataFrame:
    """Records whose file does not exist."""
    return records.join(inventory.select(path), path, "left_anti")


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines in UTF-8, null fields kept."""
    df.write.json(path, ignoreNullFields=False)


def write_shards(df: DataFrame, path: str, part: str = "part", manifest: DataFrame | None = None) -> None:
    """One folder of JSON lines for each part; with a manifest (M14, M15) one of its rows for each part
    beside it, in <path>-manifest. A folder is made by one task, and folders are dealt over a fixed number of tasks: small
    rows would else be drawn together into one that makes all of them."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(tasks, part).write.partitionBy(part).json(path, ignoreNullFields=False)
    if manifest is not None:
        manifest.repartition(tasks, part).write.partitionBy(part).json(f"{path}-manifest", ignoreNullFields=False)


def first_occurrence(df: DataFrame, key: str, order: str) -> DataFrame:
    """S4 for whole rows: of each key the row that comes first."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
