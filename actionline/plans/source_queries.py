"""Queries over sources and sinks: what the tables give is written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actionline.operators import package
from actionline.operators import scores as E
from actionline.plans.registry import query
from actionline.plans.timeline_queries import RUNS
from actionline.sources import files, io
from actionline.sources.shared import shared_folder, stored
from actionline.streaming import ordered, stream


@query("s04_load_urls", "v_urls", sql="SELECT min(line_no) AS line_no, trim(url) AS url FROM v_urls WHERE trim(coalesce(url, '')) <> '' GROUP BY 2")
def s04(urls: DataFrame) -> DataFrame:
    return io.load_urls(urls)[0]


@query("s04_bad_lines", "v_urls", sql="SELECT count(*) AS n_bad FROM v_urls WHERE trim(coalesce(url, '')) = ''")
def s04b(urls: DataFrame) -> DataFrame:
    return io.load_urls(urls)[1]


@query("s05_merge_worker_outputs", "v_results", sql="SELECT CASE WHEN event_id % 4 = 1 THEN concat('e', event_id) ELSE event_id::VARCHAR END AS id, type = 'success' AS success, CASE WHEN event_id % 3 = 2 THEN reason END AS reason, row_number() OVER (ORDER BY try_cast(CASE WHEN event_id % 4 <> 1 THEN event_id END AS BIGINT) NULLS LAST, concat('e', event_id)) AS place FROM v_results")
def s05(results: DataFrame) -> DataFrame:
    number = F.col("event_id").cast("string")
    r = results.select(F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("e"), number)).otherwise(number).alias("id"), (F.col("type") == "success").alias("success"), (F.col("event_id") % 3).alias("worker"), "reason")
    workers = [r.where(F.col("worker") == k).select("id", "success", *(["reason"] if k == 2 else [])) for k in range(3)]
    merged = io.merge_worker_outputs(workers)
    # the place of each row in the merged order, as ranges are numbered from their offsets
    return io.placed(merged)


@query("s05_success_counts", "v_results", sql="SELECT count(*) AS n, count_if(type = 'success')::BIGINT AS n_success FROM v_results")
def s05b(results: DataFrame) -> DataFrame:
    return io.success_counts(results.select((F.col("type") == "success").alias("success")))


def _paths(ops: DataFrame) -> DataFrame:
    return ops.select("id").distinct().withColumn("path", F.concat(F.lit("./videos/"), "id", F.lit(".mp4")))


@query("s07_require_media", "v_ops", "v_media", sql="SELECT id, path FROM (SELECT DISTINCT id, concat('./videos/', id, '.mp4') AS path FROM v_ops) WHERE path IN (SELECT path FROM v_media)")
def s07(ops: DataFrame, media: DataFrame) -> DataFrame:
    return io.require_media(_paths(ops), media)


@query("s07_missing_media", "v_ops", "v_media", sql="SELECT id, path FROM (SELECT DISTINCT id, concat('./videos/', id, '.mp4') AS path FROM v_ops) WHERE path NOT IN (SELECT path FROM v_media)")
def s07b(ops: DataFrame, media: DataFrame) -> DataFrame:
    return io.missing_media(_paths(ops), media)


@query("r02_stream_events_in_order", "v_frames", sql=f"WITH {RUNS} SELECT * FROM ev")
def r02b(frames: DataFrame) -> DataFrame:
    """Frames dealt to three batches by a hash, so each take comes in any order, and a batch that ends the stream."""
    spark, folder = frames.sparkSession, shared_folder(frames.sparkSession, "stream")
    timed = frames.select("take_id", F.col("frame_no").cast("long").alias("frame_no"), "fps", "status", F.timestamp_seconds(1_600_000_000 + F.col("frame_no") * 60).alias("ts"))
    for k in range(3):
        timed.where(F.pmod(F.xxhash64("take_id", "frame_no"), F.lit(3)) == k).write.mode("append").parquet(f"{folder}/in")
    ordered.with_end(timed, days=90).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 8).parquet(f"{folder}/in")
    ordered.started(spark, ordered.stream_events_in_order(source, late="40 days", end="1 day"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(stream.EVENTS).parquet(f"{folder}/out").where("take_id is not null")


@query("r03_stream_progress", "v_results", sql="SELECT type, count(*) AS n FROM v_results GROUP BY 1")
def r03(results: DataFrame) -> DataFrame:
    return stream.stream_progress(results)


@query("s01_read_recordings", "v_ops", sql="SELECT id, seg_idx, op_idx, subtype, action, if_scroll, global_start_time, dom_text, input_val FROM v_ops")
def s01(ops: DataFrame) -> DataFrame:
    detail = F.struct("action", "input_val", "value", F.struct(F.col("dom_text").alias("visible_text")).alias("dom_info")).alias("action_detail")
    o = ops.groupBy("id", "seg_idx").agg(F.sort_array(F.collect_list(F.struct("op_idx", "subtype", "if_scroll", "global_start_time", detail))).alias("operations"))
    o = o.groupBy(F.col("id").alias("html_file")).agg(F.sort_array(F.collect_list(F.struct(F.col("seg_idx").alias("segment_index"), "operations"))).alias("action_frames_timeline_filtered"))
    path = shared_folder(ops.sparkSession, "recordings")
    o.write.option("maxRecordsPerFile", 1).json(path)
    found = io.read_recordings(ops.sparkSession, path)
    return io.recording_ops(found.withColumn("id", F.col("html_file"))).select("id", F.col("seg_idx").cast("int"), F.col("op_idx").cast("int"), "subtype", "action", "if_scroll", "global_start_time", "dom_text", "input_val")


@query("s02_read_jsonl", "v_urls", sql="SELECT line_no, url FROM v_urls WHERE url IS NOT NULL AND line_no % 7 <> 3")
def s02(urls: DataFrame) -> DataFrame:
    whole = F.to_json(F.struct("line_no", "url"))
    path = shared_folder(urls.sparkSession, "lines")
    urls.select(F.when(F.col("url").isNull(), "").when(F.col("line_no") % 7 == 3, F.expr("left(to_json(struct(line_no, url)), 9)")).otherwise(whole).alias("value")).write.text(path)
    return io.read_jsonl(urls.sparkSession, path, "line_no long, url string")


@query("s08_write_jsonl", "v_think", sql="SELECT id, line_no, md5(mllm_generate) AS md5 FROM v_think")
def s08(think: DataFrame) -> DataFrame:
    path = shared_folder(think.sparkSession, "jsonl")
    io.write_jsonl(think, path)
    back = io.read_jsonl(think.sparkSession, path, "id string, line_no long, mllm_generate string")
    return back.select("id", "line_no", F.md5(F.col("mllm_generate").cast("binary")).alias("md5"))


@query("s09_write_shards", "v_media", sql="""WITH p AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 20 + 1 AS part, starts_with(id, 'rec_') AS present FROM v_media)
  SELECT part, count(*) AS n, min(id) AS first_id, max(id) AS last_id, count(*) AS n_media, count_if(present)::BIGINT AS n_present FROM p GROUP BY part""")
def s09(media: DataFrame) -> DataFrame:
    records = package.assign_shards(media.select("id", F.col("path").alias("video_path")).withColumn("clip_video_list", F.array().cast("array<string>")), limit=20)
    records = stored(records, "numbered")  # numbered once for the shards and the manifest
    path = shared_folder(media.sparkSession, "shards")
    io.write_shards(records, path, manifest=package.media_manifest(records, media.where(F.col("id").startswith("rec_"))))
    read = lambda p, schema: media.sparkSession.read.schema(schema).json(p)
    n = read(path, "id string, part long").groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return n.join(read(f"{path}-manifest", "name string, present boolean, part long").groupBy("part").agg(F.count("*").alias("n_media"), F.count_if("present").alias("n_present")), "part")


@query("e10_frame_sets", "v_ops", sql="""WITH s AS (SELECT id, seg_idx, concat('segment_', seg_idx, ':', string_agg(concat('operation_', op_idx), ',' ORDER BY op_idx)) AS t FROM v_ops GROUP BY id, seg_idx) SELECT id, string_agg(t, '|' ORDER BY seg_idx) AS layout FROM s GROUP BY id""")
def e10b(ops: DataFrame) -> DataFrame:
    f = ops.select("id", F.concat(F.lit("segment_"), F.col("seg_idx").cast("string")).alias("segment_name"), F.concat(F.lit("operation_"), F.col("op_idx").cast("string")).alias("operation_name"))
    return E.frame_sets(f).select("id", F.array_join(F.transform("segments", lambda s: F.concat(s["segment_name"], F.lit(":"), F.array_join(s["operations"], ","))), "|").alias("layout"))


@query("r01_stream_records", "v_think", sql="SELECT DISTINCT id FROM v_think")
def r01(think: DataFrame) -> DataFrame:
    spark, folder = think.sparkSession, shared_folder(think.sparkSession, "stream")
    io.write_jsonl(think, f"{folder}/in")
    stream.ingest(stream.stream_records(spark, f"{folder}/in", "id string, mllm_generate string"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema("id string, mllm_generate string").parquet(f"{folder}/out").select("id")


@query("r02_stream_events", "v_frames", sql=f"WITH {RUNS} SELECT * FROM ev")
def r02(frames: DataFrame) -> DataFrame:
    spark, folder = frames.sparkSession, shared_folder(frames.sparkSession, "stream")
    timed = frames.withColumn("ts", F.timestamp_seconds(1_600_000_000 + F.col("frame_no") * 60))
    timed.write.parquet(f"{folder}/in")
    out = stream.stream_events(spark.readStream.schema(timed.schema).parquet(f"{folder}/in"), timeout="1 minute")
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.EVENTS).parquet(f"{folder}/out")


#: Reports of customers: (columns of the layout, the same in the twin).
REPORT = """concat('run_', c_nationkey % 3) AS dir, concat(c_custkey % 41) AS task_id, CASE WHEN c_custkey % 3 = 0 THEN 'failed' ELSE 'success' END AS functional_score,
  CASE WHEN c_custkey % 7 <> 0 THEN cast(c_custkey % 101 AS int) END AS visual_score, CASE WHEN c_custkey % 5 = 0 THEN cast(c_custkey % 60 AS int) END AS homepage_score, cast(c_custkey % 2 AS int) AS no_action, concat('r', c_custkey) AS name"""
REAL = "concat('timeline_', c_custkey % 12) AS base_timeline, c_custkey % 4 = 1 AS is_candidate"
SYNTHESIS = "cast(c_custkey % 50 AS int) AS segment, cast(floor(c_custkey / 50) AS int) AS operation"


def _reports(customer: DataFrame, layout: str, columns: str) -> DataFrame:
    """Reports written as a tree and read back; those of every ninth customer lie elsewhere, of every 13th are broken."""
    paths = files.report_paths(customer.select(F.expr(f"struct({columns}, {REPORT}) AS r")).select("r.*"), layout)
    key = F.regexp_extract("path", r"/r(\d+)\.json$", 1).cast("long")
    paths = paths.select(F.when(key % 9 == 0, F.concat(F.lit("other/"), F.element_at(F.split("path", "/"), -1))).otherwise(F.col("path")).alias("path"), F.when(key % 13 == 0, "{ broken").otherwise(F.col("content")).alias("content"))
    folder = shared_folder(customer.sparkSession, "reports")
    tasks = int(customer.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files.write_files(paths.repartition(tasks, "path"), folder)  # customers are small: few tasks read very many
    return io.read_reports(customer.sparkSession, folder, layout).withColumn("name", F.regexp_extract("path", r"([^/]+)\.json$", 1)).drop("path")


@query("s06_read_reports_real", "customer", sql=f"SELECT {REAL}, {REPORT} FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey % 13 <> 0")
def s06(customer: DataFrame) -> DataFrame:
    return _reports(customer, "real", REAL)


@query("s06_read_reports_synthesis", "customer", sql=f"SELECT {SYNTHESIS}, {REPORT} FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey % 13 <> 0")
def s06b(customer: DataFrame) -> DataFrame:
    return _reports(customer, "synthesis", SYNTHESIS)
