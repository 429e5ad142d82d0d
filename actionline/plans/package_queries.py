"""Queries over shards, media and page images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actionline.operators import package as P
from actionline.operators import pages as G
from actionline.operators import timeline as T
from actionline.operators.frames import plan_clips
from actionline.plans.frame_queries import OPS
from actionline.plans.registry import query
from actionline.sources import files
from actionline.sources.shared import shared_folder

SHARDS = "sh AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 100 + 1 AS part FROM (SELECT DISTINCT id FROM v_code))"


@query("m13_assign_shards", "v_code", sql=f"WITH {SHARDS} SELECT id, part::BIGINT AS part FROM sh")
def m13(code: DataFrame) -> DataFrame:
    return P.assign_shards(code.select("id").distinct(), limit=100).select("id", "part")


def _records(ops: DataFrame) -> DataFrame:
    w = plan_clips(T.op_windows(ops)).where("clip_path is not null")
    r = w.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("seg_idx", "op_idx", "clip_path"))).alias("c"))
    r = r.select("id", F.concat(F.lit("./videos/"), "id", F.lit(".mp4")).alias("video_path"), F.transform("c", lambda c: c["clip_path"]).alias("clip_video_list"))
    return P.assign_shards(r, limit=40)


MANIFEST = f"""{OPS}, cl AS (SELECT id, concat(id, '/', id, '_', printf('%.2f', start), '_', printf('%.2f', "end"), '.mp4') AS path FROM w WHERE "end" - start > 0),
sh AS (SELECT id, ((row_number() OVER (ORDER BY id) - 1) // 40 + 1)::BIGINT AS part FROM (SELECT DISTINCT id FROM cl)),
al AS (SELECT id, path FROM cl UNION ALL SELECT id, concat('./videos/', id, '.mp4') FROM sh),
mf AS (SELECT id, part, string_split(path, '/')[-1] AS name, path, path IN (SELECT path FROM v_media) AS present FROM al JOIN sh USING (id))"""


@query("m14_media_manifest", "v_ops", "v_media", sql=f"WITH {MANIFEST} SELECT * FROM mf")
def m14(ops: DataFrame, media: DataFrame) -> DataFrame:
    return P.media_manifest(_records(ops), media)


@query("m15_media_index", "v_ops", "v_media", sql=f"WITH {MANIFEST} SELECT part, name, md5(concat(path, length)) AS md5, length(concat(path, length)) AS size FROM mf JOIN v_media USING (path) WHERE present")
def m15(ops: DataFrame, media: DataFrame) -> DataFrame:
    content = media.select("path", F.concat("path", F.col("length").cast("string")).cast("binary").alias("content"))
    return P.media_index(P.media_manifest(_records(ops), media), content)


@query("m15_media_files", "v_ops", "v_media", sql=f"WITH {MANIFEST} SELECT part, name, md5(concat(path, length)) AS md5, length(concat(path, length)) AS size FROM mf JOIN v_media USING (path) WHERE present AND path LIKE './videos/%'")
def m15c(ops: DataFrame, media: DataFrame) -> DataFrame:
    """The recordings' own files: written to the shared folder, their digests read back from there."""
    spark, folder = ops.sparkSession, shared_folder(ops.sparkSession, "media")
    own = media.where("path like './videos/%'")
    files.write_files(own.select("path", F.concat("path", F.col("length").cast("string")).alias("content")), folder)
    found = files.read_digests(spark, folder).withColumn("path", F.concat(F.lit("./"), "path"))
    return P.media_index(P.media_manifest(_records(ops), own), found)


@query("m15_duplicate_names", "v_ops", "v_media", sql=f"WITH {MANIFEST}, hf AS (SELECT part, name, path FROM mf UNION ALL SELECT part, name, concat('again/', path) FROM mf WHERE part = 2) SELECT part, name, count(DISTINCT path) AS n FROM hf GROUP BY ALL HAVING count(DISTINCT path) > 1")
def m15b(ops: DataFrame, media: DataFrame) -> DataFrame:
    m = P.media_manifest(_records(ops), media)
    return P.duplicate_names(m.unionByName(m.where("part = 2").withColumn("path", F.concat(F.lit("again/"), "path"))))


@query("m16_attach_shard_ids", "v_code", sql="SELECT id, concat('part_', line_no % 12) AS stem, md5(concat('part_', line_no % 12)) AS shard_uuid FROM v_code WHERE line_no % 12 < 10")
def m16(code: DataFrame) -> DataFrame:
    stem = F.concat(F.lit("part_"), (F.col("line_no") % 12).cast("string"))
    shards = code.select(stem.alias("stem")).distinct().where("stem not in ('part_10', 'part_11')").withColumn("shard_uuid", F.md5(F.col("stem").cast("binary")))
    return P.attach_shard_ids(code.select("id", stem.alias("stem")), shards)


@query("m16_missing_shards", "v_code", sql="SELECT concat('part_', line_no % 12) AS stem, count(*) AS n FROM v_code WHERE line_no % 12 >= 10 GROUP BY 1")
def m16b(code: DataFrame) -> DataFrame:
    stem = F.concat(F.lit("part_"), (F.col("line_no") % 12).cast("string"))
    shards = code.select(stem.alias("stem")).distinct().where("stem not in ('part_10', 'part_11')")
    return P.missing_shards(code.select(stem.alias("stem")), shards)


def _rgb(pixels: DataFrame) -> DataFrame:
    rows = pixels.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "grey"))).alias("p"))
    hexed = F.array_join(F.transform("p", lambda x: F.lpad(F.hex(F.greatest(F.lit(0), x["grey"])), 2, "0")), "")
    triple = F.regexp_replace(hexed, "(..)", "$1$1$1")
    return rows.select(F.col("id").cast("string").alias("id"), F.lit(8).alias("w"), F.lit(8).alias("h"), F.unhex(triple).alias("rgb"))


@query("m08_blank_stats", "v_pixels", sql="SELECT id::VARCHAR AS id, round(stddev_pop(greatest(grey, 0)), 4) AS channel_std, stddev_pop(greatest(grey, 0)) < 10 AS blank FROM v_pixels GROUP BY id")
def m08(pixels: DataFrame) -> DataFrame:
    return G.blank_stats(_rgb(pixels)).select("id", F.round("channel_std", 4).alias("channel_std"), "blank")


@query("m08_blank_stats_grey", "v_pixels", sql="SELECT id, round(stddev_pop(grey), 4) AS luma_std, stddev_pop(grey) < 10 AS blank FROM v_pixels GROUP BY id")
def m08b(pixels: DataFrame) -> DataFrame:
    return G.blank_stats_grey(pixels).withColumn("luma_std", F.round("luma_std", 4))


STATUS = """st AS (SELECT concat('d', id) AS id, id % 10 <> 3 AS rendered, stddev_pop(grey) < 10 AS blank FROM v_pixels GROUP BY id),
rc AS (SELECT line_no, CASE WHEN line_no % 20 = 0 THEN '' ELSE id END AS id FROM v_code),
fp AS (SELECT line_no, rc.id, CASE WHEN rc.id = '' THEN 'missing_id' WHEN st.id IS NULL THEN 'file_not_found' WHEN NOT rendered THEN 'render_error' WHEN blank THEN 'blank_detected' ELSE 'valid' END AS status FROM rc LEFT JOIN st USING (id))"""


def _statuses(code: DataFrame, pixels: DataFrame) -> DataFrame:
    s = G.blank_stats_grey(pixels).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("id"), (F.col("id") % 10 != 3).alias("rendered"), "blank")
    return G.filter_pages(code.select("line_no", F.when(F.col("line_no") % 20 == 0, "").otherwise(F.col("id")).alias("id")), s)


@query("m09_filter_pages", "v_code", "v_pixels", sql=f"WITH {STATUS} SELECT * FROM fp")
def m09(code: DataFrame, pixels: DataFrame) -> DataFrame:
    return _statuses(code, pixels)


@query("m09_status_counts", "v_code", "v_pixels", sql=f"WITH {STATUS} SELECT status, count(*) AS n FROM fp GROUP BY 1")
def m09b(code: DataFrame, pixels: DataFrame) -> DataFrame:
    return G.status_counts(_statuses(code, pixels))


@query("e11_solid_tasks", "v_pixels", sql="""WITH c AS (SELECT id, floor(grey / 128) AS k, count(*) AS n FROM v_pixels GROUP BY ALL), r AS (SELECT id, max(n) / sum(n) AS ratio FROM c GROUP BY id)
  SELECT id % 40 AS task_id, bool_and(ratio >= 0.97) AS solid, count_if(ratio >= 0.97)::BIGINT AS n_solid, count(*) AS n_images FROM r GROUP BY 1""")
def e11(pixels: DataFrame) -> DataFrame:
    return G.solid_tasks(G.solid_images(pixels).withColumn("task_id", F.col("id") % 40))


@query("e11_solid_rgb", "v_pixels", sql="""WITH c AS (SELECT id, greatest(grey, 0) >= 128 AS k, count(*) AS n FROM v_pixels GROUP BY ALL) SELECT id::VARCHAR AS id, max(n) / sum(n) AS ratio FROM c GROUP BY id""")
def e11b(pixels: DataFrame) -> DataFrame:
    return G.solid_rgb(_rgb(pixels))
