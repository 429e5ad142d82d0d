"""Queries over the frame operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actionline.operators import frames as C
from actionline.operators import timeline as T
from actionline.plans.registry import query
from actionline.plans.timeline_queries import WINDOWS

OPS = WINDOWS.replace("SELECT id, seg_idx, op_idx, subtype", "SELECT global_start_time, global_end_time, id, seg_idx, op_idx, subtype").replace("SELECT id FROM v_media", "SELECT id FROM v_ops")
#: The seven sampling cases as (begin, limit, type, condition); a single frame has no limit.
SCHEDULE = f"""{OPS}, o AS (SELECT *, coalesce(global_start_time, start) AS a, greatest(0, coalesce(global_start_time, start) - 0.5) AS ld, coalesce(action = 'select', false) AS sel FROM w),
c AS (SELECT id, seg_idx, op_idx, 0 AS k, ld AS b, coalesce("end", a) AS l, 'during_select_scroll' AS ft FROM o WHERE subtype = 'input_duration' AND sel AND if_scroll
  UNION ALL SELECT id, seg_idx, op_idx, 0, ld, NULL, 'before_select' FROM o WHERE subtype = 'input_duration' AND sel AND NOT if_scroll
  UNION ALL SELECT id, seg_idx, op_idx, 1, a, coalesce(global_end_time, "end", a), 'during_select' FROM o WHERE subtype = 'input_duration' AND sel AND NOT if_scroll
  UNION ALL SELECT id, seg_idx, op_idx, 0, ld, NULL, 'before_input_duration' FROM o WHERE subtype = 'input_duration' AND NOT sel AND if_scroll
  UNION ALL SELECT id, seg_idx, op_idx, 1, finish + 0.3, "end", 'after_input_scroll_duration' FROM o WHERE subtype = 'input_duration' AND NOT sel AND if_scroll AND finish IS NOT NULL
  UNION ALL SELECT id, seg_idx, op_idx, 0, ld, NULL, 'before_input' FROM o WHERE subtype = 'input_duration' AND NOT sel AND NOT if_scroll
  UNION ALL SELECT id, seg_idx, op_idx, 1, "end", NULL, 'after_input' FROM o WHERE subtype = 'input_duration' AND NOT sel AND NOT if_scroll
  UNION ALL SELECT id, seg_idx, op_idx, 0, ld, NULL, 'before_click_duration' FROM o WHERE subtype = 'click' AND if_scroll
  UNION ALL SELECT id, seg_idx, op_idx, 1, a + 0.3, "end", 'after_click_scroll_duration' FROM o WHERE subtype = 'click' AND if_scroll
  UNION ALL SELECT id, seg_idx, op_idx, 0, ld, NULL, 'before_instant_click' FROM o WHERE subtype = 'click' AND NOT if_scroll
  UNION ALL SELECT id, seg_idx, op_idx, 1, a + 1.2, NULL, 'after_instant_click' FROM o WHERE subtype = 'click' AND NOT if_scroll
  UNION ALL SELECT id, seg_idx, op_idx, 0, start, NULL, 'before_init_scroll' FROM o WHERE subtype = 'init_scroll'
  UNION ALL SELECT id, seg_idx, op_idx, 1, start + 0.5, "end", 'during_init_scroll' FROM o WHERE subtype = 'init_scroll'),
s AS (SELECT id, seg_idx, op_idx, k, i, b + i * 0.5::DOUBLE AS t, ft, l FROM (SELECT *, unnest(CASE WHEN l IS NULL THEN [0] ELSE range(0, greatest(0, floor((l - b) / 0.5)::INT + 2)) END) AS i FROM c)),
fr AS (SELECT id, seg_idx, op_idx, (row_number() OVER (PARTITION BY id, seg_idx, op_idx ORDER BY k, i) - 1)::INT AS frame_idx, t AS time_seconds, ft AS frame_type FROM s WHERE l IS NULL OR round(t, 2) <= round(l, 2))"""


def _frames(ops: DataFrame) -> DataFrame:
    return C.plan_frames(C.reject_unknown_subtypes(T.op_windows(ops)))


@query("c01_plan_clips", "v_ops", sql=f"""WITH {OPS} SELECT id, string_agg(concat(id, '/', id, '_', printf('%.2f', start), '_', printf('%.2f', "end"), '.mp4'), ',' ORDER BY seg_idx, op_idx) FILTER (WHERE "end" - start > 0) AS clips FROM w GROUP BY id""")
def c01(ops: DataFrame) -> DataFrame:
    clips = F.array_join("clip_video_list", ",")
    return C.clip_list(C.plan_clips(T.op_windows(ops))).select("id", F.when(F.size("clip_video_list") > 0, clips).alias("clips"))


@query("c02_plan_frames", "v_ops", sql=f"WITH {SCHEDULE} SELECT id, seg_idx, op_idx, frame_idx, round(time_seconds, 4) AS time_seconds, frame_type FROM fr")
def c02(ops: DataFrame) -> DataFrame:
    return _frames(ops).withColumn("time_seconds", F.round("time_seconds", 4))


@query("c03_reject_unknown_subtypes", "v_ops", sql=f"""WITH {OPS}, u AS (SELECT id, seg_idx, op_idx, CASE WHEN seg_idx % 40 = 39 THEN 'drag' ELSE subtype END AS subtype FROM w)
  SELECT id, seg_idx, op_idx FROM u WHERE id NOT IN (SELECT id FROM u WHERE subtype NOT IN ('click', 'input_duration', 'init_scroll'))""")
def c03(ops: DataFrame) -> DataFrame:
    odd = T.op_windows(ops).withColumn("subtype", F.when(F.col("seg_idx") % 40 == 39, "drag").otherwise(F.col("subtype")))
    return C.reject_unknown_subtypes(odd).select("id", "seg_idx", "op_idx")


@query("c04_group_frames", "v_ops", sql=f"""WITH {SCHEDULE} SELECT id, seg_idx, op_idx, count(*)::INT AS n_frames, string_agg(concat(id, '_seg', seg_idx, '_op', op_idx, '_t', printf('%.2f', time_seconds), '_', frame_type, '.jpg'), ',' ORDER BY frame_idx) AS paths FROM fr GROUP BY ALL""")
def c04(ops: DataFrame) -> DataFrame:
    return C.group_frames(_frames(ops)).select("id", "seg_idx", "op_idx", F.size("extracted_frames").alias("n_frames"), F.array_join(F.transform("extracted_frames", lambda f: f["image_path"]), ",").alias("paths"))


@query("c05_step_frames", "v_frames", sql="SELECT take_id, frame_no, status FROM (SELECT *, row_number() OVER (PARTITION BY take_id ORDER BY frame_no) - 1 AS rn, count(*) OVER (PARTITION BY take_id) AS n FROM v_frames) WHERE n >= 2 AND rn % 7 = 0")
def c05(frames: DataFrame) -> DataFrame:
    return C.step_frames(frames, 7).select("take_id", "frame_no", "status")


@query("c06_uniform_frames", "v_frames", sql="""SELECT take_id, frame_no FROM (SELECT *, row_number() OVER (PARTITION BY take_id ORDER BY frame_no) - 1 AS rn, count(*) OVER (PARTITION BY take_id) AS n FROM v_frames)
  WHERE n <= 24 OR list_contains([round_even(i * (n - 1) / 23, 0)::INT FOR i IN range(0, 24)], rn::INT)""")
def c06(frames: DataFrame) -> DataFrame:
    return C.uniform_frames(frames, 24).select("take_id", "frame_no")


CAP = """WITH f AS (SELECT *, CASE WHEN status = 'red' THEN 'expected' ELSE 'actual' END AS side FROM v_frames),
  n AS (SELECT *, row_number() OVER (PARTITION BY take_id, side ORDER BY frame_no) - 1 AS rn, count(*) OVER (PARTITION BY take_id, side) AS n, count(*) FILTER (WHERE side = 'expected') OVER (PARTITION BY take_id) AS e0 FROM f),
  e AS (SELECT *, CASE WHEN e0 > 30 THEN 26 ELSE e0 END AS e, 49 - CASE WHEN e0 > 30 THEN 26 ELSE e0 END AS lft FROM n)
  SELECT take_id, frame_no, side FROM e WHERE CASE WHEN side = 'expected' THEN rn < e ELSE {} END"""


def _sides(frames: DataFrame) -> DataFrame:
    return frames.withColumn("side", F.when(F.col("status") == "red", "expected").otherwise("actual"))


@query("c07_cap_frames_head", "v_frames", sql=CAP.format("rn < lft"))
def c07(frames: DataFrame) -> DataFrame:
    return C.cap_frames(_sides(frames), "head").select("take_id", "frame_no", "side")


@query("c07_cap_frames_uniform", "v_frames", sql=CAP.format("n <= lft OR list_contains([round_even(i * (n - 1) / (lft - 1), 0)::INT FOR i IN range(0, lft)], rn::INT)"))
def c07b(frames: DataFrame) -> DataFrame:
    return C.cap_frames(_sides(frames), "uniform").select("take_id", "frame_no", "side")
