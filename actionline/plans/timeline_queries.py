"""Queries over the timeline and event operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actionline.operators import events as EV
from actionline.operators import timeline as T
from actionline.plans.registry import query

FIELDS = ("subtype", "action", "if_scroll", "start", "end", "finish", "before", "after")


def _jitter(side: str) -> str:
    return f"round(1.0::DOUBLE + (('0x' || substr(md5(concat(id, ':', seg_idx, ':', op_idx, ':{side}:7')), 1, 8))::BIGINT % 51) / 100.0::DOUBLE, 2)"


def _grid(x: str) -> str:
    return f"round(round_even(({x}) / 0.1::DOUBLE, 0) * 0.1::DOUBLE, 2)"


#: The operation windows of v_ops as named results of the SQL twins.
WINDOWS = f"""j AS (SELECT *, {_jitter("b")} AS before, {_jitter("a")} AS aft FROM v_ops WHERE global_start_time IS NOT NULL),
x AS (SELECT *, CASE WHEN subtype IN ('input_duration', 'click') THEN greatest(0, global_start_time - before) WHEN subtype = 'init_scroll' THEN greatest(0, global_start_time) ELSE 0 END AS s,
  CASE WHEN subtype IN ('input_duration', 'init_scroll') THEN CASE WHEN if_scroll THEN global_scroll_end_time ELSE global_end_time END
       WHEN subtype = 'click' THEN CASE WHEN if_scroll THEN global_scroll_end_time ELSE global_start_time + aft END ELSE 0 END AS e,
  CASE WHEN subtype IN ('input_duration', 'init_scroll') AND if_scroll THEN global_end_time END AS f FROM j),
w AS (SELECT id, seg_idx, op_idx, subtype, action, if_scroll, {_grid("s")} AS start, {_grid("e")} AS "end", nullif({_grid("f")}, 0) AS finish, before,
  CASE WHEN subtype = 'click' AND NOT if_scroll OR subtype NOT IN ('click', 'input_duration', 'init_scroll') THEN aft ELSE 0 END AS after FROM x WHERE e IS NOT NULL),
m AS (SELECT * FROM w WHERE id IN (SELECT id FROM v_media))"""
#: Segments with weights, and their parts by a walk along each recording.
PARTS = f"""{WINDOWS}, g AS (SELECT id, seg_idx, sum(CASE WHEN if_scroll THEN 4 ELSE 1 END)::INT AS weight, count(*) AS n, arg_min(start, op_idx) AS first_start, arg_max("end", op_idx) AS last_end, arg_min(subtype, op_idx) AS subtype, bool_or(if_scroll) AS scroll FROM m GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seg_idx) AS pos, sum(weight) OVER (PARTITION BY id) AS total FROM g),
k AS (SELECT *, CASE WHEN total <= 10 THEN 1 ELSE ceil(total / 10)::INT END AS cnt, total / CASE WHEN total <= 10 THEN 1 ELSE ceil(total / 10) END AS share FROM n),
walk AS (SELECT id, seg_idx, pos, weight, 0 AS part, weight AS now FROM k WHERE pos = 1
  UNION ALL SELECT k.id, k.seg_idx, k.pos, k.weight, CASE WHEN part < cnt - 1 AND now > 0 AND abs(now - share) < abs(now + k.weight - share) THEN part + 1 ELSE part END,
    CASE WHEN part < cnt - 1 AND now > 0 AND abs(now - share) < abs(now + k.weight - share) THEN k.weight ELSE now + k.weight END FROM walk JOIN k ON k.id = walk.id AND k.pos = walk.pos + 1),
p AS (SELECT walk.*, k.first_start, k.last_end, k.n, k.subtype, k.scroll FROM walk JOIN k USING (id, pos))"""
BOUNDS = f"""{PARTS}, b AS (SELECT id, part, arg_min(first_start, pos) AS fs, arg_max(last_end, pos) AS le, bool_or(subtype = 'init_scroll') AS has_init FROM p GROUP BY ALL),
bd AS (SELECT b.*, CASE WHEN duration > 0 THEN duration ELSE 999999.0 END AS dur, lead(fs) OVER (PARTITION BY id ORDER BY part) AS nx FROM b LEFT JOIN v_media USING (id)),
bs AS (SELECT *, CASE WHEN nx IS NOT NULL THEN least(greatest(least(le + 0.5, nx), le), dur) END AS stop FROM bd),
bb AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY id ORDER BY part), 0) AS b0 FROM bs),
bl AS (SELECT *, coalesce(first_value(CASE WHEN b0 >= dur - 0.1 THEN b0 END IGNORE NULLS) OVER (PARTITION BY id ORDER BY part), b0) AS "begin" FROM bb),
bounds AS (SELECT id, part, "begin", stop, has_init FROM bl WHERE NOT (stop IS NOT NULL AND ("begin" >= dur - 0.1 OR stop <= "begin")))"""


def _dataset(ops: DataFrame, media: DataFrame) -> DataFrame:
    return T.build_timeline_dataset(ops, media)


def _parts(ops: DataFrame, media: DataFrame) -> DataFrame:
    return T.part_bounds(T.split_recordings(_dataset(ops, media)), media)


@query("t01_normalize_time", "v_ops", sql=f"SELECT id, seg_idx, op_idx, coalesce({_grid('global_end_time')}, 0) AS t FROM v_ops")
def t01(ops: DataFrame) -> DataFrame:
    return ops.select("id", "seg_idx", "op_idx", T.normalize_time(F.col("global_end_time")).alias("t"))


@query("t02_op_windows", "v_ops", sql=f"WITH {WINDOWS.replace('SELECT id FROM v_media', 'SELECT id FROM v_ops')} SELECT * FROM w")
def t02(ops: DataFrame) -> DataFrame:
    return T.op_windows(ops).select("id", "seg_idx", "op_idx", *FIELDS)


@query("t03_build_timeline_dataset", "v_ops", "v_media", sql=f"""WITH {WINDOWS}, s AS (SELECT id, seg_idx, count(*) AS n, string_agg(concat(op_idx, '@', printf('%.2f', start), '-', printf('%.2f', "end")), ',' ORDER BY op_idx) AS t FROM m GROUP BY ALL)
  SELECT id, count(*) AS n_segments, sum(n)::BIGINT AS n_ops, string_agg(concat(seg_idx, ':', t), '|' ORDER BY seg_idx) AS layout FROM s GROUP BY id""")
def t03(ops: DataFrame, media: DataFrame) -> DataFrame:
    d = _dataset(ops, media)
    op = lambda o: F.format_string("%d@%.2f-%.2f", o["op_idx"], o["start"], o["end"])
    layout = F.array_join(F.transform("segments", lambda s: F.concat(s["seg_idx"].cast("string"), F.lit(":"), F.array_join(F.transform(s["ops"], op), ","))), "|")
    return d.select("id", F.size("segments").cast("long").alias("n_segments"), F.aggregate("segments", F.lit(0).cast("long"), lambda n, s: n + F.size(s["ops"])).alias("n_ops"), layout.alias("layout"))


@query("t04_segment_weight", "v_ops", "v_media", sql=f"WITH {WINDOWS} SELECT id, seg_idx, sum(CASE WHEN if_scroll THEN 4 ELSE 1 END)::INT AS weight FROM m GROUP BY ALL")
def t04(ops: DataFrame, media: DataFrame) -> DataFrame:
    return _dataset(ops, media).select("id", F.explode("segments").alias("s")).select("id", "s.seg_idx", T.segment_weight(F.col("s.ops")).alias("weight"))


@query("t05_assign_parts", "v_ops", "v_media", sql=f"WITH RECURSIVE {PARTS} SELECT id, seg_idx, part FROM p")
def t05(ops: DataFrame, media: DataFrame) -> DataFrame:
    return T.split_recordings(_dataset(ops, media)).select("id", "part", F.explode("segments").alias("s")).select("id", "s.seg_idx", "part")


@query("t06_part_bounds", "v_ops", "v_media", sql=f'WITH RECURSIVE {BOUNDS} SELECT id, part, round("begin", 4) AS "begin", round(stop, 4) AS stop FROM bounds')
def t06(ops: DataFrame, media: DataFrame) -> DataFrame:
    return _parts(ops, media).select("id", "part", F.round("begin", 4).alias("begin"), F.round("stop", 4).alias("stop"))


@query("t07_prepend_init_scroll", "v_ops", "v_media", sql=f"""WITH RECURSIVE {BOUNDS},
  i AS (SELECT id, arg_min(first_start, pos) AS s, arg_min(coalesce(last_end, first_start + 3.0), pos) AS e FROM p WHERE subtype = 'init_scroll' GROUP BY id)
  SELECT id, part, NOT has_init AND s IS NOT NULL AS with_init, round("begin" - CASE WHEN NOT has_init AND s IS NOT NULL THEN e - s ELSE 0 END, 4) AS "offset",
    (SELECT count(*) FROM p WHERE p.id = bounds.id AND p.part = bounds.part) + CASE WHEN NOT has_init AND s IS NOT NULL THEN 1 ELSE 0 END AS n_segments FROM bounds LEFT JOIN i USING (id)""")
def t07(ops: DataFrame, media: DataFrame) -> DataFrame:
    d = _dataset(ops, media)
    p = T.prepend_init_scroll(T.part_bounds(T.split_recordings(d), media), d, FIELDS)
    return p.select("id", "part", "with_init", F.round("offset", 4).alias("offset"), F.size("segments").cast("long").alias("n_segments"))


@query("t08_rebase_times", "v_ops", "v_media", sql=f"""WITH {WINDOWS} SELECT id, seg_idx, op_idx, round(greatest(0, start - 3.0), 4) AS start, round(greatest(0, "end" - 3.0), 4) AS "end", finish FROM m""")
def t08(ops: DataFrame, media: DataFrame) -> DataFrame:
    d = _dataset(ops, media).select("id", F.explode(T.rebase_times(F.col("segments"), F.lit(3.0), fields=FIELDS)).alias("s")).select("id", "s.seg_idx", F.explode("s.ops").alias("o"))
    return d.select("id", "seg_idx", "o.op_idx", F.round("o.start", 4).alias("start"), F.round("o.end", 4).alias("end"), "o.finish")


CUTS = """c AS (SELECT id, le + 0.5 AS start, nx - 0.5 AS "end" FROM (SELECT id, n, subtype, scroll, last_end AS le, lead(first_start) OVER (PARTITION BY id ORDER BY seg_idx) AS nx FROM g)
  WHERE n = 1 AND contains(subtype, 'click') AND NOT scroll AND nx - le > 1.0)"""
SEGMENTS = f"{WINDOWS}, g AS (SELECT id, seg_idx, count(*) AS n, arg_min(subtype, op_idx) AS subtype, arg_min(if_scroll, op_idx) AS scroll, arg_min(start, op_idx) AS first_start, arg_max(\"end\", op_idx) AS last_end FROM m GROUP BY ALL)"


def _cuts(ops: DataFrame, media: DataFrame) -> DataFrame:
    s = _dataset(ops, media).select("id", F.posexplode("segments").alias("pos", "s"))
    s = s.select("id", "pos", F.size("s.ops").alias("n_ops"), F.expr("s.ops[0].subtype").alias("subtype"), F.expr("s.ops[0].if_scroll").alias("if_scroll"), F.expr("s.ops[0].start").alias("first_start"), F.expr("element_at(s.ops, -1).end").alias("last_end"))
    return T.idle_cuts(s)


@query("t09_idle_cuts", "v_ops", "v_media", sql=f'WITH {SEGMENTS}, {CUTS} SELECT id, round(start, 4) AS start, round("end", 4) AS "end" FROM c')
def t09(ops: DataFrame, media: DataFrame) -> DataFrame:
    return _cuts(ops, media).select("id", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


@query("t10_apply_cuts", "v_ops", "v_media", sql=f"""WITH {SEGMENTS}, {CUTS} SELECT m.id, seg_idx, op_idx, round(greatest(0, m.start - coalesce(sum(CASE WHEN m.start >= c."end" THEN c."end" - c.start ELSE m.start - c.start END), 0)), 4) AS start
  FROM m LEFT JOIN c ON c.id = m.id AND c.start < m.start GROUP BY m.id, seg_idx, op_idx, m.start""")
def t10(ops: DataFrame, media: DataFrame) -> DataFrame:
    cuts = _cuts(ops, media).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    d = _dataset(ops, media).join(cuts, "id", "left").select("id", "cuts", F.explode("segments").alias("s")).select("id", "cuts", "s.seg_idx", F.explode("s.ops").alias("o"))
    return d.select("id", "seg_idx", "o.op_idx", F.round(T.apply_cuts(F.col("o.start"), F.col("cuts")), 4).alias("start"))


@query("t10_apply_cuts_table", "v_ops", "v_media", sql=f"""WITH {SEGMENTS}, {CUTS} SELECT m.id, seg_idx, op_idx, round(greatest(0, m.start - coalesce(sum(CASE WHEN m.start >= c."end" THEN c."end" - c.start ELSE m.start - c.start END), 0)), 4) AS start
  FROM m LEFT JOIN c ON c.id = m.id AND c.start < m.start GROUP BY m.id, seg_idx, op_idx, m.start""")
def t10b(ops: DataFrame, media: DataFrame) -> DataFrame:
    times = _dataset(ops, media).select("id", F.explode("segments").alias("s")).select("id", "s.seg_idx", F.explode("s.ops").alias("o")).select("id", "seg_idx", "o.op_idx", "o.start")
    return T.cut_times(times, _cuts(ops, media), block=60.0).withColumn("start", F.round("start", 4))


@query("t11_keep_intervals", "v_ops", "v_media", sql=f"""WITH {SEGMENTS}, {CUTS}, a AS (SELECT id, start, "end" FROM c UNION ALL SELECT id, duration, duration FROM v_media),
  k AS (SELECT id, coalesce(lag("end") OVER (PARTITION BY id ORDER BY start, "end"), 0) AS s, start AS e FROM a) SELECT id, round(s, 4) AS start, round(e, 4) AS "end" FROM k WHERE e - s > 0.1""")
def t11(ops: DataFrame, media: DataFrame) -> DataFrame:
    return T.keep_intervals(_cuts(ops, media), media).select("id", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


@query("t12_finalize_parts", "v_ops", "v_media", sql=f"""WITH RECURSIVE {BOUNDS} SELECT concat(p.id, '_part', p.part + 1) AS id, concat('./splitted_videos/', p.id, '_part', p.part + 1, '.mp4') AS video_path,
    (row_number() OVER (PARTITION BY p.id, p.part ORDER BY pos) - 1)::INT AS segment_index, round(first_start, 3) AS start FROM p JOIN bounds ON p.id = bounds.id AND p.part = bounds.part""")
def t12(ops: DataFrame, media: DataFrame) -> DataFrame:
    p = T.finalize_parts(_parts(ops, media), ("start", "end", "finish")).select("id", "video_path", F.explode("segments").alias("s"))
    return p.select("id", "video_path", F.col("s.seg_idx").alias("segment_index"), F.expr("s.ops[0].start").alias("start"))


KEPT = """d AS (SELECT DISTINCT id, name FROM v_takes), x AS (SELECT a.id, a.name FROM d a WHERE EXISTS (SELECT 1 FROM d b WHERE b.id = a.id AND b.name <> a.name AND starts_with(b.name, a.name))),
  kept AS (SELECT t.* FROM v_takes t ANTI JOIN x ON x.id = t.id AND x.name = t.name)"""


@query("t13_drop_prefix_takes", "v_takes", sql=f"WITH {KEPT} SELECT id, take_no, name FROM kept")
def t13(takes: DataFrame) -> DataFrame:
    return T.drop_prefix_takes(takes).select("id", "take_no", "name")


#: Marker events of v_frames by runs, for the SQL twins.
RUNS = """f AS (SELECT take_id, frame_no, (frame_no + 1) / CASE WHEN fps > 0 THEN fps ELSE 30.0::DOUBLE END AS t, status, lag(status) OVER (PARTITION BY take_id ORDER BY frame_no) AS prev, max((frame_no + 1) / fps::DOUBLE) OVER (PARTITION BY take_id) AS lt FROM v_frames),
r AS (SELECT *, lead(t) OVER (PARTITION BY take_id ORDER BY frame_no) AS nt, lead(status) OVER (PARTITION BY take_id ORDER BY frame_no) AS ns FROM f WHERE prev IS NULL OR prev <> status),
mk AS (SELECT take_id, coalesce(nt, lt) AS tm, CASE WHEN nt IS NULL THEN 3 ELSE 0 END AS rk, 'duration' AS type, t AS start, coalesce(nt, lt) AS "end" FROM r WHERE status = 'green' AND (nt IS NULL OR ns = 'red' OR nt - t > 0.1)
  UNION ALL SELECT take_id, t, 1, 'point', t, t FROM r WHERE status = 'red' UNION ALL SELECT take_id, coalesce(nt, lt), 2, 'scroll', coalesce(nt, lt), coalesce(nt, lt) FROM r WHERE status = 'orange'),
nm AS (SELECT *, (sum(CASE WHEN type <> 'scroll' THEN 1 ELSE 0 END) OVER (PARTITION BY take_id ORDER BY tm, rk) - 1)::INT AS event_no FROM mk),
sc AS (SELECT take_id, event_no, max("end") AS scroll_end FROM nm WHERE type = 'scroll' AND event_no >= 0 GROUP BY ALL),
ev AS (SELECT take_id, event_no, type, start, "end", scroll_end, scroll_end IS NOT NULL AS if_scroll FROM (SELECT * FROM nm WHERE type <> 'scroll') LEFT JOIN sc USING (take_id, event_no))"""


#: Green runs of v_frames alone.
GREEN = """gf AS (SELECT take_id, frame_no, (frame_no + 1) / fps::DOUBLE AS t, status = 'green' AS g, lag(status = 'green') OVER (PARTITION BY take_id ORDER BY frame_no) AS prev, max((frame_no + 1) / fps::DOUBLE) OVER (PARTITION BY take_id) AS lt FROM v_frames),
gr AS (SELECT *, lead(t) OVER (PARTITION BY take_id ORDER BY frame_no) AS nt FROM gf WHERE prev IS NULL OR prev <> g),
gn AS (SELECT take_id, (row_number() OVER (PARTITION BY take_id ORDER BY t) - 1)::INT AS event_no, 'duration' AS type, t AS start, coalesce(nt, lt) AS "end", nt AS scroll_end, nt IS NOT NULL AS if_scroll FROM gr WHERE g AND (nt IS NULL OR nt - t > 0.1))"""
#: Takes with their events; accepted ones; the segments of the timeline.
TAKES = f"""{RUNS}, {GREEN}, te AS (SELECT id, take_no, event_no, type, start, "end", scroll_end, if_scroll FROM ev JOIN v_takes USING (take_id) WHERE NOT is_init_scroll
  UNION ALL SELECT id, take_no, 0, 'duration', s, e, e, true FROM (SELECT take_id, min(start) AS s, max("end") AS e FROM gn GROUP BY take_id) JOIN v_takes USING (take_id) WHERE is_init_scroll),
ac AS (SELECT id, take_no FROM v_takes WHERE pass_flag AND CASE WHEN is_init_scroll THEN 1 ELSE n_old + n_new END = (SELECT count(*) FROM te WHERE te.id = v_takes.id AND te.take_no = v_takes.take_no)),
tb AS (SELECT v.*, (v.id, v.take_no) IN (SELECT (id, take_no) FROM ac) AS ok FROM v_takes v WHERE pass_flag),
tl AS (SELECT *, (row_number() OVER (PARTITION BY id ORDER BY take_no) - 1)::INT AS segment_index, coalesce(sum(CASE WHEN ok THEN duration ELSE 0 END) OVER (PARTITION BY id ORDER BY take_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM tb)"""


def _takes(takes: DataFrame) -> DataFrame:
    """v_takes with its moments and actions as arrays."""
    moments = lambda n: F.array_repeat(F.lit(0.0), F.col(n))
    action = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n_old") + F.col("n_new"))), lambda i: F.concat(F.lit("action "), i.cast("string")))
    return takes.withColumn("old_moments", moments("n_old")).withColumn("new_moments", moments("n_new")).withColumn("actions_detail", action)


def _take_events(takes: DataFrame, frames: DataFrame) -> DataFrame:
    return T.take_events(takes, EV.detect_events(frames), EV.detect_events(frames, only_green=True))


@query("t14_accept_takes", "v_takes", "v_frames", sql=f"WITH {TAKES} SELECT id, take_no FROM ac")
def t14(takes: DataFrame, frames: DataFrame) -> DataFrame:
    return T.accept_takes(_takes(takes), _take_events(takes, frames)).select("id", "take_no")


@query("t15_assemble_timeline", "v_takes", "v_frames", sql=f"WITH {TAKES} SELECT id, take_no, name, segment_index, round(s, 3) AS segment_start_time, round(s + duration, 3) AS segment_end_time FROM tl WHERE ok")
def t15(takes: DataFrame, frames: DataFrame) -> DataFrame:
    t = _takes(takes)
    return T.assemble_timeline(t.where("pass_flag"), T.accept_takes(t, _take_events(takes, frames)))


@query("t15_assemble_operations", "v_takes", "v_frames", sql=f"""WITH {TAKES}, o AS (SELECT id, segment_index, event_no AS op_idx, CASE WHEN is_init_scroll THEN 'Init Scroll Operation' WHEN event_no < n_old THEN 'Old Operation' ELSE 'New Operation' END AS type,
    te.type = 'point' AS point, is_init_scroll, coalesce(if_scroll, false) OR is_init_scroll AS if_scroll, s, start, "end", scroll_end FROM (SELECT *, round(s, 3) AS r FROM tl WHERE ok) JOIN te USING (id, take_no))
  SELECT id, segment_index, op_idx, type, CASE WHEN point THEN 'click' WHEN is_init_scroll THEN 'init_scroll' ELSE 'input_duration' END AS subtype, NOT point OR if_scroll AS is_duration, if_scroll,
    round(round(s, 3) + CASE WHEN point THEN start + 1.0 ELSE start END, 3) AS global_start_time, round(round(s, 3) + "end", 3) AS global_end_time, CASE WHEN if_scroll THEN round(round(s, 3) + scroll_end, 3) END AS global_scroll_end_time,
    CASE WHEN NOT point THEN round("end" - start, 3) END AS duration_seconds, CASE WHEN NOT is_init_scroll THEN concat('action ', op_idx + 1) END AS action_detail FROM o""")
def t15b(takes: DataFrame, frames: DataFrame) -> DataFrame:
    t, events = _takes(takes), _take_events(takes, frames)
    return T.assemble_operations(T.assemble_timeline(t.where("pass_flag"), T.accept_takes(t, events)), events, t)


@query("t16_detect_events", "v_frames", sql=f"WITH {RUNS} SELECT * FROM ev")
def t16(frames: DataFrame) -> DataFrame:
    return EV.detect_events(frames)


@query("t16_detect_events_in_chunks", "v_frames", sql=f"WITH {RUNS} SELECT * FROM ev")
def t16c(frames: DataFrame) -> DataFrame:
    return EV.detect_events_in_chunks(frames, chunk=40)


@query("t16_only_green", "v_frames", sql=f"WITH {GREEN} SELECT * FROM gn")
def t16b(frames: DataFrame) -> DataFrame:
    return EV.detect_events(frames, only_green=True)
