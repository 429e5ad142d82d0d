"""Views that derive recording-shaped rows from the test tables; the same text runs on Spark and in the SQL twins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("events", "conversations", "lineitem", "documents", "pages", "embeddings")

VIEWS: dict[str, str] = {
    "v_ops": r"""
WITH e AS (SELECT user_id, event_id, event_type, value,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
o AS (SELECT concat('rec_', user_id) AS id, cast(floor((rn-1)*2/3) AS int) AS seg_idx, rn, event_id,
    CASE event_type WHEN 'click' THEN 'click' WHEN 'error' THEN 'click' WHEN 'view' THEN 'init_scroll' ELSE 'input_duration' END AS subtype,
    CASE event_type WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'input' WHEN 'signup' THEN 'select' END AS action,
    event_id % 3 = 0 AS if_scroll, event_type, value,
    cast(sum(10 + event_id % 50) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS double) / 10 AS t
  FROM e)
SELECT id, seg_idx, cast(row_number() OVER (PARTITION BY id, seg_idx ORDER BY rn) - 1 AS int) AS op_idx, subtype, action, if_scroll,
  CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN NULL ELSE t END AS global_start_time,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE t + cast(event_id % 9 AS double) / 8 END AS global_end_time,
  CASE WHEN event_id % 3 = 0 AND event_id % 19 <> 0 THEN t + cast(event_id % 9 AS double) / 8 + 1.5 END AS global_scroll_end_time,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE concat(event_type, '_', event_id % 13) END AS dom_text, concat('typed ', event_id % 7) AS input_val, concat('option ', event_id % 5) AS value
FROM o
""",
    "v_media": r"""
SELECT concat('./videos/', id, '.mp4') AS path, id, duration, length FROM (
  SELECT concat(CASE WHEN user_id % 10 = 3 THEN 'old_' ELSE 'rec_' END, user_id) AS id, cast(sum(10 + event_id % 50) AS double) / 10 + 2 AS duration, count(*) * 1000 AS length FROM events GROUP BY user_id)
""",
    "v_frames": r"""
SELECT take_id, row_number() OVER (PARTITION BY take_id ORDER BY ts, event_id) - 1 AS frame_no, 16 AS fps,
  CASE event_type WHEN 'click' THEN 'red' WHEN 'signup' THEN 'green' WHEN 'purchase' THEN 'orange' WHEN 'view' THEN 'blue' ELSE 'green' END AS status
FROM (SELECT concat('take_', CASE WHEN user_id % 60 < 30 THEN user_id % 2 ELSE user_id % 60 END, '_', cast(floor(event_id / 1500) AS bigint)) AS take_id, ts, event_id, event_type FROM events)
""",
    "v_takes": r"""
SELECT concat('rec_', conv_id) AS id, turn AS take_no,
  concat(substr(md5(concat('n', conv_id, '_', turn % 3)), 1, 4), CASE WHEN turn >= 3 THEN concat('_', substr(md5(concat('s', turn)), 1, 3)) ELSE '' END) AS name,
  (conv_id + turn) % 7 <> 0 AS pass_flag, cast(1 + length(text) % 40 AS double) / 4 AS duration, (conv_id + turn) % 5 = 0 AS is_init_scroll,
  cast((conv_id + turn) % 3 AS int) AS n_old, cast(1 + (conv_id * 3 + turn) % 11 AS int) AS n_new,
  concat('take_', CASE WHEN (conv_id * 7 + turn) % 60 < 30 THEN (conv_id * 7 + turn) % 2 ELSE (conv_id * 7 + turn) % 60 END, '_', conv_id % (SELECT cast(floor(max(event_id) / 1500) AS bigint) + 1 FROM events)) AS take_id
FROM conversations
""",
    "v_reports": r"""
SELECT concat('run_', l_returnflag) AS dir, concat(l_suppkey % 40) AS task_id, concat('timeline_', l_partkey % 12) AS base_timeline,
  l_partkey % 12 = 5 OR l_linenumber % 2 = 0 AND l_partkey % 12 NOT IN (3, 7) AS is_candidate, concat(l_orderkey, '_', l_linenumber) AS path,
  CASE WHEN l_orderkey % 7 < 4 THEN 'success' WHEN l_orderkey % 7 < 6 THEN 'failed' END AS functional_score,
  CASE WHEN l_orderkey % 11 = 0 THEN -1 WHEN l_orderkey % 13 = 0 THEN NULL ELSE cast(l_quantity * 2 AS int) END AS visual_score,
  CASE WHEN l_linenumber = 1 AND l_partkey % 12 = 0 THEN cast(l_quantity AS int) END AS homepage_score,
  CASE WHEN l_orderkey % 23 = 0 THEN 1 ELSE 0 END AS no_action
FROM lineitem
""",
    "v_think": r"""
SELECT concat('d', CASE WHEN doc_id % 10 = 9 THEN doc_id - 1 ELSE doc_id END) AS id, doc_id AS line_no,
  CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN concat('<THINK a="1">', text, '</think> tail') ELSE concat('pre <think>', text, '</think>') END AS mllm_generate
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
""",
    "v_code": r"""
SELECT concat(CASE WHEN d.doc_id % 11 = 5 THEN 'x' ELSE 'd' END, d.doc_id) AS id, d.doc_id AS line_no,
  CASE d.doc_id % 7 WHEN 0 THEN d.text WHEN 1 THEN concat('<answer>', p.html, '</answer>') WHEN 2 THEN concat('```html', p.html, '```') WHEN 3 THEN concat('``` x ', d.text, '```') ELSE concat('note ', p.html) END AS mllm_generate
FROM (SELECT doc_id, coalesce(text, '') AS text, doc_id % (SELECT max(page_id) + 1 FROM pages) AS page_id FROM documents) d
JOIN (SELECT page_id, coalesce(html, '') AS html FROM pages) p ON p.page_id = d.page_id
""",
    "v_calls": r"""
SELECT concat(CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE 'd' END, doc_id) AS id,
  CASE doc_id % 5 WHEN 0 THEN concat('<think>', text, '</think> <tool>{"video_url":"u', doc_id, '","segments":[{"start":1.5,"end":3.0}]}</tool>')
    WHEN 1 THEN concat(text, ' <tool>{"segments":[]}</tool>') WHEN 2 THEN concat('<think>x</think> ```json {"segments": [1]} ```')
    WHEN 3 THEN concat('<think>x</think> {"a": ', doc_id, '} end') ELSE text END AS function_call_generate
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
""",
    "v_forms": r"""
SELECT page_id, replace(coalesce(html, ''), '<body>', concat('<body>', CASE page_id % 5 WHEN 0 THEN '<p>' ELSE '<div id="page-form"><p>' END, page_id, CASE page_id % 5 WHEN 0 THEN '</p>' WHEN 1 THEN '</p><input type="text" value="v"></div>' WHEN 2 THEN '</p><a href="/a">go</a><input type="hidden" value="no"></div>'
  WHEN 3 THEN '</p><select id="s"><option value="1">one<option value="">none</option><option selected>three</select></div>' ELSE '</p><textarea>a b</textarea><button>send</button></div>' END)) AS html FROM pages
""",
    "v_selects": r"""
SELECT page_id, replace(coalesce(html, ''), '<body>', concat('<body><div><select id="s"><option value="', page_id % 4, '">one ', page_id, '<option value="">none ', length(coalesce(url, '')), '</option><option selected>three</select></div>')) AS html FROM pages
""",
    "v_urls": r"""
SELECT page_id * 2 AS line_no, CASE WHEN page_id % 9 = 0 THEN '   ' ELSE concat(' ', url, ' ') END AS url FROM pages
UNION ALL SELECT page_id * 2 + 1, CASE WHEN page_id % 8 = 0 THEN NULL ELSE regexp_replace(url, '[0-9]+.*$', '') END FROM pages
""",
    "v_steps": r"""
SELECT concat('rec_', user_id) AS id, event_id AS step_idx, event_type AS action, cast(event_id % 40 AS int) AS element_id,
  concat(event_type, '_', event_id % 13) AS element_text, event_type IN ('click', 'purchase') OR event_id % 5 = 0 AS pass_flag FROM events
""",
    "v_snap_new": r"""
SELECT user_id % 50 AS page_id, event_id AS el, event_type AS text, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'BUTTON' END AS tag,
  cast(floor(value) AS int) % 40 + cast(event_id % 5 AS int) - 2 AS x, cast(event_id % 300 AS int) * 10 AS y, 20 AS w, 10 + cast(event_id % 4 AS int) AS h FROM events
""",
    "v_snap_old": r"""
SELECT user_id % 50 AS page_id, event_id AS el, event_type AS text, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'BUTTON' END AS tag,
  cast(floor(value) AS int) % 40 AS x, CASE WHEN event_id % 3 = 0 THEN 100000 ELSE cast(event_id % 300 AS int) * 10 + cast(event_id % 3 AS int) END AS y, 20 AS w, 11 AS h FROM events
""",
    "v_verifier": r"""
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN concat('ok \score{', doc_id % 140, '} \passed{success}') WHEN 1 THEN concat('x \score{ -1 } \passed{ Failed }')
  WHEN 2 THEN concat('\score{about ', doc_id % 90, '/100}') WHEN 3 THEN '' WHEN 4 THEN concat('\boxed{click[', doc_id % 30, ']} \boxed{enter[', doc_id % 7, '][a b]}') ELSE concat('\boxed{None} \score{x}') END AS output FROM documents
""",
    "v_results": r"""
SELECT event_id, concat('t', event_id) AS target, CASE event_type WHEN 'error' THEN 'fail' WHEN 'view' THEN 'skip' ELSE 'success' END AS type, event_type AS reason FROM events
""",
}

#: Views whose array functions are named differently by the two engines: (Spark, twin).
ENGINE_VIEWS: dict[str, tuple[str, str]] = {
    "v_pixels": (
        "SELECT vec_id AS id, pos, cast(floor((x + 1) * 127.5 * label / 10) AS int) AS grey FROM (SELECT vec_id, label, posexplode(embedding) AS (pos, x) FROM embeddings)",
        "SELECT vec_id AS id, (pos - 1)::INT AS pos, cast(floor((x::DOUBLE + 1) * 127.5 * label / 10) AS int) AS grey FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)",
    ),
    "v_links": (
        r"""SELECT page_id, pos, regexp_extract(a, '<a href="([^"]*)">([^<]*)</a>', 2) AS text FROM (SELECT page_id, posexplode(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>', 0)) AS (pos, a) FROM pages)""",
        r"""SELECT page_id, pos::INT AS pos, regexp_extract(a, '<a href="([^"]*)">([^<]*)</a>', 2) AS text FROM (SELECT page_id, unnest(l) AS a, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>', 0) AS l FROM pages))""",
    ),
}


def text(name: str, twin: bool = False) -> str:
    return VIEWS[name] if name in VIEWS else ENGINE_VIEWS[name][twin]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of one view over the tables of sf_dir."""
    sql = text(name)
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 parquet.`{sf_dir}/{t}.parquet`", sql)
    return spark.sql(sql.replace("\\", "\\\\"))
