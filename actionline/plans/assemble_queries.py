"""Queries over merging, cleaning and conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actionline.operators import assemble as M
from actionline.plans.registry import query

THINK = "t AS (SELECT * FROM v_think QUALIFY row_number() OVER (PARTITION BY id ORDER BY line_no DESC) = 1)"
TP, HP = (f"nullif(regexp_extract({a}.mllm_generate, '(?is)<{t}[^>]*>(.*?)</{t}>', 0), '')" for a, t in (("t", "think"), ("c", "html")))
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
MERGED = rf"""{THINK}, x AS (SELECT t.id, t.line_no, c.id IS NULL AS nocode, {TP} AS tp, {HP} AS hp FROM t LEFT JOIN v_code c USING (id)),
mg AS (SELECT id, line_no, CASE WHEN nocode THEN 'no code row' WHEN tp IS NULL AND hp IS NULL THEN 'no think and no html' WHEN tp IS NULL THEN 'no think' WHEN hp IS NULL THEN 'no html' END AS reason,
  CASE WHEN tp IS NOT NULL AND hp IS NOT NULL THEN concat(tp, e'\n```html\n', {STRIP.format('hp')}, e'\n```') END AS merged FROM x)"""


def _merged(think: DataFrame, code: DataFrame) -> DataFrame:
    return M.merge_branches(M.last_by_id(think), code).drop("mllm_generate")


@query("s03_last_by_id", "v_think", sql=f"WITH {THINK} SELECT id, line_no FROM t")
def s03(think: DataFrame) -> DataFrame:
    return M.last_by_id(think).select("id", "line_no")


@query("m01_extract_tag", "v_think", sql="SELECT line_no, nullif(regexp_extract(mllm_generate, '(?is)<think[^>]*>(.*?)</think>', 0), '') AS block FROM v_think")
def m01(think: DataFrame) -> DataFrame:
    return think.select("line_no", M.extract_tag("mllm_generate", "think").alias("block"))


@query("m02_merge_branches", "v_think", "v_code", sql=f"WITH {MERGED} SELECT id, line_no, reason, md5(merged) AS merged_md5 FROM mg")
def m02(think: DataFrame, code: DataFrame) -> DataFrame:
    return _merged(think, code).select("id", "line_no", "reason", F.md5(F.col("merged").cast("binary")).alias("merged_md5"))


@query("m02_merge_branches_late", "v_think", "v_code", sql=f"WITH {MERGED} SELECT id, line_no, reason, md5(merged) AS merged_md5 FROM mg")
def m02b(think: DataFrame, code: DataFrame) -> DataFrame:
    return M.merge_branches_late(think, code).select("id", "line_no", "reason", F.md5(F.col("merged").cast("binary")).alias("merged_md5"))


@query("m03_merge_stats", "v_think", "v_code", sql=f"WITH {MERGED} SELECT coalesce(reason, 'merged') AS reason, count(*) AS n FROM mg GROUP BY 1")
def m03(think: DataFrame, code: DataFrame) -> DataFrame:
    return M.merge_stats(_merged(think, code))


@query("m04_sample_missing", "v_think", "v_code", sql=f"WITH {MERGED} SELECT id, reason FROM mg WHERE reason IN ('no think', 'no think and no html') ORDER BY md5(concat(id, ':7')), id LIMIT 50")
def m04(think: DataFrame, code: DataFrame) -> DataFrame:
    return M.sample_missing(_merged(think, code)).select("id", "reason")


@query("m05_attach_tool_calls", "v_think", "v_code", "v_calls", sql=f"WITH {MERGED} SELECT id, function_call_generate FROM mg LEFT JOIN v_calls USING (id) WHERE merged IS NOT NULL")
def m05(think: DataFrame, code: DataFrame, calls: DataFrame) -> DataFrame:
    return M.attach_tool_calls(_merged(think, code).where("merged is not null"), calls).select("id", "function_call_generate")


@query("m05_missing_tool_calls", "v_think", "v_code", "v_calls", sql=f"WITH {MERGED} SELECT id FROM mg ANTI JOIN v_calls USING (id) WHERE merged IS NOT NULL")
def m05b(think: DataFrame, code: DataFrame, calls: DataFrame) -> DataFrame:
    return M.missing_tool_calls(_merged(think, code).where("merged is not null"), calls)


HTML = rf"""b AS (SELECT id, line_no, CASE WHEN regexp_matches(mllm_generate, '(?is)<answer>.*?</answer>') THEN regexp_extract(mllm_generate, '(?is)<answer>(.*?)</answer>', 1) ELSE mllm_generate END AS body FROM v_code),
h AS (SELECT id, line_no, {STRIP.format("coalesce(nullif(regexp_extract(body, '(?is)<html.*?>.*?</html>', 0), ''), CASE WHEN regexp_matches(body, '(?is)```html.*?```') THEN regexp_extract(body, '(?is)```html(.*?)```', 1) END, CASE WHEN regexp_matches(body, '(?is)```.*?```') THEN regexp_extract(body, '(?is)```(.*?)```', 1) END, body)")} AS html FROM b)"""


@query("m06_extract_html", "v_code", sql=f"WITH {HTML} SELECT id, md5(html) AS html_md5, length(html) AS n FROM h")
def m06(code: DataFrame) -> DataFrame:
    return code.withColumn("html", M.extract_html("mllm_generate")).select("id", F.md5(F.col("html").cast("binary")).alias("html_md5"), F.length("html").cast("long").alias("n"))


@query("m07_html_previews", "v_code", sql=f"WITH {HTML} SELECT CASE WHEN line_no % 9 = 0 THEN concat('unknown_', line_no) ELSE id END AS id, md5(html) AS html_md5 FROM h WHERE contains(lower(html), '<html')")
def m07(code: DataFrame) -> DataFrame:
    some = code.withColumn("id", F.when(F.col("line_no") % 9 != 0, F.col("id")))
    return M.html_previews(some).select("id", F.md5(F.col("html").cast("binary")).alias("html_md5"))


REPAIRED = rf"""r AS (SELECT id, function_call_generate AS t, CASE WHEN function_call_generate = '' THEN 'failed' WHEN starts_with({STRIP.format('function_call_generate')}, '<think>') AND contains(function_call_generate, '</think>') THEN 'good' WHEN contains(function_call_generate, '<tool>') THEN 'fixed' ELSE 'failed' END AS status FROM v_calls),
q AS (SELECT id, status, CASE WHEN status = 'fixed' THEN concat('<think>', substr(t, 1, instr(t, '<tool>') - 1), '</think>', substr(t, instr(t, '<tool>'))) ELSE t END AS text FROM r)"""


@query("m10_repair_tool_text", "v_calls", sql=f"WITH {REPAIRED} SELECT * FROM q")
def m10(calls: DataFrame) -> DataFrame:
    return M.repair_tool_text(calls).select("id", "status", "text")


@query("m10_repair_counts", "v_calls", sql=f"WITH {REPAIRED} SELECT status, count(*) AS n FROM q GROUP BY 1")
def m10b(calls: DataFrame) -> DataFrame:
    return M.repair_tool_text(calls).groupBy("status").agg(F.count("*").alias("n"))


PROMPTS = ["Rebuild the page.", "Write the page that this recording shows.", "Give the code of the page."]


@query("m11_build_training_records", "v_calls", sql=f"""WITH {REPAIRED}, p AS (SELECT id, text, ['Rebuild the page.', 'Write the page that this recording shows.', 'Give the code of the page.'][('0x' || substr(md5(concat(id, ':prompt:7')), 1, 8))::BIGINT % 3 + 1] AS prompt FROM q WHERE status <> 'failed')
  SELECT id, pos, type, text FROM (SELECT id, 0 AS pos, 'Q' AS type, concat('<url>u_', id, '</url>', prompt) AS text FROM p UNION ALL SELECT id, 1, 'A', text FROM p UNION ALL SELECT id, 2, 'O', '' FROM p UNION ALL SELECT id, 3, 'A', concat('m_', id) FROM p)""")
def m11(calls: DataFrame) -> DataFrame:
    r = M.repair_tool_text(calls).where("status <> 'failed'")
    r = r.select("id", F.col("text").alias("function_call_generate"), F.concat(F.lit("u_"), "id").alias("fake_video_url"), F.lit("v.mp4").alias("video_path"), F.array().cast("array<string>").alias("clip_video_list"), F.concat(F.lit("m_"), "id").alias("mllm_generate"))
    return M.build_training_records(r, PROMPTS).select("id", F.posexplode("reference").alias("pos", "r")).select("id", "pos", "r.type", "r.text")


def _pick(n: int, *parts: str) -> str:
    return f"('0x' || substr(md5(concat({', '.join(parts)})), 1, 8))::BIGINT % {n}"


def _host(kind: str) -> str:
    return f"{M.HOSTS[kind]}[{_pick(len(M.HOSTS[kind]), 'id', repr(f':host_{kind}:7'))} + 1]"


def _one(values: list[str], what: str) -> str:
    return f"{values}[{_pick(len(values), 'id', repr(f':{what}:7'))} + 1]"


@query("m12_synthetic_url", "v_code", sql=f"""SELECT id, CASE WHEN s < 40 THEN concat('https://', {_host("file")}, CASE WHEN {_pick(2, 'id', "':named:7'")} = 1 THEN concat('/', {_one(M.FOLDERS, 'folder')}, '/2024/', lpad(({_pick(12, 'id', "':month:7'")} + 1)::VARCHAR, 2, '0'), '/', {_one(M.WORDS, 'word')}, '_', {_pick(99, 'id', "':no:7'")} + 1)
    ELSE concat('/u/', substr(md5(concat(id, ':a:7')), 1, 8), '/', substr(md5(concat(id, ':b:7')), 1, 16)) END, {_one(M.SUFFIXES, 'suffix')})
  WHEN s < 60 THEN concat('https://', {_host("short")}, '/', substr(md5(concat(id, ':a:7')), 1, 6)) WHEN s < 80 THEN concat('https://', {_host("short")}, '/api/v1/res/', {_pick(9_900_000, 'id', "':res:7'")})
  ELSE concat('https://', {_host("long")}, '/', substr(md5(concat(id, ':a:7')), 1, 4), '/', substr(md5(concat(id, ':b:7')), 1, 24), '?auth=', substr(md5(concat(id, ':c:7')), 1, 8)) END AS url FROM (SELECT id, {_pick(100, 'id', "':style:7'")} AS s FROM v_code)""")
def m12(code: DataFrame) -> DataFrame:
    return code.select("id", M.synthetic_url().alias("url"))


PAYLOAD = rf"""z AS (SELECT id, function_call_generate AS t, nullif(regexp_extract(function_call_generate, '(?s)```json\s*(.*?)\s*```', 0), '') AS f, nullif(regexp_extract(function_call_generate, '(?s)<tool>\s*(.*?)\s*</tool>', 0), '') AS o,
    instr(function_call_generate, '{{') AS a, CASE WHEN contains(function_call_generate, '}}') THEN length(function_call_generate) - instr(reverse(function_call_generate), '}}') + 1 ELSE 0 END AS b FROM v_calls),
y AS (SELECT *, CASE WHEN a > 0 AND b > a AND json_valid(substr(t, a, b - a + 1)) THEN substr(t, a, b - a + 1) END AS br FROM z),
pl AS (SELECT id, CASE WHEN f IS NOT NULL THEN {STRIP.format(r"regexp_extract(f, '(?s)```json\s*(.*?)\s*```', 1)")} WHEN o IS NOT NULL THEN {STRIP.format(r"regexp_extract(o, '(?s)<tool>\s*(.*?)\s*</tool>', 1)")} ELSE br END AS payload,
  CASE WHEN f IS NOT NULL THEN {STRIP.format("replace(t, f, '')")} WHEN o IS NOT NULL THEN {STRIP.format("replace(t, o, '')")} WHEN br IS NOT NULL THEN {STRIP.format("concat(substr(t, 1, a - 1), substr(t, b + 1))")} END AS rest FROM y)"""


@query("m17_extract_tool_payload", "v_calls", sql=f"WITH {PAYLOAD} SELECT * FROM pl")
def m17(calls: DataFrame) -> DataFrame:
    return M.extract_tool_payload(calls).select("id", "payload", "rest")


@query("m18_compact_json", "v_calls", sql=rf"WITH {PAYLOAD} SELECT id, CASE WHEN json_valid(payload) THEN json(payload)::VARCHAR ELSE regexp_replace(payload, '\n\s*', '', 'g') END AS arguments FROM pl WHERE payload IS NOT NULL")
def m18(calls: DataFrame) -> DataFrame:
    return M.extract_tool_payload(calls).where("payload is not null").select("id", M.compact_json("payload").alias("arguments"))


TOOL = {"name": "extract_segments", "parameters": {"video_url": "string", "segments": "array"}}


def _talks(calls: DataFrame, code: DataFrame, media: DataFrame) -> DataFrame:
    r = M.extract_tool_payload(calls).join(code.select("id", F.md5(F.col("mllm_generate").cast("binary")).alias("answer")), "id")
    clips = F.transform(F.sequence(F.lit(1), F.coalesce(F.length("payload") % 3, F.lit(1)) + 1), lambda i: F.concat(F.lit("c/"), F.col("id"), F.lit("_"), i.cast("string"), F.lit(".mp4")))
    r = r.withColumn("clip_video_list", clips).withColumn("clip_urls", F.transform("clip_video_list", lambda c: F.md5(c.cast("binary"))))
    r = r.withColumn("video_path", F.concat(F.lit("./videos/rec_"), (F.length("function_call_generate") % 97).cast("string"), F.lit(".mp4")))
    r = r.withColumn("question", F.lit("Rebuild the page.")).withColumn("shard_uuid", F.concat(F.lit("s"), (F.length("rest") % 5).cast("string")))
    info = media.select(F.concat("id", F.lit(".mp4")).alias("name"), F.lit(720).alias("h"), F.lit(1280).alias("w"), F.col("duration").alias("sec"))
    return M.to_conversations(r, info, M.system_prompt([TOOL]))


@query("m19_to_conversations", "v_calls", "v_code", "v_media", sql=rf"""WITH {PAYLOAD}, k AS (SELECT pl.*, function_call_generate AS t, md5(c.mllm_generate) AS answer, concat('rec_', length(function_call_generate) % 97, '.mp4') AS name,
    [concat(id, '_', i, '.mp4') FOR i IN range(1, coalesce(length(payload) % 3, 1)::INT + 2)] AS clips FROM pl JOIN v_code c USING (id) JOIN v_calls USING (id)),
  g AS (SELECT k.*, CASE WHEN json_valid(payload) THEN json(payload)::VARCHAR ELSE regexp_replace(payload, '
\s*', '', 'g') END AS args, floor(m.duration)::INT AS sec FROM k LEFT JOIN v_media m ON concat(m.id, '.mp4') = k.name)
  SELECT id, array_to_string(list_concat([concat('video0=', name)], [concat('video', i, '=', clips[i]) FOR i IN range(1, len(clips) + 1)]), ',') AS media,
    array_to_string(list_concat([CASE WHEN sec IS NULL THEN 'video0=0/0/0' ELSE concat('video0=720/1280/', sec) END], [concat('video', i, '=0/0/0') FOR i IN range(1, len(clips) + 1)]), ',') AS sizes,
    CASE WHEN payload IS NOT NULL THEN md5(concat('system:false:', '{M.system_prompt([TOOL])}', e'
user:false:<|media=video0|>Rebuild the page.
assistant:true:', rest, '{{"name":"extract_segments","arguments":', to_json(args), '}}', e'
observation:false:',
      array_to_string([concat('<|media=video', i, '|><url>', md5(concat('c/', clips[i])), '</url>') FOR i IN range(1, len(clips) + 1)], ''), e'
assistant:true:', answer)) END AS talk, concat('./videos/', name) AS source FROM g""")
def m19(calls: DataFrame, code: DataFrame, media: DataFrame) -> DataFrame:
    t = _talks(calls, code, media)
    listed = lambda c, show: F.array_join(F.transform(F.array_sort(F.map_entries(c)), show), ",")
    turn = lambda x: F.concat(x["role"], F.lit(":"), x["if_train"].cast("string"), F.lit(":"), x["text"], F.coalesce(x["tool_call"], F.lit("")))
    names = listed("media_map", lambda e: F.concat(e["key"], F.lit("="), F.element_at(e["value"], -1)))
    sizes = listed("media_size", lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"].cast("array<string>"), "/")))
    return t.select("id", names.alias("media"), sizes.alias("sizes"), F.md5(F.array_join(F.transform("conversations", turn), "\n").cast("binary")).alias("talk"), F.col("metadata.source_path").alias("source"))


@query("m20_conversion_stats", "v_calls", "v_code", "v_media", sql=f"WITH {PAYLOAD} SELECT concat('s', length(rest) % 5) AS shard_uuid, count_if(payload IS NOT NULL)::BIGINT AS converted, count_if(payload IS NULL)::BIGINT AS filtered FROM pl JOIN v_code USING (id) WHERE rest IS NOT NULL GROUP BY 1 UNION ALL SELECT NULL, 0, count(*) FROM pl JOIN v_code USING (id) WHERE rest IS NULL")
def m20(calls: DataFrame, code: DataFrame, media: DataFrame) -> DataFrame:
    return M.conversion_stats(_talks(calls, code, media))
