"""Queries over the annotation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actionline.operators import annotate as A
from actionline.operators import frames as C
from actionline.operators import timeline as T
from actionline.plans.frame_queries import SCHEDULE
from actionline.plans.registry import query
from actionline.sources.shared import stored

TARGET = "coalesce(nullif(dom_text, ''), CASE action WHEN 'click' THEN 'a button' WHEN 'input' THEN 'an input field' WHEN 'select' THEN 'a select box' ELSE 'an element' END)"
ACTION = f"""CASE WHEN action IS NULL THEN 'scrolls the page without a mouse operation' WHEN action = 'click' THEN concat('clicks ''', {TARGET}, '''')
  WHEN action = 'input' THEN concat('enters ''', input_val, ''' into ''', {TARGET}, '''') WHEN action = 'select' THEN concat('selects ''', value, ''' in ''', {TARGET}, '''') ELSE concat('does ', action, ' on ''', {TARGET}, '''') END"""
NATURE = """CASE WHEN subtype = 'init_scroll' THEN 'scroll' WHEN subtype = 'click' AND if_scroll THEN 'instant then scroll' WHEN subtype = 'input_duration' AND coalesce(action = 'select', false) AND {0} THEN CASE WHEN if_scroll THEN 'selection then scroll' ELSE 'selection' END
  WHEN subtype = 'input_duration' AND if_scroll THEN 'continuous then scroll' WHEN subtype = 'input_duration' THEN 'continuous' ELSE 'instant' END"""
LABEL = "CASE " + " ".join(f"WHEN frame_type = '{k}' THEN '{v}'" for k, v in A.FRAME_LABELS.items()) + " ELSE 'transition' END"


@query("p01_describe_action", "v_ops", sql=f"SELECT id, seg_idx, op_idx, {ACTION} AS description FROM v_ops")
def p01(ops: DataFrame) -> DataFrame:
    return ops.select("id", "seg_idx", "op_idx", A.describe_action(value="input_val", chosen="value").alias("description"))


@query("p02_op_nature", "v_ops", sql=f"SELECT id, seg_idx, op_idx, {NATURE.format('true')} AS reasoning, {NATURE.format('false')} AS tool_call FROM v_ops")
def p02(ops: DataFrame) -> DataFrame:
    return ops.select("id", "seg_idx", "op_idx", A.op_nature().alias("reasoning"), A.op_nature("tool_call").alias("tool_call"))


def _frames(ops: DataFrame) -> DataFrame:
    return C.plan_frames(C.reject_unknown_subtypes(T.op_windows(ops)))


@query("p03_frame_label", "v_ops", sql=f"WITH {SCHEDULE} SELECT {LABEL} AS label, count(*) AS n FROM fr GROUP BY 1")
def p03(ops: DataFrame) -> DataFrame:
    return _frames(ops).groupBy(A.frame_label().alias("label")).agg(F.count("*").alias("n"))


NUMBERS = f"""{SCHEDULE}, fc AS (SELECT id, seg_idx, op_idx, count(*) AS n FROM fr GROUP BY ALL),
nb AS (SELECT w.*, v_ops.dom_text, v_ops.input_val, v_ops.value, coalesce(n, 0) AS n, count(*) OVER q AS op_no, sum(coalesce(n, 0)) OVER q AS upto FROM w JOIN v_ops USING (id, seg_idx, op_idx) LEFT JOIN fc USING (id, seg_idx, op_idx)
  WINDOW q AS (PARTITION BY w.id ORDER BY w.seg_idx, w.op_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("p04_number_ops_images", "v_ops", sql=f"WITH {NUMBERS} SELECT id, seg_idx, op_idx, op_no, CASE WHEN n > 0 THEN upto - n + 1 END::BIGINT AS first_img, CASE WHEN n > 0 THEN upto END::BIGINT AS last_img FROM nb")
def p04(ops: DataFrame) -> DataFrame:
    n = _frames(ops).groupBy("id", "seg_idx", "op_idx").agg(F.count("*").alias("n_frames"))
    o = T.op_windows(ops).join(n, ["id", "seg_idx", "op_idx"], "left")
    return A.number_ops_images(o).select("id", "seg_idx", "op_idx", "op_no", "first_img", "last_img")


def _inputs(ops: DataFrame, variant: str) -> DataFrame:
    out = A.build_annotation_inputs(T.op_windows(ops), C.group_frames(_frames(ops)), variant)
    return out.select("id", F.md5(F.col("instruction").cast("binary")).alias("instruction_md5"), F.length("instruction").cast("long").alias("n"), F.size("images").cast("long").alias("n_images"), F.md5(F.array_join("images", ",").cast("binary")).alias("images_md5"))


INPUTS = f"""{NUMBERS}, tl AS (SELECT id, seg_idx, op_idx, string_agg(concat('    * image ', upto - n + 1 + frame_idx, ': ', {LABEL}), e'\\n' ORDER BY frame_idx) AS told,
    string_agg(concat(id, '_seg', seg_idx, '_op', op_idx, '_t', printf('%.2f', time_seconds), '_', frame_type, '.jpg'), ',' ORDER BY frame_idx) AS paths FROM fr JOIN nb USING (id, seg_idx, op_idx) GROUP BY ALL),
ln AS (SELECT nb.*, told, paths, {ACTION} AS act, concat('images ', upto - n + 1, ' to ', upto) AS span FROM nb LEFT JOIN tl USING (id, seg_idx, op_idx)),
tx AS (SELECT *, {{}} AS line FROM ln {{}})
SELECT id, md5(string_agg(line, e'\\n' ORDER BY seg_idx, op_idx)) AS instruction_md5, length(string_agg(line, e'\\n' ORDER BY seg_idx, op_idx)) AS n, sum(n)::BIGINT AS n_images, md5(coalesce(string_agg(paths, ',' ORDER BY seg_idx, op_idx), '')) AS images_md5 FROM tx GROUP BY id"""


@query("p05_inputs_tool_call", "v_ops", sql="WITH " + INPUTS.format(f"""CASE WHEN n > 0 THEN concat('## ', op_no, e'\\n  - from ', printf('%.1f', start), ' to ', printf('%.1f', "end"), e'\\n  - ', act, ' (', {NATURE.format('false')}, e')\\n  - ', span, e'\\n') ELSE '' END""", ""))
def p05(ops: DataFrame) -> DataFrame:
    return _inputs(ops, "tool_call")


@query("p05_inputs_reasoning", "v_ops", sql="WITH " + INPUTS.format(f"""concat('## ', op_no, ' ', act, ' - ', {NATURE.format('true')}, CASE WHEN n > 0 THEN concat(e'\\n  - ', span, e'\\n', told) ELSE '' END, e'\\n')""", ""))
def p05b(ops: DataFrame) -> DataFrame:
    return _inputs(ops, "reasoning")


@query("p05_inputs_page_code", "v_ops", sql="WITH " + INPUTS.format("""concat(CASE WHEN row_number() OVER (PARTITION BY id, seg_idx ORDER BY op_idx) = 1 THEN concat('## segment ', seg_idx + 1, e':\\n') ELSE '' END, '  - ', op_idx + 1, ': ', act, e'\\n    ', span, e'\\n', told)""", "WHERE n > 0"))
def p05c(ops: DataFrame) -> DataFrame:
    return _inputs(ops, "page_code")


@query("p06_remaining", "v_think", "v_code", sql="SELECT id, line_no FROM v_think ANTI JOIN v_code USING (id)")
def p06(think: DataFrame, code: DataFrame) -> DataFrame:
    return A.remaining(think, code).select("id", "line_no")


@query("p06_remaining_large", "v_think", "v_code", sql="SELECT id, line_no FROM v_think ANTI JOIN v_code USING (id)")
def p06b(think: DataFrame, code: DataFrame) -> DataFrame:
    return A.remaining(think.select("id", "line_no"), code, large=True)


@query("p07_run_rounds", "v_calls", sql="SELECT id, CASE WHEN length(function_call_generate) % 3 = 0 THEN 0 WHEN length(function_call_generate) % 3 = 1 THEN 1 END AS round FROM v_calls WHERE length(function_call_generate) % 3 < 2")
def p07(calls: DataFrame) -> DataFrame:
    step = lambda left, k: left.where(F.length("function_call_generate") % 3 == k).select("id", F.lit(k).alias("round"))
    return A.run_rounds(calls, step, lambda df, k: stored(df, f"round{k}"), max_rounds=2)


@query("p08_quality_gate", "v_calls", sql="""WITH n AS (SELECT id, row_number() OVER (ORDER BY id) AS k, function_call_generate AS t FROM v_calls), o AS (SELECT id, 1 + length(t) % 3 AS n_ops, t FROM n) SELECT id, n_ops FROM o WHERE length(t) >= CASE WHEN n_ops >= 2 THEN 60 ELSE 40 END""")
def p08(calls: DataFrame) -> DataFrame:
    t = calls.withColumn("n_ops", 1 + F.length("function_call_generate") % 3)
    return A.quality_gate(t, "function_call_generate", "n_ops", 40, 60).select("id", F.col("n_ops").cast("long").alias("n_ops"))
