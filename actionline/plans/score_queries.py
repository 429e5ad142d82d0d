"""Queries over the score operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actionline.functions.rounding import exact_ratio_sql, fixed_sql
from actionline.operators import scores as S
from actionline.plans.registry import query

ENTRIES = """e AS (SELECT dir, task_id, base_timeline, is_candidate, path, no_action,
    CASE WHEN functional_score = 'success' AND coalesce(visual_score, 0) = -1 THEN 'failed' WHEN functional_score IN ('success', 'failed') THEN functional_score END AS functional,
    CASE WHEN visual_score <> -1 THEN visual_score END AS visual, CASE WHEN homepage_score <> -1 THEN homepage_score END AS homepage,
    coalesce(visual_score <> -1 AND visual_score >= 60, false) AS is_match FROM v_reports)"""
RESOLVED = f"""{ENTRIES}, l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY dir, task_id, base_timeline, is_candidate ORDER BY path DESC) = 1),
r AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY dir, task_id, base_timeline ORDER BY coalesce(functional = 'success', false) DESC, is_candidate) = 1)"""
HOME = "greatest(n_home, 1)"
VISUAL = exact_ratio_sql(f"vs * {HOME} + hs", f"{HOME} * (n_visual + (n_home > 0)::INT)", 2)
TASKS = f"""{RESOLVED}, g AS (SELECT dir, task_id, count(*) AS n_entries, count_if(functional = 'success')::BIGINT AS n_success,
    count(CASE WHEN functional = 'success' THEN visual END) AS n_visual, coalesce(sum(CASE WHEN functional = 'success' THEN visual END), 0) AS vs,
    count(homepage) AS n_home, coalesce(sum(homepage), 0) AS hs, sum(no_action)::BIGINT AS n_no_action
  FROM r GROUP BY dir, task_id),
t AS (SELECT dir, task_id, n_entries, n_success, n_visual, CASE WHEN n_visual > 0 THEN {VISUAL} END AS visual_mean,
    {exact_ratio_sql("n_success", "n_entries", 4)} AS functional_mean, concat(n_success, '/', n_entries) AS rate, n_no_action FROM g)"""


def _mean(column: str, digits: int) -> str:
    return exact_ratio_sql(f"sum({fixed_sql(column, digits)})", f"count({column}) * {10**digits}", digits)


DIRS = f"""{TASKS}, d AS (SELECT dir, {_mean("visual_mean", 2)} AS visual_mean, {_mean("functional_mean", 4)} AS functional_mean,
    count(*) AS n_tasks, count(visual_mean) AS n_tasks_visual FROM t GROUP BY dir)"""


@query("e01_parse_scores", "v_verifier", sql=r"""SELECT doc_id, CASE WHEN n = -1 THEN -1 WHEN n IS NULL THEN 0 ELSE greatest(0, least(100, n)) END AS visual_score,
  CASE WHEN lower(trim(regexp_extract(output, '\\passed\{([^}]*)\}', 1))) = 'success' THEN 'success' ELSE 'failed' END AS functional_score
  FROM (SELECT *, try_cast(regexp_extract(trim(regexp_extract(output, '\\score\{([^}]*)\}', 1)), '(-?\d+)', 1) AS INT) AS n FROM v_verifier)""")
def e01(v: DataFrame) -> DataFrame:
    return S.parse_scores(v).select("doc_id", "visual_score", "functional_score")


@query("e02_report_entries", "v_reports", sql=f"WITH {ENTRIES} SELECT * FROM e")
def e02(v: DataFrame) -> DataFrame:
    return S.report_entries(v)


def _resolved(v: DataFrame) -> DataFrame:
    return S.resolve_candidates(S.report_entries(v))


@query("e03_resolve_candidates", "v_reports", sql=f"WITH {RESOLVED} SELECT * FROM r")
def e03(v: DataFrame) -> DataFrame:
    return _resolved(v)


@query("e04_task_scores", "v_reports", sql=f"WITH {TASKS} SELECT * FROM t")
def e04(v: DataFrame) -> DataFrame:
    return S.task_scores(_resolved(v))


@query("e05_dir_scores", "v_reports", sql=f"WITH {DIRS} SELECT * FROM d")
def e05(v: DataFrame) -> DataFrame:
    return S.dir_scores(S.task_scores(_resolved(v)))


@query("e06_global_scores", "v_reports", sql=f"WITH {DIRS} SELECT {_mean('visual_mean', 2)} AS visual_mean, {_mean('functional_mean', 4)} AS functional_mean, count(*) AS n_dirs, coalesce(sum(n_tasks), 0)::BIGINT AS n_tasks FROM d")
def e06(v: DataFrame) -> DataFrame:
    return S.global_scores(S.dir_scores(S.task_scores(_resolved(v))))


@query("e07_task_detail", "v_reports", sql=f"""WITH {RESOLVED} SELECT dir, task_id, string_agg(concat(base_timeline, ':', coalesce(functional, '-'), ':', coalesce(visual::VARCHAR, '-')), ','
  ORDER BY regexp_extract(base_timeline, '(\\d+)$', 1)::INT) AS detail FROM r GROUP BY dir, task_id""")
def e07(v: DataFrame) -> DataFrame:
    return S.task_detail(_resolved(v))


@query("e08_task_order", "v_reports", sql=f"""WITH {TASKS} SELECT dir, task_id, row_number() OVER (PARTITION BY dir ORDER BY try_cast(regexp_extract(task_id, '^(\\d+)', 1) AS BIGINT) NULLS LAST, task_id) AS place FROM t""")
def e08(v: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    by = Window.partitionBy("dir").orderBy(S.numeric_prefix("task_id").asc_nulls_last(), "task_id")
    return S.task_scores(_resolved(v)).select("dir", "task_id", F.row_number().over(by).cast("long").alias("place"))


@query("e09_step_counts", "v_results", sql="""SELECT event_id % 20 AS run_id, count(*) AS total_steps, count_if(type = 'success')::BIGINT AS success, count_if(type = 'skip')::BIGINT AS no_action,
  count_if(type = 'fail')::BIGINT AS failed, count_if(type <> 'skip')::BIGINT AS executed FROM v_results GROUP BY 1""")
def e09(v: DataFrame) -> DataFrame:
    return S.step_counts(v.withColumn("run_id", F.col("event_id") % 20))


@query("e10_match_tasks", "v_code", "v_think", sql="""WITH p AS (SELECT DISTINCT id FROM v_code), f AS (SELECT DISTINCT id FROM v_think)
  SELECT id, CASE WHEN f.id IS NULL THEN 'page' WHEN p.id IS NULL THEN 'frames' ELSE 'both' END AS side FROM p FULL JOIN f USING (id)""")
def e10(code: DataFrame, think: DataFrame) -> DataFrame:
    both, only = S.match_tasks(code, think)
    return both.withColumn("side", F.lit("both")).union(only)


@query("e12_replay_set", "v_code", "v_think", "v_calls", sql="""WITH t AS (SELECT DISTINCT c.id FROM v_code c SEMI JOIN v_think k ON c.id = k.id), s AS (SELECT DISTINCT id FROM v_calls WHERE length(function_call_generate) % 3 = 0)
  SELECT id, id IN (SELECT id FROM s) AS again FROM t WHERE id IN (SELECT id FROM s) OR id NOT IN (SELECT id FROM v_calls)""")
def e12(code: DataFrame, think: DataFrame, calls: DataFrame) -> DataFrame:
    matched, _ = S.match_tasks(code, think)
    again = S.replay_set(calls.where(F.length("function_call_generate") % 3 == 0), matched)
    return again.withColumn("again", F.lit(True)).union(S.pending_tasks(matched, calls).withColumn("again", F.lit(False)))


@query("e12_append_run", "v_results", sql="""SELECT CASE WHEN event_id % 2 = 0 THEN 'first' ELSE 'second' END AS run, type AS status, count(*) AS n FROM v_results GROUP BY ALL""")
def e12b(v: DataFrame) -> DataFrame:
    history = v.where("event_id % 2 = 0").groupBy(F.lit("first").alias("run"), F.col("type").alias("status")).agg(F.count("*").alias("n"))
    return S.append_run(history, v.where("event_id % 2 <> 0"), "second")


@query("e13_homepage_targets", "v_ops", sql="""SELECT id, seg_idx, op_idx, action FROM (SELECT * FROM v_ops QUALIFY row_number() OVER (PARTITION BY id ORDER BY seg_idx, op_idx) = 1) WHERE coalesce(action, 'scroll') <> 'scroll'""")
def e13(v: DataFrame) -> DataFrame:
    return S.homepage_targets(v).select("id", "seg_idx", "op_idx", "action")
