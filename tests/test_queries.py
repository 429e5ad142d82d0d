"""Every registered query against its twin in SQL, and rows for those without one."""

from __future__ import annotations

import re

import duckdb
import pytest

from actionline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return float(x) if type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in registry.ORACLES:
        assert df.columns
        return
    rel = db.execute(registry.ORACLES[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    double = {c for c, k in df.dtypes if k == "double"}
    read = lambda r: repr(tuple(plain(float(v) if n in double and v is not None else v) for n, v in zip(names, r, strict=True)))
    assert sorted(read([r[n] for n in names]) for r in rows) == sorted(map(read, rel.fetchall()))


@pytest.mark.parametrize("name", ["e04_task_scores", "t02_op_windows", "m02_merge_branches", "x12_visual_changes", "m13_assign_shards", "c02_plan_frames"])
def test_plans_are_native_and_without_cross_products(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|PythonUDF|ArrowEval|InPandas|InArrow", plan)
