"""What keeps large sides from being moved: filters before anti-joins, late texts, sketches; and frames in any order."""

from __future__ import annotations

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from actionline.operators import annotate, assemble, dom, explore, membership
from actionline.streaming import ordered
from tests.test_operators import SERIES, model_events


@pytest.mark.parametrize("bits", [64, 1 << 14, membership.BITS])
def test_filters_never_lose_a_key(spark, bits):
    done = spark.range(0, 6000, 2).select(F.when(F.col("id") != 10, F.concat(F.lit("k"), F.col("id").cast("string"))).alias("id"))
    items = spark.range(6000).select(F.when(F.col("id") % 1000 != 7, F.concat(F.lit("k"), F.col("id").cast("string"))).alias("id"), F.col("id").alias("n"))
    hit = items.where(membership.may_be_in(done, "id", items["id"], bits))
    inside = {f"k{i}" for i in range(0, 6000, 2) if i != 10} | {None}
    found = [r["id"] for r in hit.collect()]
    assert inside & {r["id"] for r in items.collect()} <= set(found)
    assert bits < 1 << 16 or len(found) < 3300  # the others are nearly all left out
    assert {r["n"] for r in membership.not_in(items, done, bits=bits).collect()} == {r["n"] for r in items.collect() if r["id"] not in inside}
    assert annotate.remaining(items, done.limit(0), large=True).count() == 6000
    assert annotate.remaining(items.limit(0), done, large=True).count() == 0


def test_only_possible_partners_are_shuffled(spark):
    done, items = spark.range(0, 200_000, 4).withColumn("x", F.lit(1)), spark.range(200_000).withColumn("text", F.lit("t" * 50))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = {}
        for large in (False, True):
            df = annotate.remaining(items, done, large=large)
            assert df.count() == 150_000
            df = annotate.remaining(items, done, large=large)
            df.write.format("noop").mode("overwrite").save()
            plan = df._jdf.queryExecution().executedPlan().toString()
            moved[large] = plan
        assert "Subquery" in moved[True] and "LeftAnti" in moved[True]
        hit = items.where(membership.may_be_in(done, "id", items["id"]))
        assert hit.count() < 52_000  # what the exact join's exchange gets, of 200,000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_states_seen_before_by_filter_and_by_join(spark):
    states = spark.range(500).selectExpr("id AS page_id", "concat('s', id % 120) AS state")
    seen = states.where("page_id % 7 = 0")
    a, b = (sorted(r["page_id"] for r in dom.dedup_states(states, seen, large=x).collect()) for x in (False, True))
    assert a == b and len(a) > 30


def test_late_merge_equals_the_early_one(spark):
    draw = random.Random(3)
    body = lambda tag: draw.choice([f"<{tag}>x {draw.random()}</{tag}>", "nothing", None, f"pre <{tag.upper()}>\n y</{tag}> post"])
    think = spark.createDataFrame([(f"d{i}", i, body("think")) for i in range(300)] + [(None, 300, "<think>z</think>"), ("d7", 301, "<think>later</think>"), ("d9", 302, None)], "id string, line_no int, mllm_generate string")
    code = spark.createDataFrame([(f"d{i}", body("html")) for i in range(50, 400)] + [(None, "<html>q</html>")], "id string, mllm_generate string")
    early = assemble.merge_branches(assemble.last_by_id(think), code).select("id", "line_no", "reason", "merged")
    late = assemble.merge_branches_late(think, code)
    assert sorted(map(repr, early.collect())) == sorted(map(repr, late.select("id", "line_no", "reason", "merged").collect()))
    assert {r["reason"] for r in late.collect()} == {None, "no code row", "no think", "no html", "no think and no html"}
    # ids and flags alone reach the first join: its exchanges carry no text
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = assemble.merge_branches_late(think, code).select("id", "reason")._jdf.queryExecution().optimizedPlan().toString()
        joined = plan[plan.index("Join LeftOuter") :]
        assert all("mllm_generate" not in x or "isnotnull" in x.lower() for x in joined.split("\n") if "Project" in x or "Window" in x)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sketches_over_runs(spark):
    steps = spark.range(60_000).selectExpr("concat('r', id % 3) AS id", "concat('el ', id % 7) AS element_text", "int(id div 3 % 9000) AS element_id", "id % 4 = 0 AS pass_flag", "id % 6 AS run_id")
    sketches = explore.coverage_sketches(steps)
    assert sketches.count() <= 18
    exact = {r["id"]: r for r in explore.element_coverage(steps).collect()}
    for r in explore.coverage_of_sketches(sketches).collect():
        for c in ("tried", "passed"):
            assert abs(r[c] - exact[r["id"]][c]) <= 4 * explore.SKETCH_ERROR * exact[r["id"]][c]
    assert explore.coverage_of_sketches(explore.coverage_sketches(steps.limit(0))).collect() == []


def test_frames_in_any_order_over_a_restart(spark, tmp_path):
    rows = [{"take_id": f"t{k}", "frame_no": i, "fps": 16, "status": s, "ts": f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}Z"} for k, status in enumerate(SERIES[:12]) for i, s in enumerate(status)]
    random.Random(1).shuffle(rows)
    rows += rows[:50]  # some come twice
    (tmp_path / "in").mkdir()

    def put(name: int, some: list) -> None:
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(map(json.dumps, some)))
        os.utime(tmp_path / "in" / f"{name}.json", (1_700_000_000 + 100 * name,) * 2)

    def go() -> None:
        src = spark.readStream.schema("take_id string, frame_no long, fps int, status string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        ordered.started(spark, ordered.stream_events_in_order(src), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()

    before = spark.conf.get(ordered.PROVIDER)
    for p in range(3):
        put(p, rows[p::5])
    go()
    for p in (3, 4):
        put(p, rows[p::5])
    put(9, [{"take_id": None, "frame_no": 0, "fps": 16, "status": "blue", "ts": "2024-02-02T00:00:00Z"}])
    go()
    assert spark.conf.get(ordered.PROVIDER) == before
    got: dict = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("take_id", "event_no").collect():
        got.setdefault(r["take_id"], []).append((r["type"], r["start"], r["end"], r["scroll_end"]))
    assert all(got.get(f"t{k}", []) == model_events(s) for k, s in enumerate(SERIES[:12])) and len(got) >= 11
