"""Means of rounded values: exact, whatever the order of the rows or how they are dealt."""

from __future__ import annotations

import random
from fractions import Fraction

from pyspark.sql import functions as F

from actionline.functions.rounding import exact_ratio
from actionline.operators import scores
from actionline.plans import registry


def half_even(x: Fraction, digits: int) -> float:
    n = x * 10**digits
    whole, left = divmod(n, 1)
    return float(whole + (left > Fraction(1, 2) or left == Fraction(1, 2) and whole % 2 == 1)) / 10**digits


def test_exact_ratio_against_fractions(spark):
    draw = random.Random(2)
    rows = [(draw.randint(-(10**9), 10**9), draw.choice([0, 1, 2, 3, 7, 8, 40, 1000, draw.randint(1, 10**6)])) for _ in range(800)] + [(4685, 100), (5, 1000), (15, 1000), (-5, 1000), (-15, 1000), (45685, 1000), (None, 3)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", exact_ratio(F.col("a"), F.col("b"), 2).alias("x")).collect()
    assert all(r["x"] == (half_even(Fraction(r["a"], r["b"]), 2) if r["a"] is not None and r["b"] else None) for r in got)


def test_directory_means_in_every_order(spark):
    """The ten tasks of run_A, whose mean is a tie: doubles give 45.68 or 45.69 by the order of their sum."""
    tasks = scores.task_scores(scores.resolve_candidates(scores.report_entries(registry.views.view(spark, "/root/testdata/sf0.001", "v_reports")))).collect()
    run = [(r["dir"], r["task_id"], r["visual_mean"], r["functional_mean"]) for r in tasks if r["dir"] == "run_A"]
    exact = half_even(sum(Fraction(str(r[2])) for r in run) / len(run), 2)
    seen, draw = set(), random.Random(3)
    for k in range(12):
        draw.shuffle(run)
        df = spark.createDataFrame(run, "dir string, task_id string, visual_mean double, functional_mean double").repartition(1 + k % 5)
        seen.add(tuple(scores.dir_scores(df).first())[1:3])
    assert len(run) == 10 and len(seen) == 1 and seen.pop()[0] == exact


def test_task_and_global_means(spark):
    """A homepage's mean is one more point; nulls are none; all of it against fractions."""
    draw = random.Random(4)
    rows = [(f"d{i % 3}", f"t{i % 17}", draw.choice(["success", "success", "failed", None]), draw.choice([None, *range(0, 101, 7)]), draw.choice([None, None, *range(50)]), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "dir string, task_id string, functional string, visual int, homepage int, no_action int")
    tasks = {(r["dir"], r["task_id"]): r for r in scores.task_scores(df).collect()}
    by_dir: dict = {}
    for key, r in tasks.items():
        mine = [x for x in rows if x[:2] == key]
        won = [x[3] for x in mine if x[2] == "success" and x[3] is not None]
        home = [x[4] for x in mine if x[4] is not None]
        points = [*map(Fraction, won), *([Fraction(sum(home), len(home))] if home else [])] if won else []
        assert r["visual_mean"] == (half_even(sum(points) / len(points), 2) if points else None)
        assert r["functional_mean"] == half_even(Fraction(sum(x[2] == "success" for x in mine), len(mine)), 4)
        by_dir.setdefault(key[0], []).append(r)
    dirs = {d: half_even(sum(Fraction(str(r["visual_mean"])) for r in rs if r["visual_mean"] is not None) / sum(r["visual_mean"] is not None for r in rs), 2) for d, rs in by_dir.items()}
    found = scores.dir_scores(scores.task_scores(df)).collect()
    assert {r["dir"]: r["visual_mean"] for r in found} == dirs
    assert scores.global_scores(scores.dir_scores(scores.task_scores(df))).first()["visual_mean"] == half_even(sum(Fraction(str(x)) for x in dirs.values()) / len(dirs), 2)
    assert scores.global_scores(scores.dir_scores(scores.task_scores(df.limit(0)))).first()["visual_mean"] is None
