"""Operators that cut a long group into parts: sweeps over cuts, chunks of takes, crowded texts, ranges of one key;
and files that rows name themselves."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from actionline.operators import dom, events, package, timeline
from actionline.sources import files, io
from tests.test_operators import SERIES, model_events


@pytest.mark.parametrize("block", [0.7, 5.0, 1000.0])
def test_cut_times_against_each_cut(spark, block):
    draw = random.Random(6)
    cuts = [(f"r{k % 5}", a, a + draw.choice([0.0, 0.25, 1.5, 12.0])) for k in range(60) for a in [draw.randint(0, 160) / 8]] + [("only cuts", 1.0, 2.0), (None, 1.0, 2.0)]
    times = [(f"r{k % 6}", draw.randint(0, 200) / 8, k) for k in range(400)] + [("r1", None, 400), (None, 3.0, 401), ("none", 3.0, 402), ("r1", -2.0, 403)]
    df = timeline.cut_times(spark.createDataFrame(times, "id string, start double, __at long"), spark.createDataFrame(cuts, "id string, start double, end double"), block=block)
    want = {}
    for i, t, k in times:
        gone = sum(min(t, e) - s for j, s, e in cuts if i is not None and j == i and s < t) if t is not None else 0
        want[k] = None if t is None else max(0.0, t - gone)
    got = {r["__at"]: r["start"] for r in df.collect()}
    assert df.columns == ["id", "start", "__at"] and got.keys() == want.keys()
    assert all(got[k] is None if want[k] is None else abs(got[k] - want[k]) < 1e-9 for k in want)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("NestedLoop|Cartesian", plan)


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_events_in_chunks_equal_the_state_machine(spark, chunk):
    rows = [(f"t{k}", i, 16, s) for k, status in enumerate(SERIES) for i, s in enumerate(status)]
    got = {}
    for r in events.detect_events_in_chunks(spark.createDataFrame(rows, "take_id string, frame_no int, fps int, status string").repartition(3), chunk=chunk).orderBy("take_id", "event_no").collect():
        got.setdefault(r["take_id"], []).append((r["type"], r["start"], r["end"], r["scroll_end"]))
    assert got == {f"t{k}": e for k, s in enumerate(SERIES) if (e := model_events(s))}


def test_a_long_take_is_spread(spark):
    """One take of 300,000 frames: no window or join holds more than its chunks, and the events are the same."""
    n = 300_000
    frames = spark.range(n).select(F.concat(F.lit("t"), F.floor(F.col("id") / 10**9).cast("string")).alias("take_id"), F.col("id").alias("frame_no"), F.lit(30).alias("fps"), F.element_at(F.array(*map(F.lit, ["red", "green", "green", "orange", "blue"])), (F.pmod(F.xxhash64(F.floor(F.col("id") / 3)), F.lit(5)) + 1).cast("int")).alias("status"))
    a, b = events.detect_events(frames), events.detect_events_in_chunks(frames, chunk=20_000)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and b.count() > 30_000
    lines = [re.sub(r"^[\s:+-]+", "", x) for x in b._jdf.queryExecution().executedPlan().toString().split("\n")]
    alone = [k for k, x in enumerate(lines) if re.match(r"Exchange hashpartitioning\(take_id#\d+, \d+\)", x)]
    assert alone and all(re.match("(Hash|Sort|ObjectHash)Aggregate", lines[k + 1]) for k in alone)  # by take alone go states only


def test_crowded_texts_against_all_pairs(spark):
    draw = np.random.default_rng(1)
    make = lambda n: np.concatenate([draw.integers(0, 40, (n, 2)), draw.integers(10, 30, (n, 2))], 1)
    old, new = make(1500), make(1500)
    old[:500], new[700:1200] = old[0], old[0] + 1  # one place with a third of all
    schema = "page_id long, el int, text string, tag string, x int, y int, w int, h int"
    frame = lambda a: spark.createDataFrame([(0, i, None if i % 50 == 0 else "Buy", "A", *map(int, r)) for i, r in enumerate(a)] + [(0, -1, "Buy", "A", None, 1, 1, 1), (None, -2, "Buy", "A", *map(int, a[0]))], schema)
    some = lambda a, flag: a[[i for i in range(len(a)) if (i % 50 == 0) == flag]]
    want = {-1, -2} | {i for i, r in enumerate(new) if not (np.abs(some(old, i % 50 == 0) - r) <= 2).all(1).any()}
    for crowd in (20, 10**6):
        got = [r["el"] for r in dom.visual_changes(frame(old), frame(new), crowd=crowd).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_one_key_on_most_rows_is_split(spark):
    n = 30_000
    df = spark.range(n).select(F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, F.concat(F.lit("k"), F.col("id").cast("string"))).alias("id"), F.col("id").alias("v"))
    sc = spark.sparkContext
    sc.setJobGroup("making", "making")
    out = package.assign_shards(df, limit=500, ranges=20)
    assert not list(sc.statusTracker().getJobIdsForGroup("making"))  # nothing runs when the frame is made
    sc.setJobGroup("running", "running")
    rows = out.collect()
    counts = {}
    for r in rows:
        counts[r["part"]] = counts.get(r["part"], 0) + 1
    assert counts == dict.fromkeys(range(1, n // 500 + 1), 500)
    order = [r["id"] for r in sorted(rows, key=lambda r: r["part"])]
    assert order[:3000] == [None] * 3000 and order[3000:27000] == ["hot"] * 24000
    again = {(r["v"], r["part"]) for r in package.assign_shards(df.repartition(7), limit=500, ranges=20).collect()}
    assert again == {(r["v"], r["part"]) for r in rows}
    assert package.assign_shards(df.limit(0)).collect() == []


def test_named_files(spark, tmp_path):
    rows = [("./a/b c.mp4", b"one"), ("a/d.mp4", b"\x00\xff\n"), ("e.mp4", None), ("ü/x%20y.mp4", b"two")]
    folder = f"file://{tmp_path}/media"
    files.write_files(spark.createDataFrame(rows, "path string, content binary").repartition(3), folder)
    files.write_files(spark.createDataFrame([("e.mp4", b"again")], "path string, content binary"), folder)
    files.write_files(spark.createDataFrame([], "path string, content binary"), folder)
    assert {str(p.relative_to(tmp_path / "media")) for p in (tmp_path / "media").rglob("*") if p.is_file()} == {"a/b c.mp4", "a/d.mp4", "e.mp4", "ü/x%20y.mp4"}
    got = {(r["md5"], r["size"]) for r in files.read_digests(spark, folder).collect()}
    assert got == {(hashlib.md5(c).hexdigest(), len(c)) for c in (b"one", b"\x00\xff\n", b"again", b"two")}
    assert {r["path"] for r in files.read_digests(spark, folder).where("size = 5").collect()} == {"e.mp4"}
    for bad in (None, "", "/etc/x", "a/../../x", "a/", "."):
        with pytest.raises(Exception, match="not a path below"):
            files.write_files(spark.createDataFrame([(bad, b"x")], "path string, content binary"), folder)


def test_digests_leave_content_at_the_scan(spark, tmp_path):
    files.write_files(spark.createDataFrame([("a/1.mp4", b"one")], "path string, content binary"), f"file://{tmp_path}/m")
    manifest = spark.createDataFrame([("r", 1, "1.mp4", "a/1.mp4", True)], "id string, part long, name string, path string, present boolean")
    out = package.media_index(manifest, files.read_digests(spark, f"file://{tmp_path}/m"))
    assert [tuple(r) for r in out.collect()] == [(1, "1.mp4", hashlib.md5(b"one").hexdigest(), 3)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(content" in plan.split("Join")[1]  # below the join


@pytest.mark.parametrize("layout", ["real", "synthesis"])
def test_report_trees(spark, tmp_path, layout):
    place = "'timeline_1' base_timeline, id % 2 = 0 is_candidate" if layout == "real" else "int(id) segment, int(id + 1) operation"
    reports = spark.range(6).selectExpr("'run' dir", "string(id) task_id", *place.split(", "), "'success' functional_score", "int(id * 10) visual_score", "int(null) homepage_score", "1 no_action", "'r' name")
    files.write_files(files.report_paths(reports, layout), f"file://{tmp_path}/runs")
    found = io.read_reports(spark, f"file://{tmp_path}/runs", layout).drop("path")
    want = reports.drop("name").select(found.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
