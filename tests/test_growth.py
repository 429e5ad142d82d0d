"""What only larger tables show: recordings of every kind, trees and shards of many files, streams of many frames."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from actionline.operators import package, timeline
from actionline.plans import registry
from actionline.sources import files, io

OPS = "array<struct<op_idx:int,subtype:string,start:double,end:double,finish:double>>"


def test_recordings_without_an_init_scroll(spark):
    """Among many recordings some have no init_scroll segment: their parts stay as they are."""
    seg = lambda i, kind, a, b: (i, [(0, kind, a, b, None)])
    segments = {"with": [seg(0, "init_scroll", 1.0, 3.5), seg(1, "click", 9.0, 11.0)], "without": [seg(0, "click", 2.0, 4.0), seg(1, None, 9.0, 11.0)]}
    recordings = spark.createDataFrame(list(segments.items()), f"id string, segments array<struct<seg_idx:int,ops:{OPS}>>")
    parts = spark.createDataFrame([(k, i, 8.0 * i, [s]) for k, v in segments.items() for i, s in enumerate(v)], f"id string, part int, begin double, segments array<struct<seg_idx:int,ops:{OPS}>>")
    rows = timeline.prepend_init_scroll(parts, recordings, ("subtype", "start", "end", "finish")).collect()
    got = {(r["id"], r["part"]): (r["with_init"], r["offset"], [(s["seg_idx"], s["ops"][0]["start"], s["ops"][0]["end"]) for s in r["segments"]]) for r in rows}
    assert got == {
        ("with", 0): (False, 0.0, [(0, 1.0, 3.5)]), ("with", 1): (True, 5.5, [(0, 0.0, 2.5), (1, 3.5, 5.5)]),
        ("without", 0): (False, 0.0, [(0, 2.0, 4.0)]), ("without", 1): (False, 8.0, [(1, 1.0, 3.0)]),
    }


def test_ranges_are_found_once_for_each_row(spark):
    """No list is sorted anew for each of its elements, and ranges are not computed for the rows that df is made from."""
    df = spark.range(3000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n")).select(F.concat(F.lit("r"), F.col("k").cast("string")).alias("id"), "n")
    out = package.assign_shards(df, limit=7, ranges=9, sample=5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"filter\(sort_array|Filter isnotnull\((transform|size|coalesce)", plan)
    want = {k: i // 7 + 1 for i, k in enumerate(sorted(f"r{k}" for k in range(1000)))}
    assert {r["id"]: r["part"] for r in out.collect()} == want


def test_folders_of_shards_are_made_by_many_tasks(spark, tmp_path):
    df = spark.range(400).select(F.col("id").cast("string").alias("id"), (F.col("id") % 40 + 1).alias("part"))
    io.write_shards(df, str(tmp_path / "s"), manifest=df)
    for name in ("s", "s-manifest"):
        found = list((tmp_path / name).glob("part=*/*.json"))
        assert len(found) == 40 and len({p.name[:10] for p in found}) > 1
        assert sum(len(p.read_text().splitlines()) for p in found) == 400


ODD = {
    "run/task_1/timeline_1/a.json": b'{"summary": {"no_action": 2},\r\n "global_verification": {"visual_score": 7, "functional_score": "success"}}',
    "run/task_1/timeline_1_candidate/b c%20\xc3\xbc#.json".encode("latin-1").decode(): b'\xef\xbb\xbf{"homepage_similarity": {"visual_score": 3}}',
    "run/task_2/timeline_3/deep/er/utf16.json": '{"summary": {"no_action": 1}}'.encode("utf-16"),
    "run/task_2/timeline_3/list.json": b' [{"summary": {"no_action": 4}}, {"summary": {"no_action": 5}}]',
    "run/task_2/timeline_3/half.json": b'[{"summary": {"no_action": 4}}, {"summary": {"no_action": "x"}}]',
    "run/task_2/timeline_3/empty.json": b"", "run/task_2/timeline_3/blank.json": b" \n", "run/task_2/timeline_3/null.json": b"null", "run/task_2/timeline_3/none.json": b"[]",
    "run/task_2/timeline_3/kind.json": b'{"summary": {"no_action": "x"}}', "run/task_2/timeline_3/more.json": b'{"summary": {"no_action": 6}} trailing',
    "run/task_2/timeline_3/bytes.json": b'{"global_verification": {"functional_score": "\xff"}}', "run/task_2/timeline_3/line.json": b'{"global_verification": {"functional_score": "a\nb"}}',
    "run/task_2/timeline_3/other.txt": b"{}", "run/task_2/timeline_3/_hidden.json": b"{}", "run/.task_3/timeline_3/x.json": b"{}", "run/_task_3/timeline_3/x.json": b"{}", "else/x.json": b"{}", "x.json": b"{}",
}


@pytest.mark.parametrize(("enough", "wide"), [(1000, 10_000), (1, 10_000), (1000, 1)])
def test_trees_are_walked_by_tasks(spark, tmp_path, monkeypatch, enough, wide):
    """The rows of Spark's own reader, while the plan holds no list of files."""
    monkeypatch.setattr(files, "FOLDERS", enough)
    monkeypatch.setattr(files, "WIDE", wide)
    for name, content in ODD.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    for root in (f"file://{tmp_path}", f"{tmp_path}/", f"{tmp_path}/run/task_2"):
        got = io.read_reports(spark, root)
        assert not got.inputFiles()
        with monkeypatch.context() as m:
            m.setattr(files, "read_texts", lambda *_: None)
            want = io.read_reports(spark, root)
        assert got.dtypes == want.dtypes
        rows = sorted(map(repr, got.collect()))
        assert rows == sorted(map(repr, want.collect())) and len(rows) >= 4
    assert io.read_reports(spark, f"{tmp_path}/r*n").inputFiles()  # a pattern of paths is Spark's to list
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        io.read_reports(spark, f"{tmp_path}/none")


@pytest.mark.parametrize("name", ["s06_read_reports_real", "s06_read_reports_synthesis"])
def test_plans_of_report_queries_list_no_files(spark, name):
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert not df.inputFiles() and df.count() > 100
