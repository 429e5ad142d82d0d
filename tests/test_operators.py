"""Branches that the tables don't reach, and small independent models of the case-heavy rules."""

from __future__ import annotations

import json
import math
import os
import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from actionline.functions.rounding import py_round
from actionline.operators import assemble, dom, events, explore, frames, package, pages, scores, timeline
from actionline.plans import registry
from actionline.sources import io
from actionline.streaming import stream


def test_op_windows_cases(spark):
    schema = "id string, seg_idx int, op_idx int, subtype string, action string, if_scroll boolean, global_start_time double, global_end_time double, global_scroll_end_time double"
    rows = [
        ("r", 0, 0, "click", "click", False, 0.4, 9.0, None), ("r", 0, 1, "click", "click", True, 5.0, 6.0, 8.04), ("r", 0, 2, "click", "click", True, 5.0, 6.0, None),
        ("r", 0, 3, "input_duration", "input", False, 5.0, 6.26, None), ("r", 0, 4, "input_duration", "input", True, 5.0, 6.0, 7.0), ("r", 0, 5, "init_scroll", None, True, 5.0, 6.0, 7.0),
        ("r", 0, 6, "init_scroll", None, False, 5.0, 6.0, None), ("r", 0, 7, "drag", None, False, 5.0, 6.0, None), ("r", 0, 8, "click", None, False, None, 6.0, None),
    ]
    got = {r["op_idx"]: r for r in timeline.op_windows(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {0, 1, 3, 4, 5, 6, 7}
    assert got[0]["start"] == 0.0 and got[0]["after"] > 0 and 1.4 <= got[0]["end"] <= 1.9
    assert (got[1]["end"], got[1]["after"], got[3]["end"], got[4]["end"], got[4]["finish"]) == (8.0, 0.0, 6.3, 7.0, 6.0)
    assert (got[5]["start"], got[5]["end"], got[5]["finish"], got[6]["finish"]) == (5.0, 7.0, 6.0, None)
    assert (got[7]["start"], got[7]["end"]) == (0.0, 0.0) and got[7]["after"] >= 1.0


def model_parts(weights, target=10):
    total = sum(weights)
    if total <= target:
        return [0] * len(weights)
    count, part, now, out = math.ceil(total / target), 0, 0, []
    for w in weights:
        if part < count - 1 and now > 0 and abs(now - total / count) < abs(now + w - total / count):
            part, now = part + 1, 0
        out.append(part)
        now += w
    return out


def test_assign_parts_follows_the_rule(spark):
    draw = random.Random(1)
    cases = [[], [3], [25], [10], [0, 0, 12, 0], *([draw.choice([0, 1, 2, 4, 5, 8]) for _ in range(draw.randint(1, 40))] for _ in range(120))]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, w array<int>")
    for r in df.select("i", timeline.assign_parts(F.col("w")).alias("p")).collect():
        assert r["p"] == model_parts(cases[r["i"]])


def test_cuts(spark):
    df = spark.createDataFrame([(t,) for t in (0.0, 1.0, 1.5, 2.0, 2.5, 4.0, 9.0)], "t double").withColumn("c", F.expr("array(named_struct('start', 1.0D, 'end', 2.0D), named_struct('start', 3.0D, 'end', 5.0D))"))
    assert [r[0] for r in df.select(timeline.apply_cuts(F.col("t"), F.col("c"))).collect()] == [0.0, 1.0, 1.0, 1.0, 1.5, 2.0, 6.0]
    cuts = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.05, 3.0)], "id string, start double, end double")
    kept = timeline.keep_intervals(cuts, spark.createDataFrame([("a", 10.0), ("b", 4.0)], "id string, duration double"))
    assert sorted(map(tuple, kept.collect())) == [("a", 0.0, 1.0), ("a", 3.0, 10.0), ("b", 0.0, 4.0)]


def test_prefix_takes(spark):
    takes = spark.createDataFrame([("r", n) for n in ("", "a", "ab", "ab", "b", "abc")] + [("s", "")], "id string, name string")
    assert sorted(map(tuple, timeline.drop_prefix_takes(takes).collect())) == [("r", "abc"), ("r", "b"), ("s", "")]


def model_events(status, fps=16):
    """The state machine, frame by frame."""
    out, last, green, orange = [], None, None, False
    for i, s in enumerate(status):
        t = (i + 1) / fps
        if s == "red" and last != "red":
            if green is not None:
                out.append(["duration", green, t, None])
                green = None
            out.append(["point", t, t, None])
        if s == "green":
            green = t if green is None else green
        elif green is not None:
            if t - green > 0.1:
                out.append(["duration", green, t, None])
            green = None
        if s == "orange":
            orange = True
        elif orange:
            orange = False
            if out:
                out[-1][3] = t
        last = s
    end = len(status) / fps
    if green is not None:
        out.append(["duration", green, end, None])
    elif orange and out:
        out[-1][3] = end
    return [tuple(x) for x in out]


SERIES = [
    ["orange", "orange", "red", "orange", "red"], ["green", "red", "green", "green", "red"], ["green", "blue", "green", "green", "blue"], ["blue", "green"], ["orange", "orange"], ["red", "orange"],
    *([random.Random(i).choice(["red", "green", "green", "orange", "blue"]) for _ in range(60)] for i in range(0)),
]
SERIES += [[r.choice(["red", "green", "green", "orange", "blue"]) for _ in range(80)] for r in (random.Random(k) for k in range(25))]


def test_events_equal_the_state_machine(spark):
    rows = [(f"t{k}", i, 16, s) for k, status in enumerate(SERIES) for i, s in enumerate(status)]
    got = {}
    for r in events.detect_events(spark.createDataFrame(rows, "take_id string, frame_no int, fps int, status string")).orderBy("take_id", "event_no").collect():
        got.setdefault(r["take_id"], []).append((r["type"], r["start"], r["end"], r["scroll_end"]))
    assert got == {f"t{k}": e for k, s in enumerate(SERIES) if (e := model_events(s))}


def test_streamed_events_equal_batch(spark, tmp_path):
    rows = [{"take_id": f"t{k}", "frame_no": i, "fps": 16, "status": s, "ts": f"2024-01-01T00:00:{i // 2:02d}Z"} for k, status in enumerate(SERIES[:12]) for i, s in enumerate(status)]
    for part in range(4):  # frames come in four files
        (tmp_path / "in").mkdir(exist_ok=True)
        mine = [r for r in rows if r["frame_no"] * 4 // 80 == part or (part == 3 and r["frame_no"] >= 80)]
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(map(json.dumps, mine)))
    (tmp_path / "in" / "late.json").write_text("\n".join(json.dumps({"take_id": "end", "frame_no": k, "fps": 16, "status": "blue", "ts": f"2024-01-02T0{k}:00:00Z"}) for k in range(3)))
    for k, name in enumerate(["0", "1", "2", "3", "late"]):  # files are taken by their age
        os.utime(tmp_path / "in" / f"{name}.json", (1_700_000_000 + 100 * k,) * 2)
    src = spark.readStream.schema("take_id string, frame_no int, fps int, status string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = stream.stream_events(src).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("take_id", "event_no").collect():
        got.setdefault(r["take_id"], []).append((r["type"], r["start"], r["end"], r["scroll_end"]))
    for k, s in enumerate(SERIES[:12]):
        assert got.get(f"t{k}", []) == model_events(s), k


def test_streamed_records_and_progress(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"id": f"r{i}", "mllm_generate": "x"}) for i in range(k, k + 4)))
    args = (str(tmp_path / "out"), str(tmp_path / "ck"))
    read = lambda: stream.stream_records(spark, str(tmp_path / "in"), "id string, mllm_generate string")
    stream.ingest(read(), *args).awaitTermination()
    (tmp_path / "in" / "9.json").write_text('{"id": "r1", "mllm_generate": "again"}\n{"id": "new", "mllm_generate": "y"}')
    stream.ingest(read(), *args).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(args[0]).collect()) == ["new", "r0", "r1", "r2", "r3", "r4", "r5"]
    counts = stream.stream_progress(spark.readStream.schema("type string").json(str(tmp_path / "in")))
    q = counts.writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("progress").collect()[0]["n"] == 14


def test_sources_and_sinks(spark, tmp_path):
    op = {"type": "point", "subtype": "click", "if_scroll": False, "global_start_time": 1.0, "action_detail": {"action": "click", "id": "3"}}
    (tmp_path / "rec").mkdir()
    (tmp_path / "rec" / "a1.json").write_text(json.dumps({"html_file": "h", "action_frames_timeline_filtered": [{"segment_index": 0, "operations": [op, op]}]}, indent=1))
    (tmp_path / "rec" / "bad.json").write_text("{ not json")
    rec = io.read_recordings(spark, str(tmp_path / "rec"))
    assert [r["id"] for r in rec.collect()] == ["a1"] and io.recording_ops(rec).select("action").collect()[1][0] == "click"
    (tmp_path / "x.jsonl").write_text('{"id": "1"}\n\nnot json\n{"id": "2"}\n')
    assert io.read_jsonl(spark, str(tmp_path / "x.jsonl"), "id string").count() == 2
    assert io.read_jsonl(spark, str(tmp_path / "x.jsonl"), "id string", count_bad=True).cache().where("_bad is not null").count() == 1
    for path, score in (("run/task_7/timeline_1/r.json", "failed"), ("run/task_7/timeline_1_candidate/r.json", "success"), ("run/other/r.json", "success")):
        (tmp_path / path).parent.mkdir(parents=True)
        (tmp_path / path).write_text(json.dumps({"global_verification": {"functional_score": score, "visual_score": 70}}))
    reports = io.read_reports(spark, str(tmp_path / "run"))
    best = scores.resolve_candidates(scores.report_entries(reports)).collect()
    assert [(r["dir"], r["task_id"], r["base_timeline"], r["is_candidate"], r["functional"]) for r in best] == [("run", "7", "timeline_1", True, "success")]
    df = spark.createDataFrame([("1", None, 1), ("2", "é", 2)], "id string, t string, part int")
    io.write_jsonl(df, str(tmp_path / "out"))
    lines = sorted(x for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines())
    assert lines == ['{"id":"1","t":null,"part":1}', '{"id":"2","t":"é","part":2}']
    io.write_shards(df, str(tmp_path / "shards"))
    assert sorted(p.name for p in (tmp_path / "shards").glob("part=*")) == ["part=1", "part=2"]


def test_candidates_and_scores(spark):
    schema = "dir string, task_id string, base_timeline string, is_candidate boolean, path string, functional string, visual int, homepage int, no_action int, is_match boolean"
    e = lambda t, cand, f, path="p", v=None, h=None: ("d", "t", t, cand, path, f, v, h, 0, False)
    rows = [e("a", False, "failed"), e("a", True, "success", v=80), e("b", False, "failed"), e("b", True, "failed"), e("c", True, "failed"), e("d", False, "success", v=60, h=50), e("d", True, "success"), e("f", False, "success", "p1", 1), e("f", False, "failed", "p2")]
    best = scores.resolve_candidates(spark.createDataFrame(rows, schema))
    assert {r["base_timeline"]: (r["is_candidate"], r["functional"]) for r in best.collect()} == {"a": (True, "success"), "b": (False, "failed"), "c": (True, "failed"), "d": (False, "success"), "f": (False, "failed")}
    t = scores.task_scores(best).first()
    assert (t["n_entries"], t["n_success"], t["visual_mean"], t["functional_mean"], t["rate"]) == (5, 2, 63.33, 0.4, "2/5")


def test_tool_text(spark):
    texts = ["<think>a</think> x", "plan <tool>{}</tool>", "nothing", "", None, "  <think>b</think>"]
    got = [r["status"] for r in assemble.repair_tool_text(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, function_call_generate string")).orderBy("i").collect()]
    assert got == ["good", "fixed", "failed", "failed", "failed", "good"]
    bodies = ['x ```json {"a": 1} ``` y ```json {"a": 1} ```', "a <tool> {b} </tool> c", 'p {"k": [1, 2]} q', "p {bad q", "none"]
    rows = assemble.extract_tool_payload(spark.createDataFrame([(i, t) for i, t in enumerate(bodies)], "i int, function_call_generate string")).orderBy("i").collect()
    assert [(r["payload"], r["rest"]) for r in rows] == [('{"a": 1}', "x  y"), ("{b}", "a  c"), ('{"k": [1, 2]}', "p  q"), (None, None), (None, None)]


def test_html_routes(spark):
    texts = ["<answer> <HTML a='1'>x</HTML> </answer>", "```html <p> ```", "``` any ```", "  bare ", None, "<answer>in</answer> <html>out</html>"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(assemble.extract_html("t")).collect()]
    assert got == ["<HTML a='1'>x</HTML>", "<p>", "any", "bare", "", "in"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 12)), min_size=1, max_size=8))
def test_uniform_index_rule(cases):
    for n, k in cases:
        kept = list(range(n)) if n <= k else ([0] if k == 1 else sorted({int(round(i * (n - 1) / (k - 1))) for i in range(k)}))
        assert len(kept) <= k or n <= k
        assert not n or k == 1 or (kept[0] == 0 and kept[-1] == n - 1)


def test_uniform_frames(spark):
    df = spark.createDataFrame([(f"g{n}", i) for n in (1, 2, 5, 7, 30) for i in range(n)], "take_id string, frame_no int")
    for k in (1, 4, 5):
        got = {}
        for r in frames.uniform_frames(df, k).collect():
            got.setdefault(r["take_id"], []).append(r["frame_no"])
        for n in (1, 2, 5, 7, 30):
            want = [0] if k == 1 else list(range(n)) if n <= k else sorted({int(round(i * (n - 1) / (k - 1))) for i in range(k)})
            assert sorted(got[f"g{n}"]) == want


def test_shards_number_every_row(spark):
    df = spark.createDataFrame([(f"id{i % 700}", i) for i in range(2500)], "id string, v int")
    rows = package.assign_shards(df, limit=400).orderBy("id").collect()
    counts = {}
    for r in rows:
        counts[r["part"]] = counts.get(r["part"], 0) + 1
    assert counts == {1: 400, 2: 400, 3: 400, 4: 400, 5: 400, 6: 400, 7: 100}
    assert [r["part"] for r in rows] == sorted(r["part"] for r in rows)


def test_page_images(spark):
    grey, noise = bytes([120] * 192), bytes((i * 37) % 256 for i in range(192))
    df = spark.createDataFrame([("flat", 8, 8, grey), ("noise", 8, 8, noise), ("cut", 8, 8, grey[:5]), ("none", 8, 8, None)], "id string, w int, h int, rgb binary")
    assert {r["id"]: r["blank"] for r in pages.blank_stats(df).collect()} == {"flat": True, "noise": False, "cut": True, "none": True}
    assert {r["id"]: r["ratio"] for r in pages.solid_rgb(df).collect()}["flat"] == 1.0


def test_nodes_and_actions(spark):
    html = "<body><div id='topnav'><a href='/x'>Go <b>now</b></a><script>var a = '<a>no</a>'</script></div><p>text<form><input type='text'><input type='hidden'><button disabled>B</button></form><span onclick='f()'>S</span></body>"
    nodes = {r["node_id"]: r for r in dom.page_nodes(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()}
    assert [(n["tag"], n["text"], n["zone"], n["can_interact"]) for _, n in sorted(nodes.items()) if n["text"] is not None] == [("A", "Go now", "nav", True), ("INPUT", "", "form", True), ("BUTTON", "B", "form", False), ("SPAN", "S", "body", True)]
    assert all(n["parent_id"] is None or n["parent_id"] > i for i, n in nodes.items())
    df = spark.createDataFrame([("click[1], enter[2][a, b]",), ("click[1], fly[2]",), ("scroll[down",), ('enter[3]["x"]',)], "t string")
    strict = [r[0] for r in df.select(explore.format_actions(explore.parse_actions("t"))).collect()]
    assert strict == ["click[1], enter[2][a, b]", None, None, "enter[3][x]"]
    assert df.select(explore.format_actions(explore.parse_actions("t", "tolerant"))).collect()[2][0] == "scroll[down]"
    assert spark.createDataFrame([("enter[2][a[0], b]",)], "t string").select(explore.parse_nested_actions("t")).first()[0][0]["value"] == "a[0], b"


def test_deep_and_long_pages(spark):
    began = time.perf_counter()
    for html, n in (("<div>" * 50_000 + "<a>x</a>" + "</div>" * 50_000, 50_001), ("<p>x</p>" * 100_000, 0), ("<a " * 50_000, 0), ("<x>" * 20_000 + "</y>" * 20_000 + "<b onclick=1>t", 20_001)):
        assert len([r for r in dom._page(html) if r[3] != ""]) in (n, n - 1)
    assert time.perf_counter() - began < 30


def test_values_options_and_addresses(spark):
    html = "<main><select id='s'><option value='1'>one<option>two<option value='' selected>three</select><textarea> a\n b</textarea><input value='v'><input type='radio' value='r'><select></select></main>"
    nodes = dom.page_nodes(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string"))
    rows = [r for r in nodes.orderBy("node_id").collect() if r["address"]]
    assert [(r["tag"], r["input_value"], r["options"] and len(r["options"]), r["address"]) for r in rows] == [("SELECT", None, 3, "main--"), ("TEXTAREA", " a\n b", None, "main--"), ("INPUT", "v", None, "main--"), ("INPUT", None, None, "main--"), ("SELECT", None, [], "main--")]
    values = dom.select_values(dom.options_of(nodes)).collect()
    assert [r["values"] for r in values] == [["1", "two", "three"]]


def test_takes_are_accepted_by_their_events(spark):
    schema = "id string, take_no int, take_id string, pass_flag boolean, is_init_scroll boolean, old_moments array<double>, new_moments array<double>, actions_detail array<string>, duration double, name string"
    takes = spark.createDataFrame([
        ("r", 0, "t0", True, True, None, None, None, 4.0, "init"), ("r", 1, "t1", True, False, [1.0], [2.0], ["a", "b"], 5.0, "one"), ("r", 2, "t1", True, False, [], [2.0], ["a"], 5.0, "few"),
        ("r", 3, "t1", False, False, [1.0], [2.0], ["a", "b"], 5.0, "failed"), ("r", 4, "t1", True, None, [1.0, 2.0], None, ["c", "d"], 5.0, "last"), ("r", 5, "none", True, False, [], [1.0], ["a"], 5.0, "without"),
    ], schema)
    row = "take_id string, event_no int, type string, start double, end double, scroll_end double, if_scroll boolean"
    marks = spark.createDataFrame([("t1", 0, "point", 0.5, 0.5, 0.75, True), ("t1", 1, "duration", 1.0, 2.0, None, False)], row)
    green = spark.createDataFrame([("t0", 0, "duration", 0.25, 1.0, 1.0, True), ("t0", 1, "duration", 2.0, 3.5, None, False)], row)
    found = timeline.take_events(takes, marks, green)
    ok = timeline.accept_takes(takes, found)
    assert sorted(r["take_no"] for r in ok.collect()) == [0, 1, 4]
    line = timeline.assemble_timeline(takes.where("pass_flag"), ok)
    assert [(r["segment_index"], r["segment_start_time"], r["segment_end_time"]) for r in line.orderBy("segment_index").collect()] == [(0, 0.0, 4.0), (1, 4.0, 9.0), (3, 9.0, 14.0)]
    ops = timeline.assemble_operations(line, found, takes).orderBy("segment_index", "op_idx").collect()
    assert [(o["type"], o["subtype"], o["is_duration"], o["if_scroll"], o["global_start_time"], o["global_end_time"], o["global_scroll_end_time"], o["duration_seconds"], o["action_detail"]) for o in ops] == [
        ("Init Scroll Operation", "init_scroll", True, True, 0.25, 3.5, 3.5, 3.25, None),
        ("Old Operation", "click", True, True, 5.5, 4.5, 4.75, None, "a"), ("New Operation", "input_duration", True, False, 5.0, 6.0, None, 1.0, "b"),
        ("Old Operation", "click", True, True, 10.5, 9.5, 9.75, None, "c"), ("Old Operation", "input_duration", True, False, 10.0, 11.0, None, 1.0, "d"),
    ]


def test_long_recordings_are_split_in_proportion(spark):
    rows = spark.range(3).select(F.col("id").cast("string").alias("id"), F.expr("transform(sequence(0, 3999), i -> named_struct('seg_idx', i, 'ops', array(named_struct('op_idx', 0, 'if_scroll', i % 3 = 0))))").alias("segments"))
    timeline.split_recordings(rows.limit(1)).count()  # compile first
    began = time.perf_counter()
    got = timeline.split_recordings(rows).select("id", "part", F.size("segments").alias("n")).collect()
    assert time.perf_counter() - began < 10
    parts = model_parts([4 if i % 3 == 0 else 1 for i in range(4000)])
    assert sorted((r["part"], r["n"]) for r in got if r["id"] == "1") == sorted((p, parts.count(p)) for p in set(parts))


def test_conversations_tell_tools_and_hold_their_record(spark):
    prompt = assemble.system_prompt([{"name": "é", "a": [1]}, None, {"name": "b"}])
    assert '<tools>\n{"name": "é", "a": [1]}\n{"name": "b"}\n</tools>' in prompt and "{tool_text}" not in prompt and prompt.endswith("...\n</tool_call>")
    schema = "id string, video_path string, clip_video_list array<string>, clip_urls array<string>, question string, payload string, rest string, answer string, shard_uuid string, reference string"
    r = spark.createDataFrame([("1", "a/v.mp4", ["c/1.mp4"], ["u"], "q", '{"b": 1.50,\n "a": [1, "é"]}', "r", "x", "s", "ref"), ("2", None, None, None, "q", None, None, "x", None, None)], schema)
    info = spark.createDataFrame([("v.mp4", 7, 9, 2.9)], "name string, h int, w int, sec double")
    rows = {x["id"]: x for x in assemble.to_conversations(r, info, prompt).collect()}
    one = rows["1"]
    assert one["metadata"]["source_path"] == "a/v.mp4" and "reference" not in json.loads(one["metadata"]["orig_video_dict"]) and one["media_size"] == {"video0": [7, 9, 2], "video1": [0, 0, 0]}
    assert one["conversations"][0]["text"] == prompt and json.loads(one["conversations"][2]["tool_call"])["arguments"] == '{"b":1.5,"a":[1,"é"]}'
    assert rows["2"]["conversations"] is None


def test_compact_json_like_the_standard_library(spark):
    draw = random.Random(11)

    def value(depth):
        kind = draw.randint(0, 6 if depth else 4)
        if kind < 5:
            return draw.choice([None, True, draw.randint(-9, 10**20), draw.random() * 1e9, "é\n\"x\\ ", ""])
        return [value(depth - 1) for _ in range(draw.randint(0, 3))] if kind == 5 else {draw.choice("abcé"): value(depth - 1) for _ in range(draw.randint(0, 3))}

    texts = [json.dumps(value(3), indent=draw.choice([None, 1])) for _ in range(200)] + ["{not\n   json", "", "[1,\n 2", '{"a": 1, "a": 2}']
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(assemble.compact_json("t")).collect()]
    for text, mine in zip(texts[:200], got[:200], strict=True):
        assert mine == json.dumps(json.loads(text), separators=(",", ":"), ensure_ascii=False)
    assert got[200:] == ["{not" + "json", "", "[1,2", '{"a":2}']


def test_frame_sets_and_shards_with_manifests(spark, tmp_path):
    f = spark.createDataFrame([("t", s, o) for s in ("segment_10", "segment_2", "segment_x") for o in ("operation_11", "operation_3", "operation_3")], "id string, segment_name string, operation_name string")
    assert [(s["segment_name"], list(s["operations"])) for s in scores.frame_sets(f).first()["segments"]] == [(s, ["operation_3", "operation_11"]) for s in ("segment_2", "segment_10", "segment_x")]
    records = spark.createDataFrame([("1", 1, "v/1.mp4", ["c/1.mp4"]), ("2", 2, "v/2.mp4", None)], "id string, part int, video_path string, clip_video_list array<string>")
    manifest = package.media_manifest(records, spark.createDataFrame([("v/1.mp4",)], "path string"))
    io.write_shards(records, str(tmp_path / "s"), manifest=manifest)
    back = spark.read.schema("id string, name string, present boolean, part int").json(str(tmp_path / "s-manifest"))
    assert sorted((r["part"], r["name"], r["present"]) for r in back.collect()) == [(1, "1.mp4", False), (1, "1.mp4", True), (2, "2.mp4", False)]
    for path in ("run/task_7/segment_0/operation_12", "run/task_7/segment_0/operation_2", "run/other"):
        (tmp_path / path).mkdir(parents=True)
        (tmp_path / path / "r.json").write_text(json.dumps({"global_verification": {"functional_score": "success", "visual_score": 1}}))
    reports = io.read_reports(spark, str(tmp_path / "run"), "synthesis")
    assert sorted((r["dir"], r["task_id"], r["segment"], r["operation"], r["functional_score"]) for r in reports.collect()) == [("run", "7", 0, 2, "success"), ("run", "7", 0, 12, "success")]


def test_merged_outputs_are_numbered_in_order(spark):
    a = spark.createDataFrame([("10", "x"), ("b", "y")], "id string, v string")
    b = spark.createDataFrame([("9",), ("a",), ("-1",)], "id string")
    got = {r["place"]: (r["id"], r["v"]) for r in io.placed(io.merge_worker_outputs([a, b])).collect()}
    assert got == {1: ("-1", None), 2: ("9", None), 3: ("10", "x"), 4: ("a", None), 5: ("b", "y")}


def test_states_differ_from_the_third_link_on(spark, tmp_path):
    page = '<a href="/a">a</a><a href="/b">b</a><a href="/{0}">{0}</a>'
    spark.createDataFrame([(i, f"http://h/{i}", page.format(x)) for i, x in enumerate("ccd")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r["page_id"] for r in registry.QUERIES["x10_dedup_states"](spark, str(tmp_path)).collect()) == [0, 2]


def test_visual_changes_against_all_pairs(spark):
    draw = random.Random(9)
    old = [(0, i, draw.choice("ab"), "A", draw.randint(0, 9), draw.randint(0, 60), 20, 10) for i in range(60)]
    new = [(0, i, draw.choice("ab"), "A", draw.randint(0, 9), draw.randint(0, 60), 20 + i % 4, 10) for i in range(80)]
    schema = "page_id long, el int, text string, tag string, x int, y int, w int, h int"
    got = {r["el"] for r in dom.visual_changes(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()}
    assert got == {n[1] for n in new if not any(o[2:4] == n[2:4] and all(abs(a - b) <= 2 for a, b in zip(o[4:], n[4:], strict=True)) for o in old)}


def test_py_round(spark):
    values = [2.675, 0.125, 0.025, -2.675, None, 1e20]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(py_round(F.col("x"))).collect()]
    assert got == [None if v is None else round(v, 2) for v in values]
