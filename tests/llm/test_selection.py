"""Resampling, vector codes and the quality field against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from actionline.llm import compression, quality, resampling
from tests.llm.test_operators import ODD, docs

SF = "/root/testdata/sf0.001"


def plain_resampled(rows, target, most, buckets, percent, least, seed):
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    grams = lambda w: [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1)]
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            for g in grams(words(text)):
                counts[g] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out, drawn = [], []
    for i, (doc, text) in enumerate(rows):
        g = grams(words(text))
        weight = sum(gain[x] for x in g)
        score = None
        if doc is not None:
            h = int(hashlib.sha256(f"{seed}:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
            if len(words(text)) >= least:
                drawn.append((-score, doc, len(g), weight, i))
        out.append([doc, len(g), weight, score, None])
    for rank, x in enumerate(sorted(drawn)[: len(drawn) * percent // 100], 1):
        out[x[-1]][-1] = rank
    return sorted((tuple(x) for x in out), key=repr)


@pytest.mark.parametrize("most", [1, 3])
def test_resampling_against_plain_loops(spark, most):
    draw = random.Random(5)
    texts = ODD + [" ".join(draw.choice(["Alpha", "beta", "gamma9", "été", "x-y", "\n", "Ünder"]) for _ in range(draw.randint(1, 40))) for _ in range(150)] * 2
    rows = list(enumerate(texts)) + [(None, "alpha " * 30), (3, "beta " * 25), (3, "beta " * 25)]
    d = docs(spark, texts, extra=[(i, t, None, None, 1, 1, 1.0, "", 1) for i, t in rows[len(texts) :]]).repartition(5)
    target = ["Alpha beta été", None, "gamma9 x"]
    t = spark.createDataFrame([(x, 1) for x in target], "text string, bucket int")
    got = sorted((tuple(r) for r in resampling.resampled(d, t, most=most, buckets=50, percent=30, least_words=5, seed=7).collect()), key=repr)
    assert got == plain_resampled(rows, target, most, 50, 30, 5, 7)


def test_resampling_of_odd_tables(spark):
    none, one = docs(spark, []), docs(spark, ["a b c " * 20])
    assert resampling.resampled(none, one).collect() == []
    assert [tuple(r)[:2] for r in resampling.resampled(one, none, percent=100).collect()] == [(0, 60)]
    assert resampling.resampled(one, none, percent=100).first()["rank"] == 1


def test_slices_and_long_texts(monkeypatch):
    texts = pa.array(["a b", None, "", "c d e " * 10, "a"])
    whole = [(i, c) for rows, crc in [next(resampling.runs(*resampling.words(texts), 1))] for i, c in zip(rows.tolist(), crc.tolist(), strict=True)]
    monkeypatch.setattr(resampling, "SLICE_BYTES", 7)
    parts = []
    for at, part in resampling.slices(texts):
        rows, crc = next(resampling.runs(*resampling.words(part), 1))
        parts += zip((rows + at).tolist(), crc.tolist(), strict=True)
    assert parts == whole and len(whole) == 33


def plain_codes(rows, positions=4, entries=256, rounds=4):
    """rows of (vec_id, label, vector), as the method's rules say, on Python's whole numbers."""
    rows = [r for r in rows if r[2] and all(x is not None and math.isfinite(x) for x in r[2])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    d = len(rows[0][2])
    rows = [r for r in rows if len(r[2]) == d]
    width = -(-d // positions)
    whole = [[math.floor(x * 1024) for x in r[2]] + [0] * (width * positions - d) for r in rows]
    codes, errors, books = [[] for _ in rows], [0] * len(rows), []
    for p in range(positions):
        parts = [w[p * width : (p + 1) * width] for w in whole]
        book = [list(x) for x in parts[:entries]]
        far = lambda x: [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book]  # noqa: E731, B023
        for _ in range(rounds):
            members = {}
            for x in parts:
                members.setdefault(min(range(len(book)), key=far(x).__getitem__), []).append(x)
            for e, found in members.items():
                book[e] = [sum(c) // len(found) for c in zip(*found, strict=True)]
        for i, x in enumerate(parts):
            e = min(range(len(book)), key=far(x).__getitem__)
            codes[i].append(f"{e:02x}")
            errors[i] += far(x)[e]
        books += itertools.chain.from_iterable(book)
    sha, label = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest(), {}
    for r, e in zip(rows, errors, strict=True):
        label[r[1]] = label.get(r[1], 0) + e
    return sorted(((r[0], "".join(c), e, label[r[1]], sha) for r, c, e in zip(rows, codes, errors, strict=True)), key=repr)


VECTORS = "vec_id long, label int, embedding array<float>, position int, part string, key long"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS)


def codes(df, **how):
    return sorted((tuple(r) for r in compression.compressed(df, **how).collect()), key=repr)


@pytest.mark.parametrize(("owner", "scale", "d"), [(4096, 1.0, 8), (5, 1.0, 10), (3, 60_000.0, 8)])
def test_codes_against_plain_loops(spark, monkeypatch, owner, scale, d):
    """A third of all rows are equal; owners are small, so an entry has several; large components take the exact way."""
    monkeypatch.setattr(compression, "OWNER", owner)
    draw = np.random.default_rng(3)
    rows = [(i, int(i % 4) if i % 5 else None, (draw.standard_normal(d) * scale / 4).clip(-scale, scale).astype("f4").tolist()) for i in range(70)]
    rows += [(100 + i, 1, rows[3][2]) for i in range(35)]
    rows += [(7, 2, rows[8][2]), (7, 2, rows[8][2]), (None, 3, rows[9][2])]
    rows += [(-1, 1, None), (-2, 1, []), (-3, 1, [math.nan] * d), (-4, 1, [None] + [1.0] * (d - 1)), (-5, None, [math.inf] * d), (500, 1, [1.0] * (d + 1))]
    assert codes(vectors(spark, rows).repartition(4), entries=16) == plain_codes(rows, entries=16)


def test_codes_of_odd_tables(spark):
    assert codes(vectors(spark, [])) == [] == codes(vectors(spark, [(1, 1, None), (2, 1, [])]))
    rows = [(5, None, [0.5, -0.25, 1.0]), (6, None, [0.5, -0.25, 1.0])]  # fewer rows than entries, fewer components than parts
    assert codes(vectors(spark, rows)) == plain_codes(rows)
    with pytest.raises(ValueError, match="magnitude"):
        codes(vectors(spark, [(1, 1, [1e6] * 4)]))


def test_members_of_owners_are_not_shuffled(spark):
    """Only the parts that moved are: sums and the next assignment read each bucket where it lies."""
    rows = [(i, 1, [float(i % 7), 1.0, 2.0, float(i % 3)]) for i in range(40)]
    books = np.arange(8).reshape(4, 2, 1)
    cut = compression.cut(vectors(spark, rows).selectExpr("monotonically_increasing_id() key", "vec_id", "string(label) label", "cast(embedding as array<double>) v"), 4, 4)
    parts = compression.assign(cut, books)
    home = compression.Residents(spark, 3)
    home.migrate(parts, parts.groupBy("position", "entry").count().withColumnRenamed("count", "n"))
    plan = compression._reassigned(home.rows(moved=False), books)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan
    assert home.rows(moved=False).count() == 160
    home.drop()


def plain_lines(text):
    """Steps and length of each line of a text, by plain loops over its bytes."""
    kind = lambda b: quality._KIND[b]
    out, seen = [], set()
    for line in text.encode().split(b"\n"):
        blank = bytes(b for b in range(256) if kind(b) == 0)
        words = [w for w in re.split(b"[" + re.escape(blank) + b"]+", line) if w]
        if not words:
            continue
        count = [sum(kind(b) == k for b in line) for k in range(7)]
        n, solid = len(words), sum(count[1:])
        m = {
            "upper": count[2] / max(count[1] + count[2], 1), "signs": count[5] / solid, "marks": count[4] / solid, "digits": count[3] / solid, "signed": sum(kind(w[-1]) == 5 for w in words) / n,
            "lone": sum(len(w) == 1 and kind(w[0]) == 5 for w in words) / n, "again": sum(a == b for a, b in itertools.pairwise(words)) / n, "distinct": len(set(words)) / n, "words": n, "long": solid / n,
            "seen": tuple(words) in seen, "ended": kind(words[-1][-1]) == 4,
        }
        seen.add(tuple(words))
        out.append(([sum(m[k] > x for x in bounds) for k, bounds in quality.STEPS.items()], len(line.decode())))
    return out


def test_lines_against_plain_loops():
    draw = random.Random(8)
    pool = ["The", "the", "été", "x!!", "a$$$", "|", "&", "1234", "end.", "ÜBER", "GO", "\n", "\n", "\t", " ", "  ", "\r\n", "a a a", "日本"]
    texts = [x or "" for x in ODD] + [" ".join(draw.choice(pool) for _ in range(draw.randint(0, 60))) for _ in range(300)] + ["a\n", "\nb", "c", "", "d\n\nd"]
    found = quality.lines(pa.array(["skip", *texts]).slice(1))
    for i, text in enumerate(texts):
        mine = found.row == i
        assert list(zip(found.steps[mine].tolist(), found.length[mine].tolist(), strict=True)) == plain_lines(text), repr(text)


def test_marginals_and_gradient_against_all_labellings():
    draw = np.random.default_rng(4)
    row = np.repeat([0, 2, 3, 7], [3, 1, 5, 2])
    found = quality.Lines(row, np.stack([draw.integers(0, len(s) + 1, len(row)) for s in quality.STEPS.values()], 1).astype(np.uint8), np.ones(len(row), int))
    flat = draw.standard_normal(3 * quality.SIZE + 4) / 3
    field, good = quality.Field.of(flat), draw.random(8) < 0.5
    e = quality.emissions(found, field)
    chance, total, _ = quality.marginals(e, *quality.chains(row), field.step)
    value = 0.0
    for first, count in zip(*map(np.ndarray.tolist, quality.chains(row)), strict=True):
        weight = {y: math.exp(sum(e[first + i] * y[i] for i in range(count)) + sum(field.step[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=count)}
        for i in range(count):
            assert chance[first + i] == pytest.approx(sum(w for y, w in weight.items() if y[i]) / sum(weight.values()))
        value -= math.log(weight[(int(good[row[first]]),) * count] / sum(weight.values()))
    got, slope = quality.loss(found, good, field)
    assert got == pytest.approx(value)
    for k in draw.choice(len(flat), 60, replace=False).tolist() + list(range(len(flat) - 4, len(flat))):
        step = np.eye(1, len(flat), k)[0] * 1e-5
        near = quality.loss(found, good, quality.Field.of(flat + step))[0] - quality.loss(found, good, quality.Field.of(flat - step))[0]
        assert near / 2e-5 == pytest.approx(slope[k], abs=1e-4)


def test_quasi_newton_finds_the_minimum():
    a = np.diag([1.0, 10.0, 100.0, 3.0])
    goal = np.array([1.0, -2.0, 3.0, 0.5])
    assert quality.minimum(lambda x: (float((x - goal) @ a @ (x - goal)), 2 * a @ (x - goal)), 4, 200) == pytest.approx(goal, abs=0.05)


def test_quality_held_out(spark):
    from actionline.llm.common import table

    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels").selectExpr("doc_id", "quality").where("quality is not null")
    rows = quality.op13_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows) and len(rows) > 50


def test_quality_of_odd_rows(spark):
    good, bad = "The man went home.\nHe ate a long meal.", "A$$$ b&&& c%%% d###\nx||| y%%% z&&&"
    texts = [good, bad] * 30 + ODD
    d = docs(spark, texts, extra=[(None, good, None, None, 1, 1, 1.0, "", 1), (0, good, None, None, 1, 1, 1.0, "", 1)])
    y = spark.createDataFrame([(i, 1 - i % 2, "x") for i in range(60)] + [(None, 1, "x"), (3, None, "x"), (1000, 1, "x")], "doc_id long, quality int, text string")
    field = quality.fit(d, y)
    got = [(r["doc_id"], r["score"], r["predicted"]) for r in quality.scored(d, field).collect()]
    assert len(got) == len(texts) + 2
    by = {i: s for i, s, _ in got}
    assert by[0] > 0.9 > 0.1 > by[1] and by[None] == by[0]
    assert by[60] == by[61] == by[62] == by[63] == field.rest == pytest.approx(0.5, abs=0.1)
    marks = {(r["doc_id"], r["line"]): r for r in quality.judged_lines(d, field).collect()}
    assert marks[1, 2]["good"] < 0.1 and marks[0, 1]["n_chars"] == 18
    assert quality.scored(docs(spark, []), field).collect() == []
    unknown = quality.fit(d, y.where("doc_id is null"))
    assert {round(r["score"], 9) for r in quality.scored(d, unknown).collect()} == {0.5}
