"""The pipeline, stage by stage, on the smallest table; and every twin in SQL of this subpackage."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from actionline.llm import minhash, secrets, toxicity
from actionline.llm.common import written
from actionline.llm.queries import ORACLES, QUERIES
from tests.llm.test_operators import brute, crc, ids_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twins(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = db.execute(ORACLES[name])
    names = [c[0] for c in rel.description]
    assert sorted(rel.fetchall(), key=repr) == sorted((tuple(r[n] for n in names) for r in QUERIES[name](spark, SF).collect()), key=repr)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = written(stage(spark, before, SF), name)
        assert after.columns == names
        a, b = ({r["doc_id"]: r for r in d.collect()} for d in (before, after))
        assert set(b) <= set(a)
        if name == "toxicity":
            assert len(b) >= 0.7 * len(a) and all(a[i] == b[i] for i in b)
        if name == "minhash":
            sets = {i: set(minhash.shingles(r["text"]).tolist()) for i, r in b.items()}
            assert not any(sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for i, j in itertools.combinations(sets, 2))
        if name == "secrets":
            assert set(a) == set(b) and not any(secrets.find_secrets(r["text"]) for r in b.values())
        before = after
    packed = corpus_pipeline.STAGES[4][1](spark, before, SF)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in before.select("doc_id").distinct().collect()}


def test_rows_that_repeat_a_doc_id_are_judged_by_their_texts(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(60)) for w in ("a", "b", "c"))
    rows = [(5, one), (5, two), (5, one + " more"), (5, one), (3, three), (5, three), (6, two), (7, None), (7, ""), (7, ""), (7, "few"), (None, one), (None, one)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()), key=repr)
    first = [x for x in got if x[0] == 5 and x[1].startswith("a")]
    assert len(first) == 1 and first[0][1] in (one, one + " more")
    assert got == sorted([*first, (5, two), (3, three), (7, None), (7, ""), (7, "few"), (None, one), (None, one)], key=repr)
    again = corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), SF)
    assert again.columns == docs.columns and again.count() == 0


#: Names that the operators use inside, as columns of the input.
CLASHES = "row whole cut copies use domain n id h sum before left bucket prefix clean score predicted key check sig bands many comp rows text_id class_id component_id __text __clean __n __copies host roots held_out".split()


def odd(spark, long=40_000):
    """Documents with nulls everywhere, empty and long texts, repeated rows and ids, and clashing columns."""
    words = lambda w: " ".join(f"{w}{i}" for i in range(60))
    rows = [(1, words("a"), "en", "src0", 5), (1, words("a"), "en", "src0", 5), (1, words("b"), None, None, None), (2, None, "de", "src1", 0), (3, "", None, "src1", 0), (None, words("c"), "en", None, 1), (None, None, None, None, None), (4, "word " * long, "fr", "src2", 5 * long), (5, "password = abcdef123456", "en", "src4", 23)]
    names = ", ".join(f"`{c}` double" for c in CLASHES)
    return spark.createDataFrame([(*r, *[7.0] * len(CLASHES)) for r in rows], f"doc_id long, text string, lang string, source string, n_chars int, {names}")


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows_and_clashing_columns(spark, stage):
    f, d = dict(corpus_pipeline.STAGES)[stage], odd(spark)
    rows = f(spark, d, SF).collect()
    if stage == "packing":
        assert {r["doc_id"] for r in rows} == {None, 1, 2, 3, 4, 5} and sum(r["start"] == 0 for r in rows) == 9
    else:
        assert rows[0].__fields__ == d.columns and all(r[c] == 7.0 for r in rows for c in CLASHES)
        want = {"toxicity": 9, "minhash": 8, "secrets": 9}
        assert stage not in want or len(rows) == want[stage]
        assert stage != "secrets" or [r["text"] for r in rows if r["doc_id"] == 5] == ["[secret]"]
    assert f(spark, d.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", ["op1_tokens", "op2_toxicity", "op5_mixing", "op6_packing", "op7_secrets", "op8_minhash", "op10_ogg", "op11_resampling", "op13_quality"])
def test_queries_on_odd_tables(spark, tmp_path, name):
    """Each query over documents with odd rows and clashing columns, and over none, beside the other tables."""
    for folder, d in ((tmp_path / "odd", odd(spark)), (tmp_path / "none", odd(spark).limit(0))):
        d.write.parquet(f"{folder}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
        rows = QUERIES[name](spark, str(folder)).collect()
        ids = sorted(str(r["doc_id"]) for r in rows)
        if folder.name == "none":
            assert rows == []
        elif name in ("op5_mixing", "op6_packing"):
            assert set(ids) <= {"1", "2", "3", "4", "5", "None"} and rows
        else:
            assert ids == ["1", "1", "1", "2", "3", "4", "5", "None", "None"]


def test_equal_rows_but_for_other_columns_stay_alike_in_any_layout(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, lang, "s", n) for lang in ("en", "de", None) for n in (3, 1, None)], "doc_id long, text string, lang string, source string, n_chars long")
    found = {tuple(corpus_pipeline.drop_near_duplicates(spark, docs.orderBy(F_hash(k)).repartition(1 + k), SF).collect()) for k in range(4)}
    assert len(found) == 1 and len(found.pop()) == 1


def F_hash(seed):
    from pyspark.sql import functions as F

    return F.xxhash64(F.col("lang"), F.col("n_chars"), F.lit(seed))


def test_the_whole_pipeline_against_plain_steps(spark, tmp_path):
    """A small corpus, from documents to packed pieces: every stage's decisions by plain Python and by the twin in SQL."""
    draw = random.Random(11)
    plain = ["the", "river", "runs", "over", "stones", "and", "under", "bridges", "while", "birds", "sing", "songs", "about", "summer", "wind"]
    rows, bad = [], []
    for i in range(700):
        words = [draw.choice(plain) + (str(draw.randint(0, 300)) if draw.random() < 0.7 else "") for _ in range(draw.randint(3, 70))]
        bad.append(i % 5 == 0)
        if bad[i]:
            words.insert(draw.randrange(len(words)), draw.choice(["idiot", "idiot", "scumbag", "scumbag", "1d1ot", "i d i o t"]))
        if i % 11 == 0:
            words.append("password = abcdef123456")
        text = " ".join(words)
        if i % 7 == 3 and rows:
            text = rows[-1][1] + " end" if i % 2 else rows[-1][1]
            bad[i] = bad[i - 1]
        rows.append((i, text, draw.choice(["en", "de", None]), f"src{i % 4}", len(text)))
    rows += [(700, None, "en", "src0", None), (701, "", "en", "src1", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(x)) for i, x in enumerate(bad)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    # toxicity: every text by the model alone
    model = toxicity.fit(read("documents"), read("labels"))
    left = [r for r in rows if model.score(r[1]) < 0.5]
    assert {r[0] for r in rows} - {r[0] for r in left} and not any("idiot" in (r[1] or "") for r in left)
    # near duplicates: all pairs of shingle sets
    found = brute({r[0]: r[1] for r in left})
    left = [r for r in left if found[r[0]][1] == r[0]]
    # secrets: the contract's base patterns leave nothing
    left = [(*r[:1], secrets.redact(r[1]), *r[2:]) for r in left]
    assert not any(re.search("password = [a-z0-9]{6}", r[1] or "") for r in left)
    # mixing: the twin over what is left
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [r[:4] for r in left])
    rel = db.execute(ORACLES["op5_mixing"])
    at = {c[0]: k for k, c in enumerate(rel.description)}
    copies = {r[at["doc_id"]]: r[at["copies"]] for r in rel.fetchall()}
    # packing: each use of a document in pieces that hold its ids once, in windows of at most 1024
    want = Counter()
    for doc_id, text, *_ in left:
        if doc_id in copies:
            ids = ids_of(text, "byte_bpe_50k.json", 0)
            want[doc_id, len(ids), crc(ids) if len(ids) <= 1024 else None] += copies[doc_id]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = Counter((r["doc_id"], r["doc_tokens"], r["ids_crc32"] if r["length"] == r["doc_tokens"] else None) for r in pieces if r["start"] == 0)
    assert sum(want.values()) > 50 and {(i, n) for i, n, _ in want} == {(i, n) for i, n, _ in got}
    assert _by(want) == _by(got)
    whole = Counter({k: v for k, v in got.items() if k[2] is not None})
    assert all(want[k] >= v for k, v in whole.items())
    filled = Counter()
    for r in pieces:
        filled[r["sequence_id"]] += r["length"]
    assert sum(filled.values()) == sum(n * k for (_, n, _), k in want.items()) and max(filled.values()) <= 1024


def _by(counts):
    out: dict = {}
    for (doc_id, n, _), k in counts.items():
        out[doc_id, n] = out.get((doc_id, n), 0) + k
    return out
