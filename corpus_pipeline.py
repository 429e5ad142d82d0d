"""The corpus pipeline over documents: STAGES in order, each on all rows that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actionline.llm import minhash, mixing, packing, secrets, toxicity
from actionline.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; all others stay as they are, with all columns, whatever their names.
    Null and empty texts stay; null doc_id, repeated rows and ties are judged row by row; an empty table stays empty."""
    return docs.where(toxicity.score_of(toxicity.fit(docs, table(spark, sf_dir, "labels"))) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays, with null ids all.

    Rows that repeat a doc_id are told apart by their texts: of near-duplicates among them one row stays,
    the one whose text has the least hash, and of rows with one text the first by their other columns as JSON;
    rows with unrelated texts are judged and kept each by itself.
    Null and empty texts are like nothing, so they stay, once for each doc_id. All columns stay, whatever their
    names; an empty table stays empty.
    """
    kept = minhash.near_duplicates(docs, texts=True).where("kept").groupBy("doc_id", "class_id").agg(F.min("text_id").alias("text_id"))
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]))
    named = docs.where("doc_id is not null").select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_id"), rest.alias("rest"))
    out = named.join(kept.select("doc_id", "text_id"), ["doc_id", "text_id"], "left_semi").groupBy("doc_id", "text_id").agg(F.min_by("row", "rest").alias("row"))
    return out.select("row.*").union(docs.where("doc_id is null"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark; no document goes. Null and empty texts stay as they are, as do null
    doc_id, repeated rows and all other columns but n_chars; an empty table stays empty."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights take, a row for each use, with all columns, whatever their names. Null
    lang, source and doc_id count as empty strings; null and empty texts have no words and go with the prefix of
    their leaf; rows of equal doc_id stand or fall together; an empty table stays empty."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens; a small cache, as workers have served other
    stages. Null and empty texts: the end id alone; null doc_id and repeated rows: each packed by itself; other
    columns are ignored; an empty table gives an empty result."""
    return packing.packed(docs, cache=150_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No twin in SQL: restoring disguised words, sketches and tokenizers are beyond it. Tests hold its stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder but the last."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
