"""Operator 11: importance resampling of documents towards a target's distribution.

Texts become hashed runs of words, and each bucket's gain is how much likelier the target has it than
the documents. All of it runs on Arrow kernels: lower case, a split at what is no word, one flat list of
words and its dictionary; runs of several words are pairs of dictionary indices, shifted against each
other, so only distinct words and distinct pairs are ever hashed (a run's CRC goes on from that of its
beginning). A document's weight is a take of the gains, summed by segments. The highest of weight plus
Gumbel noise are a draw without replacement.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actionline.llm.common import id_text, table, written

#: What stands between words: all of ASCII but letters and digits.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that go through the kernels at once; a longer text goes alone.
SLICE_BYTES = 2_000_000


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of consecutive slices, each of at most SLICE_BYTES or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The row of each word of the texts, and the words, lower-cased in A-Z, as a dictionary. Null: no words."""
    parts = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=GAPS)
    flat = pc.list_flatten(parts)
    some = pc.not_equal(flat, "")
    return pc.list_parent_indices(parts).filter(some).to_numpy(), pc.dictionary_encode(flat.filter(some))


def as_bytes(strings: pa.StringArray) -> list[bytes]:
    """The UTF-8 of each string, cut from the array's one buffer."""
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1].tolist() if len(strings) else [0]
    data = data.to_pybytes() if data else b""
    return [data[a:b] for a, b in itertools.pairwise(ends)]


def runs(rows: np.ndarray, coded: pa.DictionaryArray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... ``most`` words: the row and the CRC-32 of each, in order; none leaves its row."""
    index, distinct = coded.indices.to_numpy().astype(np.int64), as_bytes(coded.dictionary)
    run, crc = index, np.array([zlib.crc32(w) for w in distinct], np.int64)
    yield rows, crc[run]
    for n in range(2, most + 1):
        # a run is a pair: the run of one word less, and the word n - 1 places further on
        pairs = pc.dictionary_encode(pa.array(run[:-1] * max(1, len(distinct)) + index[n - 1 :]))
        head, word = np.divmod(pairs.dictionary.to_numpy(), max(1, len(distinct)))
        crc = np.array([zlib.crc32(b" " + distinct[w], h) for w, h in zip(word.tolist(), crc[head].tolist(), strict=True)], np.int64)
        run = pairs.indices.to_numpy().astype(np.int64)
        inside = rows[: len(run)] == rows[n - 1 :]
        yield rows[: len(run)][inside], crc[run[inside]]


def segment_sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sum of the values of each of n rows; rows come in order."""
    out = np.zeros(n, np.int64)
    if len(rows):
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        out[rows[first]] = np.add.reduceat(values, first)
    return out


def bucket_counts(texts: DataFrame, most: int, buckets: int) -> np.ndarray:
    """How many features of the texts fall into each bucket. Each task sends at most ``buckets`` sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, part in slices(b.column(0)):
                for _, crc in runs(*words(part), most):
                    total += np.bincount(crc % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    n, s, t = len(docs), float(docs.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(docs.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, most: int) -> DataFrame:
    """doc_id, n_features, n_words and weight of each row: the summed gains of its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = pa.array(gain)
        for b in batches:
            for at, part in slices(b.column(1)):
                n = len(part)
                count, weight, n_words = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
                for k, (rows, crc) in enumerate(runs(*words(part), most)):
                    found = np.bincount(rows, minlength=n)
                    n_words = n_words if k else found
                    count += found
                    weight += segment_sums(rows, value.take(pa.array(crc % len(gain))).to_numpy(), n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array(count), pa.array(n_words), pa.array(weight)], ["doc_id", "n_features", "n_words", "weight"])

    return docs.mapInArrow(run, "doc_id long, n_features long, n_words long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate, rounded down: the same for a doc_id wherever and whenever it is drawn."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, percent: int) -> DataFrame:
    """scored with a rank, 1 for the highest score among the rows with ``may``, null for those not drawn.

    Rows are dealt by ranges of (score, doc_id) and numbered in their range; of each range only its count
    goes through one task, and those are as many as spark.sql.shuffle.partitions.
    """
    spark = scored.sparkSession
    order = [F.when(F.col("may"), F.col("score")).desc_nulls_last(), F.col("doc_id").asc(), F.col("n_features").asc(), F.col("weight").asc()]
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbered = written(scored.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranks")
    per = numbered.where("may").groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100).alias("most"))
    rank = F.when(F.col("may"), F.col("before") + F.col("at").bitwiseAND(F.lit(2**33 - 1)) + 1)
    out = numbered.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(per), "part", "left")
    return out.withColumn("rank", F.when(rank <= F.col("most"), rank)).drop("part", "before", "most", "at")


def resampled(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of docs, drawn towards the texts of target.

    most: how many words a feature has at most. percent of the documents with least_words words or more
    are drawn; what falls short of a whole document is not. Null and empty texts have no features and weight
    0. A null doc_id has no noise, so score and rank are null and it is not counted. Repeated rows are each
    drawn by themselves, ties go to the smaller doc_id. An empty target gives all buckets its smoothing alone;
    an empty table of documents gives an empty result. Other columns, whatever their names, are ignored. A very
    long text is taken whole; it needs some six times its size in a task.
    """
    docs = id_text(docs)
    gain = gains(bucket_counts(docs, most, buckets), bucket_counts(target, most, buckets))
    out = weighted(docs, gain, most).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(out.withColumn("may", (F.col("n_words") >= least_words) & F.col("score").isNotNull()), percent).select("doc_id", "n_features", "weight", "score", "rank")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents, drawn towards benchmark by single words. Null and empty texts: no features,
    weight 0, not drawn. Null doc_id: no score. Ties and repeated rows: smaller doc_id first, each drawn by itself.
    Very long texts: whole. Other columns, clashing names among them, are ignored. Empty documents: empty result;
    empty benchmark: smoothing alone."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 from its rule: a table of 256 remainders, then a fold over the bytes of each distinct word.
OP11_SQL = """
WITH remainders AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t
), doc_words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents
), target_words AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark
), bytes AS (
  SELECT w, list_transform(range(strlen(w)), lambda i: CAST('0x' || substr(hex(w), 2 * i + 1, 2) AS BIGINT)) AS b
  FROM (SELECT w FROM doc_words UNION SELECT w FROM target_words)
), hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) % 10000 AS bucket FROM bytes, remainders
), s AS (SELECT bucket, count(*) AS s FROM doc_words JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM target_words JOIN hashed USING (w) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM doc_words) AS s_all, (SELECT count(*) FROM target_words) AS t_all),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), sums
), weights AS (
  SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM doc_words JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weights USING (doc_id)
), drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM scored s LEFT JOIN drawn USING (doc_id)
"""
