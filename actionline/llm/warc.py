"""Operator 9: WARC archives, written by Spark and read back by verified chains of record boundaries.

The archives are text files whose rows are records and whose row separator is the two line ends that
close a WARC record, so Spark's own writer makes valid archives on any file system it can write to.

Reading splits at every place where the magic line stands, payloads included. A candidate's header says
where its record ends, so each candidate names a successor; pointer jumping from the first byte of each
file marks those that the chain reaches, and all others are payload.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actionline.llm.common import shared_dir, table, written
from actionline.operators.membership import may_be_in

MAGIC, LINE, CLOSE = "WARC/1.1\r\n", "\r\n", "\r\n\r\n"
LEAST = 1000


def marked(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html with length, digest, and the page that a revisit refers to (null: a response)."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # only digests that occur more than once go into the join
    copies = p.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")
    copies = written(copies, "copies")  # so that a hot digest's pages can go to several tasks
    # which pages are revisits is found on ids and digests alone; pages then meet that by both, so a page that is
    # copied very often is no hot key. Copies and revisits grow with the pages, so they are never broadcast.
    revisits = p.where(F.col("bytes") >= least).select("page_id", "digest").distinct().join(copies.hint("merge"), "digest").where(~F.col("page_id").eqNullSafe(F.col("last")))
    key = F.coalesce("page_id", F.lit(-1))
    revisits = revisits.select(key.alias("key"), F.col("page_id").isNull().alias("none"), "digest", F.col("last").alias("refers"))
    p = p.withColumn("key", key).withColumn("none", F.col("page_id").isNull())
    return p.join(revisits.hint("merge"), ["key", "none", "digest"], "left").drop("key", "none")


def write_warc(pages: DataFrame, compression: str = "gzip") -> str:
    """One record for each row, in as many archives as the rows have partitions; returns their folder.

    The identifier is urn:page:<page_id>. A revisit has no payload but its header names the response.
    compression: Spark's name of a codec for whole archives, or none, which lets tasks read parts of one.
    """
    p = marked(pages)
    revisit = F.col("refers").isNotNull()
    header = F.concat(
        F.lit(MAGIC),
        F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(LINE),
        F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">" + LINE),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z" + LINE),
        F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " "), F.lit(LINE),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(LINE),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers").cast("string"), F.lit(">" + LINE))).otherwise(""),
        F.lit("Content-Type: text/html; charset=utf-8" + LINE),
        F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string"), F.lit(CLOSE),
    )
    folder = f"{shared_dir(pages.sparkSession)}/actionline-warc-{uuid.uuid4().hex}"
    p.select(F.concat(header, F.when(revisit, "").otherwise(F.col("html"))).alias("value")).write.option("lineSep", CLOSE).option("compression", compression).text(folder)
    return folder


def _header(piece: bytes) -> tuple[dict[bytes, bytes], int] | None:
    """The fields after a magic line and the bytes up to the payload; None where no header stands there."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in piece[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    if not fields.get(b"content-length", b"").isdigit() or b"warc-type" not in fields:
        return None
    return fields, end + 4


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    """What lies between two magic lines, with its absolute offset: file, start (of the magic), piece."""
    rows = spark.read.option("lineSep", MAGIC).text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("piece"))
    n = len(MAGIC)
    sums = rows.groupBy("file", "split").agg(F.sum(F.octet_length("piece") + n).alias("size"))
    before = sums.select("file", "split", F.coalesce(F.sum("size").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, here = 0, None
        for b in batches:
            starts = []
            for file, split, piece in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                at, here = (at if here == (file, split) else 0), (file, split)
                starts.append(at - n)  # the magic line ends where the piece begins
                at += len(piece) + n
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(starts, pa.int64()), b.column(2)], ["file", "split", "local", "piece"])

    before = F.broadcast(written(before, "splits"))  # one row for each split of a file, not of a record
    local = rows.mapInArrow(run, "file string, split long, local long, piece binary")
    return local.join(before, ["file", "split"]).select("file", (F.col("before") + F.col("local")).alias("start"), "piece").where("start >= 0")


def reachable(candidates: DataFrame) -> DataFrame:
    """The candidates (file, start, next) that the chain from start 0 of each file reaches.

    Pointer jumping: with each round the marked set follows pointers that reach twice as far, so rounds
    grow as the logarithm of the records in a file. Each round is written to the shared folder, the one before it goes.
    """
    jump = written(candidates.select("file", "start", "next", (F.col("start") == 0).alias("on")), "chain")
    while True:
        there = jump.select("file", F.col("start").alias("next"), F.col("next").alias("far"))
        told = jump.where("on").select("file", F.col("next").alias("start"), F.lit(True).alias("told")).distinct()
        after = jump.join(there, ["file", "next"], "left").join(told, ["file", "start"], "left")
        # a pointer past the last candidate stays where it is, beyond all starts
        after = written(after.select("file", "start", F.coalesce("far", F.col("next")).alias("next"), (F.col("on") | F.coalesce("told", F.lit(False))).alias("on"), (F.col("far").isNotNull()).alias("moved")), "chain", instead=jump)
        more = after.where("moved").limit(1).count()
        jump = after.drop("moved")
        if not more:
            return candidates.join(jump.where("on").select("file", "start"), ["file", "start"], "left_semi")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """file, start, page_id, record_type, refers_to, digest (of the header), payload of each record."""
    pieces = _pieces(spark, folder)

    def successors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = []
            for start, piece in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                found = _header(piece.as_py())
                ends.append(start + len(MAGIC) + found[1] + int(found[0][b"content-length"]) + len(CLOSE) if found else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ends, pa.int64())], ["file", "start", "next"])

    marks = written(pieces.mapInArrow(successors, "file string, start long, next long"), "candidates")
    real = written(reachable(marks.where("next is not null")), "records")
    # pieces that begin with a magic line inside of a payload, and the record that each belongs to
    false = written(marks.join(real, ["file", "start"], "left_anti").select("file", "start"), "false")
    owner = false.withColumn("kind", F.lit(1)).union(real.join(false.select("file").distinct(), "file", "left_semi").select("file", "start", F.lit(0)))
    w = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    inside = owner.withColumn("record", F.last(F.when(F.col("kind") == 0, F.col("start")), True).over(w)).where("kind = 1 and record is not null")
    inside = written(inside.select("file", "start", "record"), "inside")
    cut = inside.select("file", F.col("record").alias("start")).distinct()
    # records of one piece are read where they are; only those of several pieces meet by their record. A filter of
    # fixed size tells the pieces that surely are no part of such, so those are never shuffled, whatever the sizes
    mark = F.concat_ws(":", "file", "start")
    hit = may_be_in(false.union(cut).select(mark.alias("mark")), "mark", mark)
    maybe = written(pieces.where(hit), "maybe")
    alone = maybe.join(false, ["file", "start"], "left_anti").join(cut, ["file", "start"], "left_anti")
    single = pieces.where(~hit).unionByName(alone).select("file", "start", "piece", F.lit(None).cast("array<binary>").alias("rest"))
    rest = maybe.join(inside, ["file", "start"]).groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("start", "piece"))).alias("rest"))
    rest = rest.select("file", F.col("record").alias("start"), F.transform("rest", lambda x: x["piece"]).alias("rest"))
    whole = single.union(maybe.join(rest, ["file", "start"]).select("file", "start", "piece", "rest"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for piece, rest in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                piece = MAGIC.encode().join([piece, *(rest or [])])
                fields, at = _header(piece)
                number = lambda name: int(x) if (x := fields.get(name, b"").removeprefix(b"<urn:page:").removesuffix(b">")) else None  # noqa: B023, E731
                length = int(fields[b"content-length"])
                payload = piece[at : at + length]
                if len(payload) != length:
                    raise ValueError("a record is shorter than its header says")
                out.append((number(b"warc-record-id"), fields[b"warc-type"].decode(), number(b"warc-refers-to"), fields[b"warc-payload-digest"].decode().removeprefix("sha1:"), length, hashlib.sha1(payload).hexdigest(), payload))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True))], ["file", "start", "page_id", "record_type", "refers_to", "digest", "bytes", "found", "payload"])

    return whole.mapInArrow(parse, "file string, start long, page_id long, record_type string, refers_to long, digest string, bytes long, found string, payload binary")


def archived(pages: DataFrame, compression: str = "gzip") -> DataFrame:
    """One row for each page: page_id, payload_bytes, payload_digest, record_type, refers_to, as read back.

    Null html: an empty payload. Empty and short payloads are always responses. Repeated rows: each has
    its record; rows with the largest page_id of equal payloads are all responses. Null page_id: counts
    below every other, and null in the result; copies among such rows alone are responses. Empty table:
    empty result. A payload that holds the magic line, or whole records, is still one payload. A task
    holds some payloads; those of a record cut by false magic lines meet again by their record only.
    """
    records = written(read_warc(pages.sparkSession, write_warc(pages, compression)).drop("payload"), "read")
    bad = records.where("record_type = 'response' and digest <> found")
    sizes = records.where("record_type = 'response'").groupBy("page_id", "digest").agg(F.max("bytes").alias("full"))
    sizes = sizes.join(records.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "digest").distinct(), ["page_id", "digest"], "left_semi")
    if bad.limit(1).count():
        raise ValueError("a payload read back has another digest than its header")
    r, s = records.alias("r"), sizes.alias("s")
    out = r.join(s, (F.col("r.refers_to") == F.col("s.page_id")) & (F.col("r.digest") == F.col("s.digest")), "left")
    lost = F.raise_error(F.lit("a revisit refers to a response that the archives don't hold")).cast("long")
    full = F.when(F.col("r.record_type") == "revisit", F.coalesce(F.col("s.full"), lost)).otherwise(F.col("r.bytes"))
    return out.select("r.page_id", full.alias("payload_bytes"), F.col("r.digest").alias("payload_digest"), "r.record_type", "r.refers_to")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of pages, as read back from the archives. Null and empty html: an empty payload, always a
    response. Null page_id: a record without number, below every other. Very long html: one record, held by one
    task. Ties: rows with the largest page_id of equal payloads are all responses; repeated rows each have their
    record. Other columns, clashing names among them, are ignored. Empty table: empty result."""
    return archived(table(spark, sf_dir, "pages"))


#: The rows of op9_warc in SQL.
OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
c AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM p LEFT JOIN c ON p.d = c.d
"""
