"""Operator 1: token ids in a binary table, with one zstandard dictionary for all documents.

The file format, written by Spark into the shared folder as Parquet:

- ``blocks``: shard, block, payload (each document's ids, compressed by itself, in a row), and the index
  doc_ids, offsets, n_tokens, local_start (ids of the shard before the document), dictionary_hash;
- ``dictionary``: hash and bytes.

A document is read from one block by its offset; only its own frame is decompressed.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actionline.llm.common import encoder, id_text, shared_dir, table, tokenizer_path

BLOCK_BYTES, DICTIONARY_BYTES = 1 << 20, 64 << 10
INDEX = "doc_ids array<long>, offsets array<long>, n_tokens array<long>, local_start array<long>"


def train(docs: DataFrame, path: str, width: int, sample: int) -> bytes:
    """A dictionary from the serialized ids of at most ``sample`` documents, those with the least hashes.

    Training needs eight samples, so fewer are repeated. Only where the library finds nothing to train on,
    as in a table without texts, the samples themselves are the dictionary."""
    import zstandard

    ids = docs.where("text <> ''").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "text").limit(2 * sample).collect()
    rows = [(r["text"],) for r in sorted(rows)]
    encode = encoder(path, keep_space=False, width=width)
    parts = [encode(r[0]) for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts * -(-8 // max(1, len(parts)))).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[:DICTIONARY_BYTES] or b"\0" * 8


def write_tokens(docs: DataFrame, end_id: int = 2, tokenizer: str | None = None, sample: int = 1000) -> str:
    """Writes the tables named above; returns their folder. Documents lie in ascending order of doc_id.

    width: ids take two bytes before compression, as the vocabulary has under 65,536 entries. The sample
    bounds only what the dictionary is trained on; every document is written whole.
    """
    import zstandard
    from tokenizers import Tokenizer

    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    width = 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4
    docs, spark = id_text(docs), docs.sparkSession
    folder = f"{shared_dir(spark)}/actionline-tokens-{uuid.uuid4().hex}"
    made = train(docs, path, width, sample)
    name = hashlib.sha256(made).hexdigest()
    spark.createDataFrame([(name, bytearray(made), width)], "hash string, dictionary binary, width int").coalesce(1).write.parquet(f"{folder}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path, keep_space=False, width=width), int(end_id).to_bytes(width, "little")
        compress = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(made), write_content_size=True).compress
        shard, block, local, size = TaskContext.get().partitionId(), 0, 0, 0
        frames, ids, offsets, counts, starts = [], [], [], [], []

        def close() -> pa.RecordBatch:
            nonlocal block, size
            row = [[shard], [block], [b"".join(frames)], [ids[:]], [offsets[:]], [counts[:]], [starts[:]], [name]]
            block, size = block + 1, 0
            for x in (frames, ids, offsets, counts, starts):
                x.clear()
            kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 4, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["shard", "block", "payload", "doc_ids", "offsets", "n_tokens", "local_start", "dictionary_hash"])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = encode(text.as_py()) + end
                frames.append(compress(raw))
                ids.append(i)
                offsets.append(size)
                counts.append(len(raw) // width)
                starts.append(local)
                size += len(frames[-1])
                local += len(raw) // width
                if size >= BLOCK_BYTES:
                    yield close()
        if frames:
            yield close()

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, f"shard long, block long, payload binary, {INDEX}, dictionary_hash string").write.parquet(f"{folder}/blocks")
    return folder


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, block, offset of every document, from the written files.

    start: the ids of all documents before it. Only one sum for each shard goes through one task.
    """
    import zstandard

    made = spark.read.parquet(f"{folder}/dictionary").first()
    name, content, width = made["hash"], bytes(made["dictionary"]), made["width"]
    blocks = spark.read.parquet(f"{folder}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content)).decompress
        for b in batches:
            for row in b.to_pylist():
                if row["dictionary_hash"] != name:
                    raise ValueError(f"block {row['shard']}.{row['block']} needs dictionary {row['dictionary_hash']}")
                payload, ends = memoryview(row["payload"]), [*row["offsets"][1:], len(row["payload"])]
                crcs = []
                for at, to, count in zip(row["offsets"], ends, row["n_tokens"], strict=True):
                    raw = decompress(payload[at:to])
                    if len(raw) != count * width:
                        raise ValueError("a frame doesn't hold as many ids as its index says")
                    crcs.append(zlib.crc32(raw if width == 4 else widened(raw)))
                n = len(crcs)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (row["doc_ids"], [row["shard"]] * n, row["local_start"], row["n_tokens"], crcs, [row["block"]] * n, row["offsets"])], ["doc_id", "shard", "local_start", "n_tokens", "ids_crc32", "block", "offset"])

    # the ids of each shard: of its last document, what is before it and its own
    last = F.element_at("local_start", -1) + F.element_at("n_tokens", -1)
    shards = blocks.select("shard", last.alias("ids")).groupBy("shard").agg(F.max("ids").alias("ids"))
    before = shards.select("shard", F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    docs = blocks.mapInArrow(run, "doc_id long, shard long, local_start long, n_tokens long, ids_crc32 long, block long, offset long")
    return docs.join(before, "shard").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "shard", "block", "offset")


def widened(raw: bytes) -> bytes:
    """Two-byte ids as four-byte ids, little-endian."""
    import numpy as np

    return np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[list[int]]:
    """The ids of the document, or of each with that doc_id, reading only its blocks and its own frame."""
    import numpy as np
    import zstandard

    made = spark.read.parquet(f"{folder}/dictionary").first()
    decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(made["dictionary"]))).decompress
    out = []
    for row in spark.read.parquet(f"{folder}/blocks").where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).orderBy("shard", "block").collect():
        ends = [*row["offsets"][1:], len(row["payload"])]
        out += [np.frombuffer(decompress(bytes(row["payload"][a:b])), f"<u{made['width']}").tolist() for i, a, b in zip(row["doc_ids"], row["offsets"], ends, strict=True) if i == doc_id]
    return out


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes documents and reads them back. Null text: empty, so the end id alone. Null doc_id: first in
    order. Repeated rows and ties: each row its own document, ordered by text. Very long texts: encoded whole, a frame
    each. Other columns, clashing names among them, are ignored. Empty table: empty result."""
    return read_tokens(spark, write_tokens(table(spark, sf_dir, "documents")))
