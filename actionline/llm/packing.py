"""Operator 6: packing token sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from actionline.llm.common import encoder, id_text, table, tokenizer_path

CAPACITY = 1024
#: What a document leaves over its full windows is cut into pieces of this many tokens at most.
PIECE = 256
#: A batch of pieces is packed as soon as it would fill so many windows.
WINDOWS = 64


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """The indices of sizes in k near-equal parts.

    A partial partition is k parts with their sums. The two with the largest spread are merged, the
    largest part of one with the smallest of the other, until one partition is left. A piece by itself
    is a partition with k - 1 empty parts. As long as pieces have the largest spreads, merging them fills
    the empty parts of one partition, one by one; so up to k of them become a partition at once. A merge
    keeps only the order it gave the parts; which piece lies where is read off those from the last back.
    """
    n = len(sizes)
    if not n:
        return []
    by = sorted(range(n), key=lambda i: -sizes[i])
    heap: list[tuple[int, int]] = []  # (minus the spread, number of the partition)
    sums: list[np.ndarray | None] = []  # ascending
    made: list[tuple] = []  # pieces, smallest part first; or the two that were merged and the order of their parts

    def add(values: np.ndarray, how: tuple) -> None:
        heapq.heappush(heap, (int(values[0] - values[-1]), len(made)))
        sums.append(values)
        made.append(how)

    def pieces(at: int, most: int, least: int) -> int:
        """A partition of the pieces from at on that are of least tokens or more; returns where they end."""
        end = at + 1
        while end < n and end < at + most and sizes[by[end]] >= least:
            end += 1
        values = np.zeros(k, np.int64)
        values[k - (end - at) :] = [sizes[i] for i in reversed(by[at:end])]
        add(values, (by[at:end],))
        return end

    at = 0
    while at < n or len(heap) > 1:
        top = -heap[0][0] if heap else -1
        if at < n and sizes[by[at]] >= top:
            at = pieces(at, k, top)
            continue
        _, x = heapq.heappop(heap)
        if at < n and (not heap or sizes[by[at]] >= -heap[0][0]):
            at = pieces(at, 1, 0)
        _, y = heapq.heappop(heap)
        both = sums[x] + sums[y][::-1]
        order = np.argsort(both, kind="stable")
        sums[x] = sums[y] = None
        add(both[order], (x, y, order))
    place: list[np.ndarray | None] = [None] * len(made)
    place[-1] = np.arange(k)
    parts: list[list[int]] = [[] for _ in range(k)]
    for number in range(len(made) - 1, -1, -1):
        here, how = place[number], made[number]
        place[number] = None
        if len(how) == 1:
            for i, part in zip(how[0], here[::-1].tolist(), strict=False):
                parts[part].append(i)
            continue
        x, y, order = how
        place[x], place[y] = np.empty(k, np.int64), np.empty(k, np.int64)
        place[x][order] = here
        place[y][k - 1 - order] = here
    return [sorted(p) for p in parts]


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Parts that all fit the capacity: the count of windows starts at the least and rises until they do,
    by as many as what lies beyond the capacity would fill."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, k)
        beyond = sum(max(0, sum(sizes[i] for i in p) - capacity) for p in parts)
        if not beyond:
            return [p for p in parts if p]
        k += -(-beyond // capacity)


def packed(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, cache: int = 700_000) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids with end_id make as many full windows of 1024 as they can; the rest is cut into
    pieces of 256 at most and packed with those of other documents of the same partition, 64 windows at
    a time. Null text: empty, so one piece with end_id. Null doc_id: packed like others. Repeated rows:
    each packed by itself, as pieces with equal doc_id. Empty table: empty result. sequence_id is the
    partition's number times 2**36 plus a count, so a task that runs again gives the same. No shuffle;
    a task holds one batch of texts, the pieces of 64 windows and the
    encoder's cache of ``cache`` chunks and twice as many words.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path, keep_space=True, limit=cache), int(end_id).to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 36
        waiting: list[tuple] = []
        tokens = 0

        def close(rows: list[tuple]) -> None:
            nonlocal sequence, waiting, tokens
            for part in pack([x[2] for x in waiting]):
                at = 0
                for i in part:
                    rows.append((*waiting[i], sequence, at))
                    at += waiting[i][2]
                sequence += 1
            waiting, tokens = [], 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], names)

        for b in batches:
            rows: list[tuple] = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py()) + end
                n = len(ids) // 4
                for start in range(0, n - n % CAPACITY, CAPACITY):
                    rows.append((i, start, CAPACITY, zlib.crc32(ids[4 * start : 4 * (start + CAPACITY)]), n, sequence, 0))
                    sequence += 1
                for start in range(n - n % CAPACITY, n, PIECE):
                    part = ids[4 * start : 4 * min(n, start + PIECE)]
                    waiting.append((i, start, len(part) // 4, zlib.crc32(part), n))
                    tokens += len(part) // 4
                    if tokens >= WINDOWS * (CAPACITY - 2):
                        close(rows)
            yield out(rows)
        rows = []
        close(rows)
        yield out(rows)

    return id_text(docs).mapInArrow(run, ", ".join(f"{x} long" for x in names))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents. Null and empty texts: one piece, the end id alone. Null and repeated doc_id: each
    row packed by itself, under its own id. Very long texts: as many full windows as they fill, and a rest.
    Other columns, clashing names among them, are ignored. Empty table: empty result."""
    return packed(table(spark, sf_dir, "documents"))
