"""Operator 3: near-duplicate vectors by lattice hashing.

A random rotation cuts unit vectors into tables of eight coordinates. Two vectors whose cosine reaches
the threshold are, in at least one table, no further apart than the whole distance over the square root
of the count of tables; their midpoint there is within half of that of both. So a vector is filed under
every E8 cell within that half distance of its point (its own cell and neighbouring ones), and each link
meets in the cell of its midpoint: no link is lost, whatever the data. Within a cell, pairs are compared
in blocks; of the cells and tables where a pair meets, one counts it, so counts need no list of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actionline.llm.common import table, written
from actionline.llm.graph import components

#: Rotated coordinates are kept as whole numbers of this part of 1, so all tasks compute alike.
GRID = 32767
#: Rows of a cell that a task compares with so many others.
BLOCK = 2000


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row: of the even-sum whole points, or of those plus a half."""

    def even(v: np.ndarray) -> np.ndarray:
        r = np.rint(v)
        off = v - r
        odd = np.flatnonzero(r.sum(1) % 2 != 0)
        worst = np.abs(off[odd]).argmax(1)
        r[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
        return r

    a, b = even(x), even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


#: How far, in units of the lattice, a vector is filed; where links reach further, the unit is made larger.
REACH = 0.44


@lru_cache
def neighbours() -> np.ndarray:
    """The 2400 vectors of E8 with squared length 2 or 4: all cells that a ball of REACH can touch.

    A cell's points are within 1 of its centre. So the cells of 0 and of a vector v of squared length 6 or
    more are at least |v| - 2, that is 0.449, apart."""
    out: list[list[float]] = []

    def grow(head: list[float], values: tuple, left: float) -> None:
        if len(head) == 8:
            if sum(head) % 2 == 0 and any(head):
                out.append(head)
            return
        for v in values:
            if v * v <= left + 1e-9:
                grow([*head, v], values, left - v * v)

    grow([], (0, 1, -1, 2, -2), 4)
    grow([], (0.5, -0.5, 1.5, -1.5), 4)
    return np.array(out, float)


_MIX = np.array([3**k * 2654435761 % 2**61 | 1 for k in range(1, 9)], np.int64)


def cell_key(points: np.ndarray) -> np.ndarray:
    """A hash of each lattice point. Two cells with one hash share a bucket; nothing is lost by it."""
    with np.errstate(over="ignore"):
        return (np.rint(points * 2).astype(np.int64) * _MIX).sum(1)


def cells(x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell key) of every cell within ``reach`` of each row, in units of the lattice."""
    v = neighbours()
    length = np.sqrt((v**2).sum(1))
    home = decode(x)
    rows, keys = [np.arange(len(x))], [cell_key(home)]
    for at in range(0, len(x), 512):
        off = x[at : at + 512] - home[at : at + 512]
        i, j = np.nonzero((length**2 - 2 * off @ v.T) / (2 * length) <= reach + 1e-9)
        rows.append(i + at)
        keys.append(cell_key(home[i + at] + v[j]))
    return np.concatenate(rows), np.concatenate(keys)


@lru_cache
def rotation(d: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(3).standard_normal((d, d)))[0]


def codes(x: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated, padded to a multiple of eight coordinates, on the grid."""
    d = -(-x.shape[1] // 8) * 8
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x / np.sqrt((x**2).sum(1))[:, None]
    return np.rint(y @ rotation(d) * GRID).astype(np.int16)


def _radius(d: int, threshold: float) -> float:
    """The distance on the grid within which each link is in some table."""
    return (math.sqrt(2 - 2 * threshold) * GRID + math.sqrt(d)) / math.sqrt(d // 8)


def _unit(d: int, threshold: float, scale: float) -> float:
    """The lattice's unit for vectors of d coordinates: scale, or as much as keeps half the radius within REACH."""
    return max(scale, _radius(d, threshold) / GRID / 2 / REACH)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that it reaches by the links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def _links(c: np.ndarray, left: slice, right: slice, same: bool, t: int, cell: int, scale: float, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, sure) of the pairs between two row ranges of a cell that this cell has to count."""
    d = c.shape[1]
    scale = _unit(d, threshold, scale)
    limit, unit = _radius(d, threshold) ** 2, float(GRID)
    margin = 2.5 * math.sqrt(d) / GRID
    whole = c.astype(np.float32) / unit
    for at in range(left.start, left.stop, 256):
        near = whole[at : min(at + 256, left.stop)] @ whole[right].T
        i, j = np.nonzero(near >= threshold - margin - 1e-4)
        i, j = i + at, j + right.start
        if same:
            i, j = i[i < j], j[i < j]
        for lo in range(0, len(i), 200_000):
            a, b = i[lo : lo + 200_000], j[lo : lo + 200_000]
            for k in range(t + 1):  # exact on whole numbers, so each task decides alike
                if not len(a):
                    break
                off = c[a, 8 * k : 8 * k + 8].astype(np.int64) - c[b, 8 * k : 8 * k + 8]
                inside = (off * off).sum(1) <= limit
                keep = inside if k == t else ~inside
                a, b = a[keep], b[keep]
            if len(a):
                mid = (c[a, 8 * t : 8 * t + 8].astype(float) + c[b, 8 * t : 8 * t + 8]) / (2 * unit * scale)
                keep = cell_key(decode(mid)) == cell
                a, b = a[keep], b[keep]
            if len(a):
                x, y = c[a].astype(float), c[b].astype(float)
                cos = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
                sure = cos >= threshold + margin
                keep = cos >= threshold - margin
                yield a[keep], b[keep], sure[keep]


def scaled(v: Column) -> Column:
    """v times the power of two that brings its largest component near 1: an exact step that no cosine notices, but
    for vectors whose squares would leave the range of doubles. In two halves, as the power itself may leave it."""
    exponent = F.floor(F.log2(F.array_max(F.transform(v, F.abs))))
    half = F.floor(exponent / 2)
    return F.transform(v, lambda x: x * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - exponent))


def near_vectors(vectors: DataFrame, threshold: float = 0.93, scale: float = 0.35) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept.

    Rows link when their labels are equal and not null and their cosine, in double precision, is at least
    threshold. Vectors that are null, empty or zero or hold null or non-finite components link with
    nothing, nor do vectors of different lengths or rows with a null vec_id (component null, kept false).
    Vectors of any magnitude are compared alike. Repeated rows link with each other; vec_id names all of them.
    Empty table: empty result. scale is the
    lattice's unit: smaller cells mean fewer comparisons and more filed copies, never other results, as it
    is made larger where neighbouring cells would not cover the links' reach.
    """
    wide = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    good = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    wide = wide.withColumn("v", F.when(good & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.col("v")))
    wide = written(wide.withColumn("v", scaled(F.col("v"))).withColumn("key", F.monotonically_increasing_id()), "vectors")

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, labels, vectors = (b.column(k).to_pylist() for k in range(3))
            for d in {len(v) for v in vectors}:
                pick = [k for k, v in enumerate(vectors) if len(v) == d]
                x = np.array([vectors[k] for k in pick], float)
                c = codes(x / np.abs(x).max(1)[:, None])  # first by the largest component: no overflow
                unit = _unit(c.shape[1], threshold, scale)
                for t in range(c.shape[1] // 8):
                    rows, cell = cells(c[:, 8 * t : 8 * t + 8] / (GRID * unit), _radius(c.shape[1], threshold) / GRID / unit / 2)
                    for at in range(0, len(rows), 20_000):
                        r = rows[at : at + 20_000]
                        yield pa.RecordBatch.from_arrays([pa.array([labels[pick[k]] for k in r], pa.string()), pa.array(np.full(len(r), d, np.int32)), pa.array(np.full(len(r), t, np.int32)), pa.array(cell[at : at + 20_000]), pa.array([keys[pick[k]] for k in r], pa.int64()), pa.array([c[k].tobytes() for k in r], pa.binary())], ["label", "d", "t", "cell", "key", "code"])

    filed = written(wide.where("v is not null").select("key", "label", "v").mapInArrow(file, "label string, d int, t int, cell long, key long, code binary"), "cells")
    place = ["label", "d", "t", "cell"]
    size = filed.groupBy(place).agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("long"))
    # a cell of many rows is cut into parts; each two parts meet in a block of their own
    dealt = filed.join(size, place).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select(*place, F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "key", "code")
    group = [*place, "lo", "hi"]
    dealt = dealt.repartition(*group).sortWithinPartitions(*group, "part", "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "n", "kind"]

        def block(at: tuple, parts: list, keys: list, raw: list) -> pa.RecordBatch | None:
            if len(keys) < 2:
                return None
            _, _, t, cell, lo, hi = at
            c = np.frombuffer(b"".join(raw), np.int16).reshape(len(raw), -1)
            cut = parts.count(lo) if lo != hi else len(keys)
            left, right = slice(0, cut), slice(0, cut) if lo == hi else slice(cut, len(keys))
            key, count, pairs, maybe = np.array(keys), np.zeros(len(keys), np.int64), [], []
            for i, j, sure in _links(c, left, right, lo == hi, t, cell, scale, threshold):
                maybe.append(np.stack([key[i[~sure]], key[j[~sure]]]))
                i, j = i[sure], j[sure]
                count += np.bincount(i, minlength=len(keys)) + np.bincount(j, minlength=len(keys))
                root = _forest(len(keys), i, j)
                pairs.append(np.stack([key, key[root]])[:, root != np.arange(len(keys))])
            some = np.flatnonzero(count)
            rows = [np.stack([key[some], key[some], count[some], 0 * some])] + [np.stack([p[0], p[1], 0 * p[0], 0 * p[0] + kind]) for kind, ps in ((1, pairs), (2, maybe)) for p in ps]
            a = np.concatenate(rows, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in a], names) if a.shape[1] else None

        at, held = None, ([], [], [])
        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(9)]
            for row in zip(*cols, strict=True):
                if row[:6] != at:
                    if at and (out := block(at, *held)):
                        yield out
                    at, held = row[:6], ([], [], [])
                for x, y in zip(held, row[6:], strict=True):
                    x.append(y)
        if at and (out := block(at, *held)):
            yield out

    found = written(dealt.mapInArrow(compare, "a long, b long, n long, kind long"), "found")
    # pairs too near the threshold for the grid are decided on the vectors themselves
    left, right = (wide.select(F.col("key").alias(x), F.col("v").alias(f"v{x}")) for x in "ab")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    close = found.where("kind = 2").select("a", "b").join(left, "a").join(right, "b")
    close = written(close.where(dot("va", "vb") / F.sqrt(dot("va", "va") * dot("vb", "vb")) >= threshold).select("a", "b"), "close")
    counts = found.where("kind = 0").select(F.col("a").alias("key"), "n").union(close.select("a", F.lit(1).cast("long"))).union(close.select("b", F.lit(1).cast("long"))).groupBy("key").agg(F.sum("n").alias("n_links"))
    roots = components(found.where("kind = 1").select("a", "b").union(close))
    out = wide.drop("v", "label").join(counts, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    names = out.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = out.join(names, "root").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of embeddings. Null label or vec_id, and vectors that are null, empty, zero or not finite:
    linked with nothing. Very long vectors: rotated as a whole, one table for each eight coordinates. Repeated
    rows and ties: linked with each other, one vec_id names all. Other columns, clashing names among them, are
    ignored. Empty table: empty result."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
