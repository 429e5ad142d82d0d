"""Operator 12: vectors as short codes, by codebooks that member-resident Lloyd rounds learn.

Vectors are cut into parts, and each part lives where the entry that it is assigned to lives: in the
bucket of (position, entry, salt) of a bucketed table. Owners update an entry from the members that
reside with them, which needs no shuffle of members; with the new entries they assign their members
anew, and only the parts whose entry changed are shuffled, to their new owners. Salts keep the members
of a crowded entry in several owners. All arithmetic is on whole numbers, so results don't depend on order.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actionline.llm.common import deleted, shared_dir, table, written

#: Members of an entry that one owner should have; also rows that share a bucket for each of BUCKET.
OWNER, BUCKET = 4096, 100_000
#: Components times 1024 must stay below this in magnitude, so that sums and squares fit 64 bits.
LARGEST = 1 << 26
#: Labels up to this count are sent to all tasks with their sums; more are joined by a shuffle.
FEW_LABELS = 1_000_000
HOME = ["position", "home", "salt"]
PART = "key long, vec_id long, label string, position int, part array<int>"


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, ties to the lower index, and its squared distance; exact."""
    index = np.zeros(len(parts), np.int64)
    most = int(max(np.abs(parts).max(initial=0), np.abs(entries).max(initial=0)))
    if 3 * parts.shape[1] * most * most < 1 << 53:  # whole numbers that doubles hold
        c = entries.astype(float)
        for at in range(0, len(parts), 4096):
            index[at : at + 4096] = ((c * c).sum(1) - 2 * (parts[at : at + 4096].astype(float) @ c.T)).argmin(1)
    else:
        for at in range(0, len(parts), 64):
            index[at : at + 64] = ((parts[at : at + 64, None, :] - entries[None]) ** 2).sum(2).argmin(1)
    return index, ((parts - entries[index]) ** 2).sum(1)


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


def cut(vectors: DataFrame, d: int, positions: int) -> DataFrame:
    """A row for each part of each vector, its components as floor(1024 x). vec_id and label go with position 0."""
    width = -(-d // positions)
    whole = F.transform("v", lambda x: F.floor(x * 1024).cast("int"))
    whole = F.concat(whole, F.array_repeat(F.lit(0), width * positions - d)) if width * positions > d else whole
    out = vectors.select("key", "vec_id", "label", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(positions - 1)), lambda p: F.slice(whole, p * width + 1, width))).alias("position", "part"))
    return out.select("key", *(F.when(F.col("position") == 0, F.col(x)).alias(x) for x in ("vec_id", "label")), "position", "part")


class Residents:
    """A table of parts in which those of an owner lie in one bucket. ``moved`` marks, in a folder of their own,
    rows that are to leave their owner: their new owner has them too, once ``migrate`` has run."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.name = f"actionline_members_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(spark)}/{self.name}"

    def add(self, rows: DataFrame) -> None:
        columns = [*(x.split()[0] for x in PART.split(", ")), "entry", "home", "salt", "moved"]
        rows.select(columns).write.format("parquet").mode("append").partitionBy("moved").bucketBy(self.buckets, *HOME).option("path", self.path).saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def rows(self, moved: bool) -> DataFrame:
        return self.spark.table(self.name).where(F.col("moved") == moved).drop("moved")

    def migrate(self, rows: DataFrame, counts: DataFrame) -> None:
        """rows go to the owners of their entry; an entry has as many salts as its count asks for."""
        salts = F.ceil(F.col("n") / OWNER).cast("long")
        dealt = rows.drop("home", "salt").join(F.broadcast(counts), ["position", "entry"])  # a row for each entry at most
        dealt = dealt.withColumn("home", F.col("entry")).withColumn("salt", F.pmod(F.xxhash64("key"), salts).cast("int")).withColumn("moved", F.lit(False))
        self.add(dealt.repartition(self.buckets, *HOME))

    def counts(self) -> DataFrame:
        return self.spark.table(self.name).groupBy("position", "entry").agg(F.count("*").alias("n"))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        deleted(self.spark, self.path)


def assign(parts: DataFrame, books: np.ndarray) -> DataFrame:
    """parts with the nearest entry of their position's codebook."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            position, x, entry = b.column("position").to_numpy(), _matrix(b.column("part")), np.zeros(b.num_rows, np.int32)
            for p in np.unique(position):
                entry[position == p] = nearest(x[position == p], books[p])[0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(entry)], [*b.schema.names, "entry"])

    return parts.mapInArrow(run, f"{PART}, entry int")


def update(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each entry at the floored mean of its members, unused ones as they were.

    Owners sum the members that reside with them; the driver gets one row for each entry."""
    width = books.shape[2]
    sums = members.groupBy(*HOME).agg(F.count("*").alias("n"), *(F.sum(F.get("part", F.lit(i))).alias(f"s{i}") for i in range(width)))
    sums = sums.groupBy("position", "home").agg(*(F.sum(x).alias(x) for x in ["n", *(f"s{i}" for i in range(width))]))
    out = books.copy()
    for r in sums.collect():
        out[r["position"], r["home"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out


def _reassigned(members: DataFrame, books: np.ndarray) -> DataFrame:
    """members with the entry that is nearest now; each owner goes through its own."""

    def run(group: pa.Table) -> pa.Table:
        entry, _ = nearest(_matrix(group["part"].combine_chunks()), books[group["position"][0].as_py()])
        entry = entry.astype(np.int32)
        moved = entry != group["home"].to_numpy()
        at = group.schema.names.index("entry")
        return group.set_column(at, "entry", pa.array(entry)).append_column("moved", pa.array(moved))

    return members.select(*(x.split()[0] for x in PART.split(", ")), "entry", "home", "salt").groupBy(*HOME).applyInArrow(run, f"{PART}, entry int, home int, salt int, moved boolean")


def _measured(members: DataFrame, books: np.ndarray) -> DataFrame:
    """key, vec_id, label, position, entry and squared distance of each part, from its owner."""

    def run(group: pa.Table) -> pa.Table:
        entry, error = nearest(_matrix(group["part"].combine_chunks()), books[group["position"][0].as_py()])
        return group.select(["key", "vec_id", "label", "position"]).append_column("entry", pa.array(entry.astype(np.int32))).append_column("error", pa.array(error))

    return members.groupBy(*HOME).applyInArrow(run, "key long, vec_id long, label string, position int, entry int, error long")


def compressed(vectors: DataFrame, positions: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each usable row of vectors.

    Not usable are null and empty vectors, those with null or non-finite components, and those of another
    length than the vector of the smallest vec_id; they have no row. A length that positions don't divide is
    filled up with zeros. Codebooks start with the smallest vec_ids (of equal ones the smaller vector first,
    null ids last); with fewer rows than entries they are as short. Repeated rows each have their own row and
    weigh as often; ties go to the lower entry. Null labels make one group. Components of 65,536 or more in
    magnitude don't fit the sums and raise ValueError. Other columns, whatever their names, are ignored; an
    empty table gives an empty result.
    """
    spark = vectors.sparkSession
    wide = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    wide = wide.where((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    wide = written(wide.withColumn("key", F.monotonically_increasing_id()), "vectors")
    order = [F.col("vec_id").asc_nulls_last(), F.col("v").asc()]
    first = wide.orderBy(*order).first()
    if first is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    d = len(first["v"])
    wide = wide.where(F.size("v") == d)
    rows, largest = wide.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if largest * 1024 >= LARGEST:
        raise ValueError(f"components must be below {LARGEST >> 10} in magnitude")
    start = cut(wide.orderBy(*order).limit(entries).withColumn("key", F.monotonically_increasing_id()), d, positions)
    start = start.groupBy("position").agg(F.sort_array(F.collect_list(F.struct("key", "part"))).alias("book")).orderBy("position").collect()  # `entries` vectors
    books = np.array([[x["part"] for x in r["book"]] for r in start], np.int64)

    buckets = max(spark.sparkContext.defaultParallelism, -(-rows * positions // BUCKET))
    parts = written(assign(cut(wide, d, positions), books), "parts")
    home = Residents(spark, min(buckets, 50_000))
    home.migrate(parts, parts.groupBy("position", "entry").agg(F.count("*").alias("n")))
    deleted(spark, parts)
    for left in range(rounds, 0, -1):
        members = home.rows(moved=False)
        books = update(members, books)
        if left > 1:
            after = Residents(spark, home.buckets)
            after.add(_reassigned(members, books))
            after.migrate(after.rows(moved=True), after.counts())
            home.drop()
            home = after
    codes = _measured(home.rows(moved=False), books)
    digits = max(2, len(f"{entries - 1:x}"))
    code = F.concat(*(F.lpad(F.lower(F.hex(F.max(F.when(F.col("position") == p, F.col("entry"))))), digits, "0") for p in range(positions)))
    codes = written(codes.groupBy("key").agg(F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), code.alias("code"), F.sum("error").alias("error")), "codes", instead=wide)
    home.drop()
    labels = written(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    labels = labels.withColumnRenamed("label", "of")
    labels = F.broadcast(labels) if labels.count() <= FEW_LABELS else labels
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return codes.join(labels, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of embeddings with a usable vector. Null, empty and non-finite vectors, and those of another
    length than the first: no row. Null vec_id: last in order. Very long vectors: cut into four parts all the
    same. Null labels: one group. Ties: the lower entry. Repeated rows: each its own. Other columns, clashing names
    among them, are ignored. Empty table: empty result."""
    return compressed(table(spark, sf_dir, "embeddings"))
