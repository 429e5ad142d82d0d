"""Bloom filters as aggregates of the plan: which rows may have a partner, told before anything is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter: a megabyte, whatever the number of keys; beyond a few million keys it tells less, never wrongly.
BITS = 1 << 23
HASHES = 3


def _positions(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(bits)) for k in range(HASHES)]


def may_be_in(keys: DataFrame, column: str, key: Column, bits: int = BITS) -> Column:
    """Whether ``key`` may be among keys[column]: surely not where false. A null is a key like any other.

    The words of the filter come from one aggregate over keys, of ``bits`` / 64 rows, which the plan runs as a
    subquery; every task then gets them as one array of ``bits`` bits, whose size does not depend on the data."""
    spark = keys.sparkSession
    places = keys.select(F.explode(F.array(*_positions(F.col(column), bits))).alias("p"))
    words = places.select(F.shiftright("p", 6).alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(63).cast("int")).alias("w"))
    words = words.union(spark.range(bits // 64).select("id", F.lit(0).cast("long"))).groupBy("i").agg(F.bit_or("w").alias("w"))
    words = words.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("words"))
    out = None
    for p in _positions(key, bits):
        here = F.getbit(F.get(words.scalar(), F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1
        out = here if out is None else out & here
    return out


def not_in(items: DataFrame, keys: DataFrame, key: str = "id", bits: int = BITS) -> DataFrame:
    """The rows of items whose key is not in keys, for key sets that are too large to be sent to every task.

    Rows that the filter excludes stay where they are; only those that may have a partner are shuffled, for the
    exact join. Null keys match null keys."""
    hit = may_be_in(keys, key, items[key], bits)
    d = keys.select(F.col(key).alias("__known")).distinct()
    maybe = items.where(hit)
    return items.where(~hit).unionByName(maybe.join(d, maybe[key].eqNullSafe(d["__known"]), "left_anti"))
