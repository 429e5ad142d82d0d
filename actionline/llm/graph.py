"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actionline.llm.common import written


def _stars(edges: DataFrame) -> DataFrame:
    """One large star and one small star over edges (u, v) with u > v."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    keep = low.where("m < u").select("u", F.col("m").alias("v"))
    large = large.union(keep).where("u > v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node that has an edge; root is the smallest node that it reaches.

    edges: two columns of comparable values, any order and repeats; nulls and loops are ignored. Every
    round is written to the shared folder; the driver sees only a count and a checksum of each. Rounds
    grow as the logarithm of the longest chain. An empty table gives an empty result.
    """
    a, b = edges.columns
    state = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    sign = None
    for _ in range(most_rounds):
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == sign or not now[0]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(state.select("v", "v")).distinct()
        sign = tuple(now)
        state = written(_stars(state), "edges", instead=state)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
