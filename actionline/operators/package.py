"""Shards and media manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assign_shards(df: DataFrame, key: str = "id", limit: int = 1000, ranges: int = 200, sample: int = 40) -> DataFrame:
    """Part (from 1) of each row, ``limit`` rows a part in the order of the key. Rows with equal keys follow
    by their content, null keys come first.

    No task sees all rows: ranges of (key, content) are cut at every ``sample``-th of a bounded, seeded sample of
    rows, so ranges have about equally many rows and a key that is repeated very often is split like any other;
    each range is counted, and rows are numbered within their range from its offset. The bounds are a subquery
    of the plan: nothing runs when the frame is made. Only rows that are equal in all columns stay together.
    """
    place = df.select("*", F.struct(F.col(key).alias("k"), F.xxhash64(*[F.col(c) for c in df.columns]).alias("h")).alias("__place"))
    # the sample bounds only where ranges begin; all rows are numbered
    drawn = place.select("__place").orderBy(F.xxhash64("__place"), "__place").limit(ranges * sample)
    # numbered as rows: in a lambda over the sorted list each element would sort it anew
    at, n = F.row_number().over(Window.orderBy("__place")) - 1, F.count("*").over(Window.partitionBy())
    drawn = drawn.select("__place", (at % F.greatest(F.lit(1), F.ceil(n / ranges))).alias("__at")).where("__at = 0")
    bounds = drawn.agg(F.sort_array(F.collect_list("__place"))).scalar()
    # a row's place is bound to a name of its own, so that its content is hashed once and not for each bound
    below = F.transform(F.array("__place"), lambda p: F.size(F.filter("__bounds", lambda b: b <= p)))
    # never null, else the join's check for nulls would compute ranges for all rows that df is made from
    placed = place.withColumn("__bounds", bounds).withColumn("__range", F.coalesce(F.get(below, F.lit(0)), F.lit(0))).drop("__bounds")
    counts = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    # one row for each range at most
    offsets = counts.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    rn = F.row_number().over(Window.partitionBy("__range").orderBy("__place"))
    numbered = placed.join(F.broadcast(offsets), "__range").withColumn("__i", F.col("__offset") + rn - 1)
    return numbered.withColumn("part", (F.floor(F.col("__i") / limit) + 1).cast("long")).drop("__range", "__offset", "__i", "__place")


def media_manifest(records: DataFrame, inventory: DataFrame) -> DataFrame:
    """Part, name, path, present for the recording and every clip of each record."""
    paths = F.concat(F.array("video_path"), F.coalesce("clip_video_list", F.array().cast("array<string>")))
    rows = records.select("id", "part", F.explode(paths).alias("path")).where("path is not null")
    have = inventory.select("path").distinct().withColumn("present", F.lit(True))
    out = rows.join(have, "path", "left").withColumn("present", F.coalesce("present", F.lit(False)))
    return out.select("id", "part", F.element_at(F.split("path", "/"), -1).alias("name"), "path", "present")


def media_index(manifest: DataFrame, media: DataFrame) -> DataFrame:
    """Part, name, md5, size of present files. media: path with md5 and size, as ``read_digests`` finds them,
    or with content."""
    sums = media if "md5" in media.columns else media.select("path", F.md5("content").alias("md5"), F.octet_length("content").cast("long").alias("size"))
    return manifest.where("present").join(sums.select("path", "md5", "size"), "path").select("part", "name", "md5", "size")


def duplicate_names(manifest: DataFrame) -> DataFrame:
    """Names that stand for more than one path in a part; such parts fail."""
    return manifest.groupBy("part", "name").agg(F.count_distinct("path").alias("n")).where("n > 1")


def attach_shard_ids(records: DataFrame, shards: DataFrame, stem: str = "stem") -> DataFrame:
    """Records with the identifier of their shard; those without one go (see missing_shards)."""
    return records.join(shards.select(stem, "shard_uuid"), stem)


def missing_shards(records: DataFrame, shards: DataFrame, stem: str = "stem") -> DataFrame:
    """Stems of records that have no shard, with their counts."""
    return records.join(shards.select(stem), stem, "left_anti").groupBy(stem).agg(F.count("*").alias("n"))
