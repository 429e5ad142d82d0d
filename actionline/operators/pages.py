"""Page images: blank and solid-coloured ones, and the status of records by them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK, SOLID = 10.0, 0.97


def blank_stats(images: DataFrame) -> DataFrame:
    """M8: luma_std, channel_std (the largest), blank of raw RGB images (id, w, h, rgb).

    An image whose bytes don't fit its size is broken, which counts as blank. Only three numbers an image
    leave the task; pixels are never shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, w, h, rgb in zip(b.id, b.w, b.h, b.rgb, strict=True):
                if rgb is None or not w or not h or len(rgb) != 3 * w * h:
                    rows.append((i, None, None, True))
                    continue
                x = np.frombuffer(rgb, np.uint8).reshape(-1, 3).astype(float)
                luma, channel = float((x @ [0.299, 0.587, 0.114]).std()), float(x.std(0).max())
                rows.append((i, luma, channel, luma < BLANK or channel < BLANK))
            yield pd.DataFrame(rows, columns=["id", "luma_std", "channel_std", "blank"])

    return images.select("id", "w", "h", "rgb").mapInPandas(run, "id string, luma_std double, channel_std double, blank boolean")


def blank_stats_grey(pixels: DataFrame) -> DataFrame:
    """M8 for grey pixels in rows (id, grey): the same test with built-in aggregates."""
    s = pixels.groupBy("id").agg(F.stddev_pop("grey").alias("luma_std"))
    return s.withColumn("blank", F.col("luma_std") < BLANK)


def filter_pages(records: DataFrame, stats: DataFrame) -> DataFrame:
    """M9: status of each record: missing_id, file_not_found, render_error, blank_detected or valid.

    stats: id, rendered, blank, of the pages that were found."""
    j = records.join(stats.select("id", "rendered", "blank", F.lit(True).alias("__found")), "id", "left")
    status = (
        F.when(F.coalesce(F.col("id").cast("string"), F.lit("")) == "", "missing_id").when(F.col("__found").isNull(), "file_not_found")
        .when(~F.coalesce("rendered", F.lit(False)), "render_error").when(F.col("blank"), "blank_detected").otherwise("valid")
    )
    return j.withColumn("status", status).drop("rendered", "blank", "__found")


def status_counts(filtered: DataFrame) -> DataFrame:
    """M9: records by status."""
    return filtered.groupBy("status").agg(F.count("*").alias("n"))


def solid_images(pixels: DataFrame) -> DataFrame:
    """Share of the commonest colour of each image, colours in two levels a channel (eight buckets)."""
    level = F.floor(F.col("grey") / 128)
    n = pixels.groupBy("id", level.alias("colour")).agg(F.count("*").alias("n"))
    return n.groupBy("id").agg((F.max("n") / F.sum("n")).alias("ratio"))


def solid_rgb(images: DataFrame) -> DataFrame:
    """E11 for raw RGB images (id, w, h, rgb): ratio, null where an image is broken."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ratios = []
            for w, h, rgb in zip(b.w, b.h, b.rgb, strict=True):
                if rgb is None or not w or not h or len(rgb) != 3 * w * h:
                    ratios.append(None)
                    continue
                x = np.frombuffer(rgb, np.uint8).reshape(-1, 3) >> 7
                ratios.append(float(np.bincount(x @ np.array([4, 2, 1]), minlength=8).max() / len(x)))
            yield pd.DataFrame({"id": b.id, "ratio": ratios})

    return images.select("id", "w", "h", "rgb").mapInPandas(run, "id string, ratio double")


def solid_tasks(images: DataFrame, least: float = SOLID) -> DataFrame:
    """Per task (task_id, ratio of each first image) whether all are solid, with counts. Tasks without images are absent."""
    s = F.col("ratio") >= least
    return images.where("ratio is not null").groupBy("task_id").agg(F.bool_and(s).alias("solid"), F.count_if(s).alias("n_solid"), F.count("*").alias("n_images"))
