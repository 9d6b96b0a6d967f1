"""Incremental counters over message streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, at: str = "ts", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """window_start, event_type, n, total: events that come later than ``late`` after the latest are left out."""
    typed = stream.withColumn(at, F.col(at).cast("timestamp"))
    return typed.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def first_seen(stream: DataFrame, key: str, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])
