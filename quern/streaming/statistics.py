"""Bucketed measurements as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.time import window_offset
from ..schema import DIMENSIONS


def recorded_stream(measurements: DataFrame, width: int = 300, retention: int = 86_400) -> DataFrame:
    """Sums by bucket, name and dimensions of a stream of measurements with a ``ts``.

    A late measurement lands in its bucket until the bucket is older than the retention and one window
    behind the newest measurement seen (a stream has no clock but its events).
    """
    live = measurements.where((F.col("value") != 0) & (F.trim("name") != "")).withColumn("ts", F.col("ts").cast("timestamp"))
    window = F.window("ts", f"{width} seconds", startTime=window_offset(width))
    sums = live.withWatermark("ts", f"{retention + width} seconds").groupBy(window.alias("w"), "name", *DIMENSIONS).agg(F.sum("value").alias("value"))
    return sums.select(F.col("w.start").cast("timestamp_ntz").alias("bucket_start"), "name", *DIMENSIONS, "value")
