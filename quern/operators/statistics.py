"""Bucketed measurements: recording, snapshots, rates, caps and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.time import bucket_start, seconds
from ..schema import DIMENSIONS, TOTALS


def recorded(measurements: DataFrame, width: int = 300, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Sums by bucket of ``width`` seconds, name and the ``dimensions`` that are kept; the others are null.

    Values of 0 and blank names count for nothing. Partial sums meet in one shuffle.
    """
    kept = measurements.where((F.col("value") != 0) & (F.trim("name") != "")).withColumn("bucket_start", bucket_start(F.col("ts"), width))
    kept = kept.withColumns({d: F.col(d) if d in dimensions else F.lit(None).cast("string") for d in DIMENSIONS})
    return kept.groupBy("bucket_start", "name", *DIMENSIONS).agg(F.sum("value").alias("value"))


def _matches(requested: str | None, column: Column) -> Column:
    return F.lit(True) if not requested else F.coalesce(column == requested, F.lit(False))


def overlapping(cells: DataFrame, start: Column, end: Column, width: int = 300, **filters: str | None) -> DataFrame:
    """Whole buckets that touch [start, end), of the dimensions asked for; none or an empty one asks for any."""
    out = cells.where((F.col("bucket_start") + seconds(width) > start) & (F.col("bucket_start") < end))
    for name, value in filters.items():
        out = out.where(_matches(value, F.col(name)))
    return out


def snapshot_measurements(cells: DataFrame) -> DataFrame:
    """Sums over the buckets by name and dimensions."""
    return cells.groupBy("name", *DIMENSIONS).agg(F.sum("value").alias("value"))


def snapshot_totals(cells: DataFrame, span_seconds: float) -> DataFrame:
    """One row: the known totals, 0 where nothing was measured, and megabytes written per second of the span."""
    totals = [F.coalesce(F.sum(F.when(F.col("name") == m, F.col("value"))), F.lit(0)).alias(t) for t, m in TOTALS.items()]
    rate = F.col("write_bytes") / 1024 / 1024 / F.lit(float(span_seconds))
    return cells.agg(*totals).withColumn("write_megabytes_per_second", rate)


def rates(cells: DataFrame, span_seconds: float, *by: str) -> DataFrame:
    """Megabytes written per second of the span by dimension."""
    written = cells.where(F.col("name") == TOTALS["write_bytes"]).groupBy(*by).agg(F.sum("value").alias("write_bytes"))
    return written.withColumn("write_megabytes_per_second", F.col("write_bytes") / 1024 / 1024 / F.lit(float(span_seconds)))


def pruned(cells: DataFrame, now: Column, retention: int, width: int = 300) -> DataFrame:
    """Buckets not yet older than the retention and one window."""
    return cells.where(F.col("bucket_start") >= now - seconds(retention + width))


def capped(measurements: DataFrame, most: int, width: int = 300, now: Column | None = None, retention: int | None = None) -> DataFrame:
    """``recorded``, but only for the ``most`` series that arrive first; later series are dropped, those there go on.

    The cap is the feature: first arrivals come from partial minima, and the smallest ``most`` of them from a
    top-k. With ``now`` and ``retention``, series that are pruned by then take no place.
    """
    cells = measurements.where((F.col("value") != 0) & (F.trim("name") != "")).withColumn("bucket_start", bucket_start(F.col("ts"), width))
    if now is not None and retention is not None:
        cells = pruned(cells, now, retention, width)
    series = ["bucket_start", "name", *DIMENSIONS]
    keyed = cells.withColumn("series", F.to_json(F.struct(*series)))
    first = keyed.groupBy("series").agg(F.min("arrival").alias("first")).orderBy("first", "series").limit(most).select("series")
    return keyed.join(first, "series", "left_semi").groupBy(*series).agg(F.sum("value").alias("value"))


def operation_log_totals(measurements: DataFrame) -> DataFrame:
    """Write-path counters over a log of operations: batches of one and of more records, records and the largest batch."""
    return measurements.groupBy("operation").agg(
        F.count("*").alias("batches"), F.count_if(F.col("value") == 1).alias("single_batches"), F.count_if(F.col("value") > 1).alias("multi_batches"), F.sum("value").alias("records"), F.max("value").alias("largest")
    )


def instrument_totals(measurements: DataFrame, bounds: list[float]) -> DataFrame:
    """Instruments by name: count, sum, least, greatest, and the number of values up to each of ``bounds`` and above (``buckets``, one more than bounds)."""
    value, edges = F.col("value"), [None, *bounds, None]
    inside = [(F.lit(True) if low is None else value > low) & (F.lit(True) if high is None else value <= high) for low, high in zip(edges, edges[1:])]
    return measurements.groupBy("name").agg(F.count("value").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.array(*[F.count_if(x) for x in inside]).alias("buckets"))


def quantiles(measurements: DataFrame, shares: list[float], accuracy: int = 10_000) -> DataFrame:
    """Quantiles of each instrument's values, whole numbers that occur; exact while a name has fewer than ``accuracy`` distinct values."""
    return measurements.groupBy("name").agg(F.percentile_approx("value", shares, accuracy).alias("q")).select("name", *[F.col("q")[i].alias(f"p{round(100 * s)}") for i, s in enumerate(shares)])


def summary_line(totals: DataFrame, window: str, include_empty: bool = False) -> DataFrame:
    """One line of text for a row of ``snapshot_totals``, none where all eight totals are 0 (unless ``include_empty``)."""
    names = {
        "WriteFiles": "write_success_count", "WriteMBps": "write_megabytes_per_second", "WriteBytes": "write_bytes", "DequeuedFiles": "dequeued_count", "ReadFiles": "read_count", "CompletedFiles": "completed_count",
        "SqliteOps": "persisted_operations", "WatcherImportedFiles": "imported_count", "WatcherImportedBytes": "imported_bytes",
    }
    empty = F.lit(True)
    for t in TOTALS:
        empty = empty & (F.col(t) == 0)
    shown = [F.concat(F.lit(f", {k}="), F.format_string("%.3f", F.col(c)) if c.endswith("per_second") else F.col(c).cast("string")) for k, c in names.items()]
    rows = totals if include_empty else totals.where(~empty)
    return rows.select(F.concat(F.lit(f"Statistics summary: Window={window}"), *shown).alias("line"))
