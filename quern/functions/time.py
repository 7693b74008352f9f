"""Times and durations as expressions. Timestamps are without zone and mean UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Seconds from 0001-01-01, where buckets are counted from, to 1970-01-01.
EPOCH_SECONDS = 62_135_596_800


def seconds(n: Column | float) -> Column:
    """``n`` seconds as an interval."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n if isinstance(n, Column) else F.lit(n)).cast("decimal(18,6)"))


def window_offset(width: int) -> str:
    """Start offset that lets windows of ``width`` seconds begin where those counted from year 1 do."""
    return f"{-EPOCH_SECONDS % width} seconds"


def bucket_start(ts: Column, width: int) -> Column:
    """Start of the window of ``width`` seconds that holds ``ts``."""
    return F.window(ts, f"{width} seconds", startTime=window_offset(width))["start"]


def tolerant_timestamp(text: Column, required: bool = False) -> Column:
    """A timestamp from text; text that is none gives null, or 1970-01-01 where one is required."""
    parsed = F.try_to_timestamp(text).cast("timestamp_ntz")
    return F.coalesce(parsed, F.lit("1970-01-01").cast("timestamp_ntz")) if required else parsed


def retry_delay(retry: Column, initial: float = 5.0, most: float = 300.0, exponential: bool = True) -> Column:
    """Seconds before the ``retry``-th retry: ``initial`` doubled for each one before, at most ``most``."""
    steps = F.greatest(F.lit(0), F.least(retry - 1, F.lit(62))) if exponential else F.lit(0)
    return F.least(F.lit(initial) * F.pow(F.lit(2.0), steps), F.lit(most))


def milliseconds(ticks: Column, per_second: int = 10_000_000) -> Column:
    """Milliseconds of a number of clock ticks."""
    return ticks * F.lit(1000.0) / F.lit(float(per_second))


def map_to_json(entries: Column) -> Column:
    """A map as JSON text; null and empty maps are null."""
    return F.when(F.size(entries) > 0, F.to_json(entries))


def map_from_json(text: Column) -> Column:
    """A map of strings from JSON text; blank text and text that is none give null."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) != "", F.from_json(text, "map<string,string>"))


def flag(entries: Column, key: str) -> Column:
    """Whether a flag in a map of strings is set: ``true`` in any case; a missing one isn't."""
    return F.coalesce(F.lower(F.element_at(entries, key)) == "true", F.lit(False))


def with_flag(entries: Column, key: str, value: str | None) -> Column:
    """A map with one key set, or without it where ``value`` is None; a null map is an empty one."""
    rest = F.map_filter(F.coalesce(entries, F.create_map().cast("map<string,string>")), lambda k, _: k != key)
    return rest if value is None else F.map_concat(rest, F.create_map(F.lit(key), F.lit(value)))
