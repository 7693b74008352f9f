"""Conditional changes of single rows, as sets: commands joined to rows, applied where they still hold.

Each function takes ``files`` and ``commands`` (tenant_id, file_key and what it expects) and returns the
changed rows with all columns of ``files``; a command without a change in the result was rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.time import seconds


def _nothing() -> Column:
    return F.lit(None).cast("timestamp_ntz")


def _due(files: DataFrame, commands: DataFrame, holds: Column) -> DataFrame:
    """Rows whose command holds; of several commands for a row any one that holds counts once."""
    extra = [c for c in commands.columns if c.startswith("expected_")]
    named = commands.select("tenant_id", "file_key", *extra).distinct()
    return files.join(named, ["tenant_id", "file_key"]).where(holds).drop(*extra).dropDuplicates(["tenant_id", "file_key"])


def leased(files: DataFrame, commands: DataFrame, now: Column) -> DataFrame:
    """Ready pending rows become processing from ``now`` on; an earlier released lease is forgotten."""
    ready = (F.col("status") == 0) & (F.col("available_at").isNull() | (F.col("available_at") <= now))
    return _due(files, commands, ready).withColumns({"status": F.lit(1), "processing_start_time": now, "available_at": _nothing(), "released_lease": _nothing()})


def reset_to_pending(files: DataFrame, commands: DataFrame) -> DataFrame:
    """Any row that isn't processing starts over."""
    return _due(files, commands, F.col("status") != 1).withColumns({"status": F.lit(0), "retry_count": F.lit(0), "last_failed_at": _nothing(), "last_error": F.lit(None).cast("string"), "processing_start_time": _nothing(), "available_at": _nothing()})


def reset_timed_out(files: DataFrame, commands: DataFrame, available_at: Column) -> DataFrame:
    """Processing rows under the expected lease (expected_start) become pending at ``available_at``; the lease counts as released."""
    same = (F.col("status") == 1) & (F.col("processing_start_time") == F.col("expected_start"))
    return _due(files, commands, same).withColumns({"status": F.lit(0), "available_at": available_at, "released_lease": F.col("processing_start_time"), "processing_start_time": _nothing()})


def reset_all_timed_out(files: DataFrame, now: Column, timeout: int) -> DataFrame:
    """All processing rows whose lease began more than ``timeout`` seconds ago become pending at once; their leases count as released."""
    late = files.where((F.col("status") == 1) & (F.col("processing_start_time") < now - seconds(timeout)))
    return late.withColumns({"status": F.lit(0), "available_at": _nothing(), "released_lease": F.col("processing_start_time"), "processing_start_time": _nothing()})


def processing_updated(files: DataFrame, commands: DataFrame, change: dict[str, Column]) -> DataFrame:
    """Processing rows under the expected lease (expected_start) with ``change`` applied."""
    return _due(files, commands, _under_lease()).withColumns(change)


def processing_removed(files: DataFrame, commands: DataFrame) -> DataFrame:
    """``files`` without the processing rows whose expected lease (expected_start) still holds."""
    return files.join(_due(files, commands, _under_lease()).select("tenant_id", "file_key"), ["tenant_id", "file_key"], "left_anti")


def _under_lease() -> Column:
    return (F.col("status") == 1) & (F.col("processing_start_time") == F.col("expected_start"))


def _as_completed() -> Column:
    return F.col("status").isin(2, 5) & (F.col("completed_at") == F.col("expected_completed_at"))


def marked_deleted(files: DataFrame, commands: DataFrame, now: Column) -> DataFrame:
    """Completed or delete-requested rows with the expected completion time (expected_completed_at) are deleted; one deleted at ``now`` or later stays as it is."""
    newer = F.coalesce(F.col("delete_succeeded_at") >= now, F.lit(False))
    return _due(files, commands, _as_completed()).withColumns({"status": F.when(newer, F.col("status")).otherwise(F.lit(6)), "delete_succeeded_at": F.when(newer, F.col("delete_succeeded_at")).otherwise(now)})


def completed_removed(files: DataFrame, commands: DataFrame) -> DataFrame:
    """``files`` without the completed rows whose expected completion time still holds."""
    return files.join(_due(files, commands, _as_completed()).select("tenant_id", "file_key"), ["tenant_id", "file_key"], "left_anti")


def _as_failed() -> Column:
    return (F.col("status") == 4) & (F.col("last_failed_at") == F.col("expected_failed_at"))


def failed_removed(files: DataFrame, commands: DataFrame) -> DataFrame:
    """``files`` without the permanently failed rows whose expected failure (expected_failed_at) still holds."""
    return files.join(_due(files, commands, _as_failed()).select("tenant_id", "file_key"), ["tenant_id", "file_key"], "left_anti")


def failed_marked_deleted(files: DataFrame, commands: DataFrame, now: Column) -> DataFrame:
    """Permanently failed rows with the expected failure (expected_failed_at) count as deleted."""
    return _due(files, commands, _as_failed()).withColumns({"status": F.lit(6), "delete_succeeded_at": now})


def dead_lettered(files: DataFrame, commands: DataFrame, now: Column) -> DataFrame:
    """Permanently failed rows with the expected failure (expected_failed_at) become dead letters."""
    return _due(files, commands, _as_failed()).withColumns({"status": F.lit(7), "dead_lettered_at": now})


def converged(files: DataFrame, missing: DataFrame, now: Column) -> DataFrame:
    """Rows whose file is confirmed missing (expected_path) and that are through count as deleted."""
    same = F.col("status").isin(2, 4, 5, 6) & (F.col("physical_path") == F.col("expected_path"))
    return _due(files, missing, same).withColumns({"status": F.lit(6), "delete_succeeded_at": F.coalesce("delete_succeeded_at", now)})


def polling_interval(seconds_wanted: Column, default: int = 30, least: int = 5, most: int = 3600) -> Column:
    """The interval of a watcher in seconds: its own where it has one, within bounds."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.when(seconds_wanted > 0, seconds_wanted).otherwise(F.lit(default))))


def _next_due(now: Column) -> Column:
    """An interval after the last scan, at once without one, and never further ahead than an interval."""
    interval = seconds(polling_interval(F.col("interval_seconds")))
    return F.coalesce(F.least(F.col("last_scan") + interval, now + interval), now)


def watchers_due(watchers: DataFrame, now: Column) -> DataFrame:
    """Enabled watchers whose last scan is an interval ago, or that have never been scanned."""
    return watchers.where(F.col("enabled") & (_next_due(now) <= now))


def next_due(watchers: DataFrame, now: Column, default: int = 30, least_wait: float = 0.2) -> DataFrame:
    """When a watcher is due next (due_at; ``default`` seconds from now on where none is enabled) and how long to wait, at least ``least_wait`` seconds."""
    due = watchers.where("enabled").agg(F.min(_next_due(now)).alias("d")).select(F.coalesce("d", now + seconds(default)).alias("due_at"))
    left = (F.unix_micros(F.col("due_at").cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 1e6
    return due.select("due_at", F.when(left > 0, left).otherwise(F.lit(least_wait)).alias("wait_seconds"))


def rotation(tenants: DataFrame, after: str, most: int = 8, records: int | None = None) -> DataFrame:
    """The next ``most`` tenants in a round that goes on behind ``after``, with how many ``records`` of their lag one cycle takes."""
    ahead = tenants.withColumn("lap", (F.col("tenant_id") <= after).cast("int")).orderBy("lap", "tenant_id").limit(most)
    return ahead.select("tenant_id", "lap") if records is None else ahead.select("tenant_id", "lap", F.least(F.col("lag"), F.lit(records)).alias("records"))


def merged_optimistically(current: DataFrame, changed: DataFrame, read: DataFrame) -> DataFrame:
    """``changed`` rows where the row is still, in every column, as it was ``read``; else the current row with both metadata maps, the change's keys winning.

    All three have tenant_id, file_key and metadata (map) and the same further columns, which are compared null-safe.
    """
    own = [c for c in current.columns if c not in ("tenant_id", "file_key", "metadata")]
    side = lambda df, n: df.select("tenant_id", "file_key", F.struct(*own, "metadata").alias(n))
    rows = side(changed, "new").join(side(read, "old"), ["tenant_id", "file_key"]).join(side(current, "now"), ["tenant_id", "file_key"])
    entries = lambda m: F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>")))
    kept = F.filter(entries(F.col("now.metadata")), lambda e: ~F.coalesce(F.array_contains(F.map_keys("new.metadata"), e["key"]), F.lit(False)))
    both = F.map_from_entries(F.concat(kept, entries(F.col("new.metadata"))))
    same = F.array_sort(entries(F.col("now.metadata"))).eqNullSafe(F.array_sort(entries(F.col("old.metadata"))))
    for c in own:
        same = same & F.col(f"now.{c}").eqNullSafe(F.col(f"old.{c}"))
    pick = lambda c: F.when(same, F.col(f"new.{c}")).otherwise(F.col(f"now.{c}")).alias(c)
    return rows.select("tenant_id", "file_key", *map(pick, own), F.when(same, F.col("new.metadata")).otherwise(both).alias("metadata"))


def maintenance_due(state: DataFrame, least_bytes: int, least_snapshot_bytes: int, now: Column | None = None, interval: int = 0) -> DataFrame:
    """Which tenants to compact and to snapshot: (tenant_id, cursor, tail, base, snapshot_cursor[, snapshot_at]).

    Compaction is due when the cursor is ``least_bytes`` behind the base or more. A snapshot is due if there is
    none, if the cursor has gone back, and once it has advanced: by enough bytes, or at all when ``interval``
    seconds have gone by since the last one (0: at once).
    """
    compact = F.col("tail").isNotNull() & (F.col("tail") >= F.col("cursor")) & (F.col("cursor") - F.col("base") >= least_bytes)
    ahead = F.col("cursor") - F.col("snapshot_cursor")
    waited = F.lit(True) if not interval or now is None else F.col("snapshot_at") + seconds(interval) <= now
    snapshot = F.coalesce((ahead < 0) | ((ahead > 0) & ((ahead >= least_snapshot_bytes) | waited)), F.lit(True))
    return state.select("tenant_id", compact.alias("compact"), snapshot.alias("snapshot"))
