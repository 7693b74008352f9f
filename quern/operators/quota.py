"""Directory and tenant quotas: expected counts, reconciliation, limits and reservations."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import normalized_directory, recovered_directory, stem
from ..schema import ACTIVE


def expected_counts(files: DataFrame) -> DataFrame:
    """Active rows by tenant and directory, and by tenant under the tenant's own name, from one pass."""
    active = files.where(F.col("status").isin(*ACTIVE)).withColumn("directory", normalized_directory(F.col("directory_path")))
    counts = active.rollup("tenant_id", "directory").agg(F.count("*").alias("expected"), F.grouping_id().alias("level")).where("level < 3")
    return counts.select("tenant_id", F.when(F.col("level") == 1, F.col("tenant_id")).otherwise(F.col("directory")).alias("directory_path"), "expected")


def reconciled(files: DataFrame, quotas: DataFrame) -> DataFrame:
    """What to do with each quota row: ``set`` another count, ``remove`` an unlimited one of nothing, or ``keep``."""
    both = expected_counts(files).join(quotas, ["tenant_id", "directory_path"], "full")
    expected, limit = F.coalesce("expected", F.lit(0)), F.coalesce("max_count", F.lit(0))
    current = F.coalesce("current_count", F.lit(0))
    total = F.col("directory_path") == F.col("tenant_id")
    action = F.when((expected == 0) & (limit == 0) & ~total, "remove").when((expected != current) | F.col("current_count").isNull(), "set").otherwise("keep")
    return both.select("tenant_id", "directory_path", expected.alias("expected"), current.alias("current"), limit.alias("max_count"), action.alias("action"))


def applied(quotas: DataFrame, actions: DataFrame, now: Column) -> DataFrame:
    """The quota table after ``reconciled`` actions: counts set, rows of nothing removed, new rows unlimited; created_at of a row that was there stays."""
    both = actions.select("tenant_id", "directory_path", "expected", "action").join(quotas, ["tenant_id", "directory_path"], "left").where("action <> 'remove'")
    changed = F.col("action") == "set"
    return both.select(
        "tenant_id", "directory_path", F.col("expected").cast("bigint").alias("current_count"), F.coalesce("max_count", F.lit(0)).cast("bigint").alias("max_count"), F.coalesce("enabled", F.lit(False)).alias("enabled"),
        F.when(changed, now).otherwise(F.col("last_updated")).alias("last_updated"), F.coalesce("created_at", now).alias("created_at"),
    )


def overridden(quotas: DataFrame, live: DataFrame) -> DataFrame:
    """Stored quota rows with the counts of ``live`` (tenant_id, directory_path, live_count) where it has one, and rows that only ``live`` has, unlimited."""
    both = quotas.join(live, ["tenant_id", "directory_path"], "full")
    return both.select("tenant_id", "directory_path", F.coalesce("live_count", "current_count").alias("current_count"), F.coalesce("max_count", F.lit(0)).cast("bigint").alias("max_count"), F.coalesce("enabled", F.lit(False)).alias("enabled"))


def physical_counts(listing: DataFrame, root: Column) -> DataFrame:
    """Files on disk by tenant and recovered directory, and by tenant under its own name, whatever rows there are."""
    key = stem(F.col("path"))
    named = listing.where("presence <> 'missing'").where(F.trim(key) != "").withColumn("directory", recovered_directory(F.col("path"), root, key))
    counts = named.rollup("tenant_id", "directory").agg(F.count("*").alias("n"), F.grouping_id().alias("level")).where("level < 3")
    return counts.select("tenant_id", F.when(F.col("level") == 1, F.col("tenant_id")).otherwise(F.col("directory")).alias("directory_path"), F.col("n").alias("current_count"))


def with_limits(quotas: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Quota rows after limits (tenant_id, directory_path, new_max) are set, or taken away where new_max is null; a row that isn't there begins at 0.

    A limit of 0 is none. A tenant's row (its own name) is enabled by a limit above 0 alone; a directory's stays or becomes enabled.
    """
    both = quotas.withColumn("stored", F.lit(True)).join(changes.withColumn("changed", F.lit(True)), ["tenant_id", "directory_path"], "full").where("stored or new_max is not null")
    changed = F.coalesce("changed", F.lit(False))
    new = F.coalesce("new_max", F.lit(0))
    own = F.col("directory_path") == F.col("tenant_id")
    return both.select(
        "tenant_id", "directory_path", F.coalesce("current_count", F.lit(0)).cast("bigint").alias("current_count"), F.when(changed, new).otherwise(F.col("max_count")).cast("bigint").alias("max_count"),
        F.when(~changed, F.col("enabled")).when(own | F.col("new_max").isNull(), new > 0).otherwise(F.lit(True)).alias("enabled"), F.when(changed, now).otherwise(F.col("last_updated")).alias("last_updated"), F.coalesce("created_at", now).alias("created_at"),
    )


def can_add(quotas: DataFrame, reserved: Column | None = None) -> DataFrame:
    """Whether a directory takes one more file: unless it is limited and full with what is reserved."""
    held = F.col("current_count") + (F.lit(0) if reserved is None else reserved)
    free = ~F.col("enabled") | (F.col("max_count") == 0) | (held < F.col("max_count"))
    return quotas.select("tenant_id", "directory_path", free.alias("can_add"))


def effective_limits(tenants: DataFrame, global_limit: int) -> DataFrame:
    """A tenant's own limit where it has one, else the global one; 0 is none."""
    return tenants.select("tenant_id", F.coalesce(F.nullif("tenant_limit", F.lit(0)), F.lit(global_limit)).cast("bigint").alias("effective_limit"))


def _passing(events: DataFrame, columns: list[str], begin: tuple, step, out: str) -> DataFrame:
    """A fold of each key's events in order (seq, then ``columns``) as they pass by: a task holds a batch of them and the state of one key.

    ``step(state, values)`` gives the next state, whose fields are the columns ``out``.
    """
    kind = events.schema["key"].dataType.simpleString()
    rows = events.select("key", "seq", *columns).repartition("key").sortWithinPartitions("key", "seq", *columns).select("key", *columns)
    names = [x.split(" ")[0] for x in out.split(", ")]

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def closed(done: list, key_type) -> pa.RecordBatch:
            keys, states = zip(*done)
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), *(pa.array(c, pa.int64()) for c in zip(*states))], ["key", *names])

        key = key_type = None
        begun, state = False, begin
        for batch in batches:
            key_type, done = batch.schema.field(0).type, []
            for k, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or k != key:
                    if begun:
                        done.append((key, state))
                    key, begun, state = k, True, begin
                state = step(state, *values)
            if done:
                yield closed(done, key_type)
        if begun:
            yield closed([(key, state)], key_type)

    return rows.mapInArrow(fold, f"key {kind}, {out}")


def reservations(events: DataFrame, limit: int) -> DataFrame:
    """Final (projected, reserved, rejected) of each quota key from its events (key, seq, kind) in order.

    reserve: +1 reserved while projected + reserved is below the limit (0: always), else rejected;
    accept: turns a reservation into a projected one, or projects one without; release: takes a
    reservation, else a projected one, never below 0; delete: takes a projected one, never below 0.
    undo_accept takes a projected one back and, as undo_accept_reserved, restores the reservation;
    undo_delete projects one again. Any other kind counts as a release.
    """

    def step(state: tuple, what: str | None) -> tuple:
        projected, reserved, rejected = state
        if what == "reserve":
            if limit == 0 or projected + reserved < limit:
                return projected, reserved + 1, rejected
            return projected, reserved, rejected + 1
        if what == "accept":
            return projected + 1, max(0, reserved - 1), rejected
        if what == "delete":
            return max(0, projected - 1), reserved, rejected
        if what == "undo_delete":
            return projected + 1, reserved, rejected
        if what in ("undo_accept", "undo_accept_reserved"):
            return max(0, projected - 1), reserved + (what == "undo_accept_reserved"), rejected
        return (projected, reserved - 1, rejected) if reserved > 0 else (max(0, projected - 1), reserved, rejected)

    return _passing(events, ["kind"], (0, 0, 0), step, "projected long, reserved long, rejected long")


def counted(events: DataFrame) -> DataFrame:
    """Final (current_count, rejected) of each quota key from its events (key, seq, kind, max_count, enabled) in order.

    increment: +1 unless the quota is enabled, limited (max_count above 0) and full, then rejected; force: +1 whatever the limit; decrement: -1, never below 0.
    """

    def step(state: tuple, what: str, most: int | None, enabled: bool | None) -> tuple:
        count, rejected = state
        if what == "decrement":
            return max(0, count - 1), rejected
        if what == "increment" and enabled and most and count >= most:
            return count, rejected + 1
        return count + 1, rejected

    return _passing(events, ["kind", "max_count", "enabled"], (0, 0), step, "current_count long, rejected long")
