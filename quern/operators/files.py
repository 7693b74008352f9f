"""Rows of the file table: lookups, overlays, retention, scheduling and conditional changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.paths import dead_letter_path
from ..functions.time import retry_delay, seconds
from ..schema import ACTIVE, COMMITTED, HOT
from .running import running


def _no_time() -> Column:
    return F.lit(None).cast("timestamp_ntz")


def by_status(files: DataFrame, status: int) -> DataFrame:
    return files.where(F.col("status") == status)


def hot(files: DataFrame) -> DataFrame:
    """Rows that processing still touches."""
    return files.where(F.col("status").isin(*HOT))


def looked_up(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the ``wanted`` tenants and keys; each once, however often it is asked for."""
    return files.join(wanted.select("tenant_id", "file_key").distinct(), ["tenant_id", "file_key"], "left_semi")


def locations(files: DataFrame) -> DataFrame:
    """What a client is told of a file, with its lease (tenant, key, start) where it is in work."""
    lease = F.when(F.col("processing_start_time").isNotNull(), F.struct("tenant_id", "file_key", "processing_start_time"))
    return files.select("tenant_id", "file_key", "volume_id", "physical_path", "directory_path", "file_size", "created_at", "status", "retry_count", "last_error", "file_extension", lease.alias("lease"))


def pending_counts(files: DataFrame) -> DataFrame:
    """Pending rows of each tenant that has any rows."""
    return files.groupBy("tenant_id").agg(F.count_if(F.col("status") == 0).alias("pending"))


def writable(volumes: DataFrame, required: int = 0) -> DataFrame:
    """Healthy volumes with room, and with ``required`` bytes of it where that is above 0."""
    return volumes.where(F.col("is_healthy") & (F.col("available_space") > 0) & (F.col("available_space") >= required))


def overlaid(hot_rows: DataFrame, cold_rows: DataFrame) -> DataFrame:
    """Hot rows over cold ones of the same tenant and key, in one pass of partial maxima."""
    columns = cold_rows.columns
    both = hot_rows.select(*columns, F.lit(1).alias("layer")).unionByName(cold_rows.select(*columns, F.lit(0).alias("layer")))
    return both.groupBy("tenant_id", "file_key").agg(F.max_by(F.struct(*columns), "layer").alias("r")).select("r.*")


def page(files: DataFrame, tenant: str, skip: int, take: int) -> DataFrame:
    """A tenant's rows by creation and key from ``skip`` on, ``take`` of them."""
    if skip < 0 or take <= 0:
        raise ValueError("skip is 0 or more, take 1 or more")
    return files.where(F.col("tenant_id") == tenant).orderBy("created_at", "file_key").offset(skip).limit(take)


def latest(operations: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last operation of each key; a delete leaves no row."""
    rest = [c for c in operations.columns if c not in keys]
    last = operations.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
    return last.where(F.col("op") != "Delete")


def retained_until(files: DataFrame, status: int, column: str, cutoff: Column, excluded: DataFrame | None = None, undeleted: bool = False, most: int | None = None) -> DataFrame:
    """Rows of a status whose time in ``column`` lies before ``cutoff``, oldest first.

    ``excluded`` holds keys to leave out, ``undeleted`` asks for rows that aren't deleted yet, ``most`` is the page size.
    """
    out = files.where((F.col("status") == status) & F.col(column).isNotNull() & (F.col(column) < cutoff))
    if undeleted:
        out = out.where(F.col("delete_succeeded_at").isNull())
    if excluded is not None:
        out = out.join(excluded.select("file_key"), "file_key", "left_anti")
    return out.orderBy(column, "file_key").limit(most) if most else out


def ready(files: DataFrame, now: Column) -> DataFrame:
    return files.where((F.col("status") == 0) & (F.col("available_at").isNull() | (F.col("available_at") <= now)))


def next_pending(files: DataFrame, now: Column, k: int = 1) -> DataFrame:
    """The first ``k`` ready rows of each tenant by creation and key; the rank prunes before the shuffle."""
    order = Window.partitionBy("tenant_id").orderBy("created_at", "file_key")
    return ready(files, now).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def delayed(files: DataFrame, now: Column, most: int) -> DataFrame:
    """Pending rows that wait for their time, soonest first; a page of them."""
    return files.where((F.col("status") == 0) & (F.col("available_at") > now)).orderBy("available_at", "created_at", "file_key").limit(most)


def failed_once_more(files: DataFrame, now: Column, max_retry: int = 3, initial: float = 5.0, most: float = 300.0) -> DataFrame:
    """Processing rows after a failure: pending again with a delay, or permanently failed at ``max_retry``."""
    retry = F.col("retry_count") + 1
    dead = retry >= max_retry
    return (
        files.where("status = 1")
        .withColumn("available_at", F.when(~dead, now + seconds(retry_delay(retry, initial, most))))
        .withColumn("status", F.when(dead, F.lit(4)).otherwise(F.lit(0)))
        .withColumn("retry_count", retry.cast("int"))
        .withColumn("last_failed_at", now)
        .withColumn("released_lease", F.col("processing_start_time"))
        .withColumn("processing_start_time", _no_time())
    )


def timed_out(files: DataFrame, now: Column, timeout: int, most: int | None = None) -> DataFrame:
    """Processing rows whose lease is older than ``timeout`` seconds, oldest first and at most ``most`` of them, as pending ones from ``now`` on."""
    late = files.where((F.col("status") == 1) & (F.col("processing_start_time") < now - seconds(timeout)))
    late = late.orderBy("processing_start_time", "file_key").limit(most) if most else late
    return late.withColumns({"released_lease": F.col("processing_start_time"), "status": F.lit(0), "available_at": now, "processing_start_time": _no_time()})


def timed_out_by_tenant(files: DataFrame, now: Column, timeout: int, batch: int) -> DataFrame:
    """``timed_out`` rows with the number of the batch of their tenant, ``batch`` rows each from the oldest on: all batches until a short one."""
    late = files.where((F.col("status") == 1) & (F.col("processing_start_time") < now - seconds(timeout))).withColumn("_at", F.unix_micros(F.col("processing_start_time").cast("timestamp")))
    placed = running(late.withColumn("_one", F.lit(1)), ["tenant_id"], "_at", "_one", "sum", "_before", size=86_400_000_000)
    reset = timed_out(placed, now, timeout)
    return reset.withColumn("batch", F.floor(F.col("_before") / batch)).drop("_at", "_one", "_before")


def leased_next(files: DataFrame, now: Column, k: int = 1) -> DataFrame:
    """The first ``k`` ready rows of each tenant, leased: processing from ``now`` on. What they waited for stays in available_at."""
    taken = next_pending(files, now, k).drop("rank")
    return taken.withColumns({"status": F.lit(1), "processing_start_time": now, "released_lease": _no_time()})


def leased_after_reclaim(files: DataFrame, now: Column, timeout: int, k: int = 1, reclaim: int = 100) -> DataFrame:
    """``leased_next``; where a tenant has nothing ready, up to ``reclaim`` of its timed-out rows, oldest first, are made pending and leased from."""
    first = leased_next(files, now, k)
    idle = files.select("tenant_id").distinct().join(first.select("tenant_id").distinct(), "tenant_id", "left_anti")
    late = files.join(idle, "tenant_id", "left_semi").where((F.col("status") == 1) & (F.col("processing_start_time") < now - seconds(timeout)))
    oldest = Window.partitionBy("tenant_id").orderBy("processing_start_time", "file_key")
    reclaimed = timed_out(late.withColumn("_place", F.row_number().over(oldest)).where(F.col("_place") <= reclaim).drop("_place"), now, timeout)
    return first.unionByName(leased_next(reclaimed, now, k).select(first.columns))


def first_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``: what a list that names a file twice counts once."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def lease_result(files: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands (tenant_id, file_key, kind, lease) against their rows: ``applied``, ``late``, ``idempotent`` or ``mismatch``.

    A completion of a row that is gone or completed already is done (idempotent); one under a lease that a
    failure or timeout has released is taken late. A failure is idempotent only under the very lease that
    was completed or released; under any other, or of a row that is gone, it is a mismatch.
    """
    row = files.select("tenant_id", "file_key", "status", "processing_start_time", "last_failed_at", "available_at", "last_error", "released_lease")
    out = commands.join(row, ["tenant_id", "file_key"], "left")
    none = F.col("processing_start_time").isNull()
    released = none & F.coalesce(F.col("released_lease") == F.col("lease"), F.lit(False))
    touched = F.col("last_failed_at").isNotNull() | F.col("available_at").isNotNull() | (F.coalesce("last_error", F.lit("")) != "")
    complete = F.col("kind") == "complete"
    result = (
        F.when(F.col("status").isNull(), F.when(complete, "idempotent").otherwise("mismatch"))
        .when(F.col("status").isin(*COMMITTED), F.when(complete | released, "idempotent").otherwise("mismatch"))
        .when(complete & released & ((F.col("status").isin(4, 7)) | ((F.col("status") == 0) & touched)), F.lit("late"))
        .when(~complete & released & F.col("status").isin(0, 4, 7), F.lit("idempotent"))
        .when((F.col("status") == 1) & F.coalesce(F.col("processing_start_time") == F.col("lease"), F.lit(False)), F.lit("applied"))
        .otherwise(F.lit("mismatch"))
    )
    return out.select("tenant_id", "file_key", "kind", "lease", result.alias("result"))


def completed(files: DataFrame, commands: DataFrame, now: Column) -> DataFrame:
    """The rows that completions (as for ``lease_result``) complete, those under a released lease included."""
    done = lease_result(files, commands.where("kind = 'complete'")).where("result in ('applied', 'late')").select("tenant_id", "file_key", "lease")
    rows = files.join(first_of_each(done, ["tenant_id", "file_key"], "lease"), ["tenant_id", "file_key"])
    cleared = dict.fromkeys(("processing_start_time", "available_at", "delete_succeeded_at", "dead_lettered_at"), _no_time())
    return rows.withColumns({"status": F.lit(2), "completed_at": now, "last_error": F.lit(None).cast("string"), "released_lease": F.col("lease"), **cleared}).drop("lease")


def completion_events(completed_rows: DataFrame, now: Column) -> DataFrame:
    """The two journal events of each completion, Completed and DeleteRequested, of one time."""
    both = completed_rows.withColumn("event_type", F.explode(F.array(F.lit(4), F.lit(5))))
    return both.select("tenant_id", "file_key", "event_type", now.alias("occurred_at"), F.when(F.col("event_type") == 4, F.col("released_lease")).alias("processing_start_time"))


def compare_and_set(files: DataFrame, commands: DataFrame, expected: list[str]) -> tuple[DataFrame, DataFrame]:
    """Splits ``commands`` (tenant_id, file_key, expected_<column> for each of ``expected``) into applied and rejected.

    Of several commands for a row the one of the lowest ``ordinal`` counts; the others are rejected.
    """
    first = commands.groupBy("tenant_id", "file_key").agg(F.min("ordinal").alias("first"))
    joined = commands.join(first, ["tenant_id", "file_key"]).join(files.select("tenant_id", "file_key", *expected), ["tenant_id", "file_key"], "left")
    holds = F.col("ordinal") == F.col("first")
    for c in expected:
        holds = holds & F.coalesce(F.col(c) == F.col(f"expected_{c}"), F.lit(False))
    return joined.where(holds).select(commands.columns), joined.where(~holds).select(commands.columns)


def upserted(files: DataFrame, changes: DataFrame) -> DataFrame:
    """``files`` with the rows of ``changes`` in place of those of their keys."""
    return overlaid(changes, files)


def removed(files: DataFrame, keys: DataFrame) -> DataFrame:
    return files.join(keys.select("tenant_id", "file_key"), ["tenant_id", "file_key"], "left_anti")


def cleanup_batch(files: DataFrame, cutoff: Column, most: int) -> DataFrame:
    """Rows to clean up next: requested deletions first, then completed rows, each oldest first."""
    rows = files.where(F.col("status").isin(2, 5) & F.col("delete_succeeded_at").isNull() & (F.col("completed_at") < cutoff))
    return rows.withColumn("priority", F.when(F.col("status") == 5, 0).otherwise(1)).orderBy("priority", "completed_at", "file_key").limit(most)


def dispositions(files: DataFrame, presence: DataFrame, retired: DataFrame, cutoff: Column) -> DataFrame:
    """What cleanup does with each due row: delete, purge_metadata, converge, or blocked with a reason.

    ``presence`` tells of paths whether the file is present, missing or unknown; ``retired`` lists volumes
    that are gone and whether their rows are kept (0) or purged (1).
    """
    due = files.where(F.col("status").isin(2, 5) & F.col("delete_succeeded_at").isNull() & (F.col("completed_at") < cutoff))
    seen = presence.select(F.col("tenant_id"), F.col("path").alias("physical_path"), "presence")
    out = due.join(retired, "volume_id", "left").join(seen, ["tenant_id", "physical_path"], "left")
    action = (
        F.when(F.col("disposition") == 1, "purge_metadata").when(F.col("disposition") == 0, "blocked: volume kept")
        .when(F.col("presence") == "unknown", "blocked: presence unknown").when(F.col("presence").isNull() | (F.col("presence") == "missing"), "converge").otherwise("delete")
    )
    return out.select("tenant_id", "file_key", "volume_id", "status", "file_size", action.alias("action"))


def failed_dispositions(files: DataFrame, presence: DataFrame, volumes: DataFrame, retired: DataFrame, cutoff: Column, disposition: str, day: Column, depth: int = 2) -> DataFrame:
    """What cleanup does with each permanently failed row older than ``cutoff``: action, target_path, next_status and bytes_freed.

    ``disposition`` is ``keep`` (nothing is done), ``delete`` or ``dead_letter``. A file whose presence isn't
    known (no access, or its volume is gone) is blocked, unless its volume is retired with rows to purge:
    then the row alone goes. A row on a volume that isn't registered is blocked. A missing file frees
    nothing and is dead-lettered where it is.
    """
    due = files.where((F.col("status") == 4) & (F.col("last_failed_at") < cutoff))
    seen = presence.select("tenant_id", F.col("path").alias("physical_path"), "presence")
    mounted = volumes.select("volume_id", "mount_path")
    out = due.join(seen, ["tenant_id", "physical_path"], "left").join(retired, "volume_id", "left").join(mounted, "volume_id", "left")
    there, known = F.col("presence") == "present", F.col("mount_path").isNotNull()
    unknown = (F.col("presence") == "unknown") | (F.col("presence").isNull() & ~known)
    act = {"keep": "blocked: kept", "delete": "delete", "dead_letter": "dead_letter"}[disposition]
    action = F.when(unknown, F.when(F.col("disposition") == 1, "purge_metadata").otherwise("blocked: presence unknown")).when(~known, "blocked: no volume").otherwise(act)
    out = out.withColumn("action", action)
    moved = dead_letter_path(F.concat("mount_path", F.lit("/.deadletter")), F.col("tenant_id"), day, F.col("file_key"), F.col("file_extension"), depth)
    target = F.when(F.col("action") == "dead_letter", F.when(there, moved).otherwise(F.col("physical_path")))
    status = F.when(F.col("action").isin("delete", "purge_metadata"), 6).when(F.col("action") == "dead_letter", 7).otherwise(F.col("status"))
    freed = F.when((F.col("action") == "delete") & there, F.col("file_size")).otherwise(F.lit(0).cast("bigint"))
    return out.select("tenant_id", "file_key", "volume_id", "action", target.alias("target_path"), status.cast("int").alias("next_status"), freed.alias("bytes_freed"))


def status_cleanup(files: DataFrame, actions: DataFrame | None, now: Column, timeout: int | None) -> DataFrame:
    """The combined cleanup as one set of changes: timed-out rows reset (``timeout`` seconds, None for none) and what ``actions`` (``failed_dispositions``) do."""
    nothing = files.where("false").select("tenant_id", "file_key", F.lit("reset").alias("action"), F.lit(0).alias("next_status"), F.lit(0).cast("bigint").alias("bytes_freed"))
    reset = nothing if timeout is None else timed_out(files, now, timeout).select("tenant_id", "file_key", F.lit("reset").alias("action"), "status", F.lit(0).cast("bigint").alias("bytes_freed")).withColumnRenamed("status", "next_status")
    done = nothing if actions is None else actions.where("action not like 'blocked%'").select("tenant_id", "file_key", "action", "next_status", "bytes_freed")
    return reset.unionByName(done)


#: Volumes that a batch of choices names before it is handed on, about.
CHOSEN = 1 << 18


def volume_choice(volumes: DataFrame, requests: DataFrame, separator: str | None = None) -> DataFrame:
    """For each request (request_id, ticket, size) the volumes to try in order, null where none takes it.

    Two of the healthy volumes with room, in order of their ids, come first: the ticket picks one, the
    ticket's next number another one, and the one with more space leads (the first of equals). The others
    follow. A row of the result names every volume, so each task holds them all, and no more rows at a time
    than name CHOSEN volumes. With a ``separator`` the volumes are one text; null ids have no part in it.

    A task's requests come by size, so that those with the same volumes share them, and their text is cut
    from that of all of them.
    """
    every = volumes.where("is_healthy and available_space > 0").select("volume_id", F.col("available_space").cast("long")).orderBy("volume_id", "available_space").toArrow()
    shared = requests.sparkSession.sparkContext.broadcast((every["volume_id"].combine_chunks(), every["available_space"].to_numpy()))

    def choose(batches):
        import numpy as np
        import pyarrow as pa

        ids, space = shared.value
        ordered = np.sort(space)
        fit = np.arange(len(space))
        if separator is not None:
            names = np.array([b"" if x is None else (separator + x).encode() for x in ids.to_pylist()], dtype=object)
            skipped = len(separator.encode())
        text, ends = None, []

        def lists(sizes, chosen):
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32(), mask=np.array([*(s == 0 for s in sizes), False])), ids.take(pa.array(np.concatenate(chosen))))

        def texts(sizes, chosen):
            ends = np.cumsum([0, *(len(x) for x in chosen)], dtype=np.int32)
            valid = pa.array([s > 0 for s in sizes], pa.bool_()).buffers()[1]
            return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(b"".join(chosen)), valid)

        for batch in batches:
            first, named, sizes, chosen = 0, 0, [], []
            for row, (ticket, size) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()), 1):
                n = 0 if ticket is None or size is None else len(space) - int(np.searchsorted(ordered, size))
                if n != len(fit):
                    fit, text = np.flatnonzero(space >= size) if n else np.arange(0), None
                sizes.append(n)
                named += n
                lead, rest = [], [(0, n)]
                if n > 1:
                    # The generator's multiplier and increment, modulo 2^32.
                    i, j = ticket % n, (ticket * 1103515245 + 12345) % (1 << 32) % n
                    j = (j + 1) % n if j == i else j
                    low, high = min(i, j), max(i, j)
                    lead, rest = [i, j] if space[fit[i]] >= space[fit[j]] else [j, i], [(0, low), (low + 1, high), (high + 1, n)]
                if separator is None:
                    chosen += [fit[lead], *(fit[begin:end] for begin, end in rest)]
                else:
                    if text is None:
                        own = names[fit]
                        text = memoryview(b"".join(own.tolist()))
                        ends = np.cumsum([0, *map(len, own)]).tolist()
                    parts = [text[ends[begin] : ends[end]] for begin, end in (*((k, k + 1) for k in lead), *rest)]
                    chosen.append(memoryview(b"".join(parts))[skipped:])
                if row == batch.num_rows or named >= CHOSEN:
                    yield pa.RecordBatch.from_arrays([batch.column(0)[first:row], lists(sizes, chosen) if separator is None else texts(sizes, chosen)], ["request_id", "volume_ids"])
                    first, named, sizes, chosen = row, 0, [], []

    # Few bytes of requests become many of results: dealt out, as their splits are too few.
    rows = requests.select("request_id", F.col("ticket").cast("long"), F.ceil("size").cast("long").alias("size")).repartition(4 * requests.sparkSession.sparkContext.defaultParallelism).sortWithinPartitions("size")
    return rows.mapInArrow(choose, StructType([requests.schema["request_id"], StructField("volume_ids", StringType() if separator is not None else ArrayType(StringType()))]))


def status_counts(files: DataFrame) -> DataFrame:
    """Rows, bytes and active rows by tenant and status."""
    return files.groupBy("tenant_id", "status").agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes"), F.count_if(F.col("status").isin(*ACTIVE)).alias("active"))
