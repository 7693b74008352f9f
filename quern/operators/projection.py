"""The ordered fold of a journal into rows, quota counts and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.paths import normalized_directory
from .running import floored_totals, running

# A row's columns in the fold and their types; what a file that isn't there has is null.
ROW = {
    "status": "int", "processing_start_time": "timestamp_ntz", "available_at": "timestamp_ntz", "retry_count": "int", "last_failed_at": "timestamp_ntz", "completed_at": "timestamp_ntz", "dead_lettered_at": "timestamp_ntz",
    "last_error": "string", "physical_path": "string", "volume_id": "string", "directory_path": "string", "file_size": "bigint", "created_at": "timestamp_ntz", "released_lease": "timestamp_ntz",
    "delete_succeeded_at": "timestamp_ntz", "accepted_applied": "boolean", "dead_letter_applied": "boolean",
}
EVENT_COLUMNS = ["sequence_number", "event_type", "occurred_at", "volume_id", "physical_path", "directory", "file_size", "status", "processing_start_time", "retry_count", "available_at", "error_message", "physical_present"]


EMPTY_DELTAS = "cast(array() as array<struct<seq:bigint,directory:string,d:int>>)"


def _struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _null(kind: str) -> str:
    return f"cast(null as {kind})"


def empty_state() -> str:
    return _struct({"alive": "false", "fresh": "false"} | {k: _null(v) for k, v in ROW.items()} | {"deferred_at": _null("bigint"), "deltas": EMPTY_DELTAS})


def birth_step() -> str:
    """A row for a file that has none, from any event but its deletion, if its path is given and the file is there.

    An Accepted event for a row that hasn't counted yet counts it. ``s`` is the state and ``e`` the event. Where
    it isn't known whether the file is there (null), no row is made and the first such event is kept in deferred_at.
    """
    asked = "(not s.alive and e.event_type <> 6 and trim(coalesce(e.physical_path, '')) <> '')"
    born = f"({asked} and coalesce(e.physical_present, false))"
    counted = "(s.alive and e.event_type = 1 and not s.accepted_applied)"
    fallback = "CASE e.event_type WHEN 2 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 5 WHEN 8 THEN 7 ELSE 0 END"
    value = {
        "status": f"coalesce(e.status, {fallback})", "processing_start_time": "e.processing_start_time", "available_at": "e.available_at", "retry_count": "coalesce(e.retry_count, 0)",
        "last_failed_at": "CASE WHEN e.event_type = 3 THEN e.occurred_at END", "completed_at": "CASE WHEN e.event_type in (4, 5) or e.status in (2, 5, 6) THEN e.occurred_at END",
        "dead_lettered_at": "CASE WHEN e.event_type = 8 or e.status = 7 THEN e.occurred_at END", "last_error": "e.error_message", "physical_path": "e.physical_path",
        "volume_id": "coalesce(e.volume_id, '')", "directory_path": "e.directory", "file_size": "coalesce(e.file_size, 0)", "created_at": "e.occurred_at",
        "released_lease": _null("timestamp_ntz"), "delete_succeeded_at": "CASE WHEN e.status = 6 THEN e.occurred_at END", "accepted_applied": "true", "dead_letter_applied": "false",
    }
    delta = lambda where: f"array_append(s.deltas, {_struct({'seq': 'e.sequence_number', 'directory': where, 'd': '1'})})"
    out = {"alive": f"s.alive or {born}", "fresh": born} | {k: f"CASE WHEN {born} THEN {v} ELSE s.{k} END" for k, v in value.items()}
    out["accepted_applied"] = f"CASE WHEN {born} or {counted} THEN true ELSE s.accepted_applied END"
    out["deferred_at"] = f"CASE WHEN {asked} and e.physical_present is null THEN coalesce(s.deferred_at, e.sequence_number) ELSE s.deferred_at END"
    out["deltas"] = f"CASE WHEN {born} THEN {delta('e.directory')} WHEN {counted} THEN {delta('s.directory_path')} ELSE s.deltas END"
    return _struct(out)


def change_step() -> str:
    """What an event does to a row that is there, unless it is stale. A row that this event has given birth to is one, too.

    Only a delete request leaves a row alone that it has just made.
    """
    lease = "coalesce(e.processing_start_time, e.occurred_at)"
    # Comparisons with null aren't true: nothing is stale against a time that isn't set.
    late = lambda column, op, than: f"coalesce(s.{column} {op} {than}, false)"
    after = f"({late('processing_start_time', '>', lease)} or {late('last_failed_at', '>=', 'e.occurred_at')} or {late('completed_at', '>=', 'e.occurred_at')})"
    started = f"not ({late('processing_start_time', '>=', lease)} or {late('last_failed_at', '>=', lease)} or {late('completed_at', '>=', lease)})"
    settled = "(s.status = 5 and s.completed_at is not null and s.processing_start_time is null and s.available_at is null and coalesce(s.last_error, '') = '')"
    buried = f"(s.dead_letter_applied and s.status = 7 and {late('dead_lettered_at', '>=', 'e.occurred_at')})"
    on = {
        2: f"e.event_type = 2 and {started}",
        3: f"e.event_type = 3 and not {after}",
        4: f"e.event_type = 4 and not {after}",
        5: f"e.event_type = 5 and not {settled} and not s.fresh",
        6: "e.event_type = 6",
        7: f"e.event_type = 7 and s.status = 1 and s.processing_start_time is not null and not {after}",
        8: f"e.event_type = 8 and not {buried}",
    }
    when = lambda column, cases: f"CASE {' '.join(f'WHEN s.alive and {on[k]} THEN {v}' for k, v in cases.items())} ELSE s.{column} END"
    null_time, null_text = _null("timestamp_ntz"), _null("string")
    released = "coalesce(e.processing_start_time, s.released_lease)"
    gone = f"s.alive and {on[6]}"
    out = {
        "status": when("status", {2: "1", 3: "coalesce(e.status, 0)", 4: "2", 5: "5", 7: "0", 8: "7"}),
        "processing_start_time": when("processing_start_time", {2: lease, 3: null_time, 4: null_time, 5: null_time, 7: null_time, 8: null_time}),
        "available_at": when("available_at", {2: null_time, 3: f"CASE WHEN coalesce(e.status, 0) = 0 THEN e.available_at ELSE {null_time} END", 4: null_time, 5: null_time, 7: "coalesce(e.available_at, e.occurred_at)", 8: null_time}),
        "retry_count": when("retry_count", {3: "coalesce(e.retry_count, s.retry_count)"}),
        "last_failed_at": when("last_failed_at", {3: "e.occurred_at"}),
        "completed_at": when("completed_at", {2: null_time, 3: null_time, 4: "e.occurred_at", 5: "coalesce(s.completed_at, e.occurred_at)", 7: null_time, 8: null_time}),
        "dead_lettered_at": when("dead_lettered_at", {2: null_time, 3: null_time, 4: null_time, 5: null_time, 7: null_time, 8: "e.occurred_at"}),
        "last_error": when("last_error", {2: "coalesce(e.error_message, s.last_error)", 3: "e.error_message", 4: null_text, 5: null_text}),
        "physical_path": when("physical_path", {8: "coalesce(e.physical_path, s.physical_path)"}),
        "volume_id": when("volume_id", {8: "coalesce(e.volume_id, s.volume_id)"}),
        "released_lease": when("released_lease", {2: null_time, 3: released, 4: "e.processing_start_time", 7: released}),
        "delete_succeeded_at": when("delete_succeeded_at", dict.fromkeys((2, 3, 4, 5, 7, 8), null_time)),
        "dead_letter_applied": when("dead_letter_applied", {2: "false", 3: "false", 4: "false", 5: "false", 7: "false", 8: "true"}),
    }
    out = {k: out.get(k, f"s.{k}") for k in ROW}
    minus = f"array_append(s.deltas, {_struct({'seq': 'e.sequence_number', 'directory': 's.directory_path', 'd': '-1'})})"
    cleared = {k: f"CASE WHEN {gone} THEN {_null(kind)} ELSE {out[k]} END" for k, kind in ROW.items()}
    return _struct({"alive": f"s.alive and not ({on[6]})", "fresh": "false"} | cleared | {"deferred_at": "s.deferred_at", "deltas": f"CASE WHEN {gone} or (s.alive and {on[8]}) THEN {minus} ELSE s.deltas END"})


def fold(events: str = "events", start: str | None = None) -> str:
    """The fold of ``events``, an array in order with each event twice: to give birth (phase 0), then to change (phase 1).

    ``s.fresh`` says that the same event has given birth just before.
    """
    return f"aggregate({events}, {start or empty_state()}, (s, e) -> CASE WHEN e.phase = 0 THEN {birth_step()} ELSE {change_step()} END)"


def prepared(journal: DataFrame) -> DataFrame:
    """Events with their normalised directory, twice each, ready for the fold."""
    return journal.withColumn("directory", normalized_directory(F.col("directory_path"))).withColumn("phase", F.explode(F.array(F.lit(0), F.lit(1))))


def folded(journal: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """Final state of each (tenant_id, file_key): ``state`` with ``alive``, the row's columns and its quota ``deltas``.

    One shuffle by tenant and file; a task holds the events of one file at a time. ``snapshot``, an earlier
    result of this function, is where the fold goes on from (then ``deltas`` are those since).
    """
    item = F.struct("sequence_number", "phase", *EVENT_COLUMNS[1:])
    grouped = prepared(journal).groupBy("tenant_id", "file_key").agg(F.array_sort(F.collect_list(item)).alias("events"))
    if snapshot is None:
        return grouped.select("tenant_id", "file_key", F.expr(fold()).alias("state"))
    before = snapshot.select("tenant_id", "file_key", F.col("state").alias("before"))
    joined = grouped.join(before, ["tenant_id", "file_key"], "full")
    names = ["alive", "fresh", *ROW]
    start = _struct({k: f"before.{k}" for k in names} | {"deferred_at": _null("bigint"), "deltas": EMPTY_DELTAS})
    start = f"CASE WHEN before is null THEN {empty_state()} ELSE {start} END"
    events = F.coalesce("events", F.array().cast(grouped.schema["events"].dataType))
    return joined.withColumn("events", events).select("tenant_id", "file_key", F.expr(fold(start=start)).alias("state"))


def projected_files(journal: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """The rows that the journal leaves, one per file that is there."""
    return folded(journal, snapshot).where("state.alive").select("tenant_id", "file_key", *[F.col(f"state.{k}").alias(k) for k in ROW])


def quota_counts(journal: DataFrame) -> DataFrame:
    """Counts of each tenant's directories, and of the tenant itself under its own name, by the events' steps in order.

    A count never falls below 0, so order matters; it is composed over chunks of the sequence (``floored_totals``).
    """
    steps = folded(journal).select("tenant_id", F.explode("state.deltas").alias("x")).select("tenant_id", "x.seq", F.col("x.directory").alias("directory_path"), "x.d")
    both = steps.unionByName(steps.withColumn("directory_path", F.col("tenant_id")))
    return floored_totals(both, ["tenant_id", "directory_path"], "seq", "d", "current_count")


def sequence_gaps(journal: DataFrame) -> DataFrame:
    """Each step over missing numbers: tenant_id, expected_sequence, observed_sequence. The running maximum never falls."""
    known = journal.where("sequence_number > 0").select("tenant_id", "sequence_number")
    last = running(known, ["tenant_id"], "sequence_number", "sequence_number", "max", "last")
    return last.where("last > 0 and sequence_number > last + 1").select("tenant_id", (F.col("last") + 1).alias("expected_sequence"), F.col("sequence_number").alias("observed_sequence"))


def deferred(journal: DataFrame, batch: int = 64) -> DataFrame:
    """Per tenant whose replay has to wait: deferred_at (sequence number of the first event that would make a row of a
    file of unknown presence) and applied_until, the last number before the batch of ``batch`` records that holds it.

    The whole batch waits, so the cursor stays before it; 0 if that is the first one.
    """
    first = folded(journal).where("state.deferred_at is not null").groupBy("tenant_id").agg(F.min("state.deferred_at").alias("deferred_at"))
    placed = running(journal.select("tenant_id", "sequence_number", F.lit(1).alias("one")), ["tenant_id"], "sequence_number", "one", "sum", "place")
    named = placed.join(first, "tenant_id").withColumn("batch", F.floor(F.col("place") / batch))
    held = named.where("sequence_number = deferred_at").groupBy("tenant_id").agg(F.min("batch").alias("held"))
    before = named.join(held, "tenant_id").where("batch < held").groupBy("tenant_id").agg(F.max("sequence_number").alias("applied_until"))
    return first.join(before, "tenant_id", "left").select("tenant_id", "deferred_at", F.coalesce("applied_until", F.lit(0)).cast("bigint").alias("applied_until"))


def projected_until_deferred(journal: DataFrame, batch: int = 64) -> DataFrame:
    """``projected_files`` of what can be applied: a tenant's events up to the batch that has to wait."""
    waiting = deferred(journal, batch).select("tenant_id", "applied_until")
    ready = journal.join(waiting, "tenant_id", "left").where("applied_until is null or sequence_number <= applied_until")
    return projected_files(ready.drop("applied_until"))


def rebuilt(journal: DataFrame, snapshot: DataFrame | None, cursor: int, quotas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A tenant table made anew: rows of the snapshot with the journal's tail behind ``cursor``, and what to do with each quota row.

    Rows that neither has are gone; quotas are reconciled with the rows.
    """
    from .quota import reconciled

    files = projected_files(journal.where(F.col("sequence_number") > cursor) if snapshot is not None else journal, snapshot)
    return files, reconciled(files, quotas)


def tenant_state(journal: DataFrame, cursor_sequence: int) -> DataFrame:
    """Per tenant where its projection stands: cursor, tail, lag and the latest gap before the cursor."""
    gaps = sequence_gaps(journal.where(F.col("sequence_number") <= cursor_sequence)).groupBy("tenant_id").agg(F.max_by("expected_sequence", "observed_sequence").alias("gap_expected"), F.max("observed_sequence").alias("gap_observed"))
    tails = journal.groupBy("tenant_id").agg(F.max("sequence_number").alias("tail_sequence"), F.max(F.when(F.col("sequence_number") <= cursor_sequence, F.col("sequence_number"))).alias("last_projected"))
    return tails.join(gaps, "tenant_id", "left").select("tenant_id", "tail_sequence", "last_projected", F.greatest(F.lit(0), F.col("tail_sequence") - F.coalesce("last_projected", F.lit(0))).alias("lag"), F.col("gap_observed").isNotNull().alias("gap_detected"), "gap_expected", "gap_observed")
