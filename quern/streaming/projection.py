"""The projection fold as a stateful stream: one state per file, changed event by event."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from ..functions.paths import normalized_directory
from ..operators.projection import EVENT_COLUMNS, ROW

_TYPES = {k: v.format(t="timestamp_ntz", s="string") for k, v in ROW.items()}
STATE = "alive boolean, " + ", ".join(f"{k} {v}" for k, v in _TYPES.items())
OUTPUT = "tenant_id string, file_key string, " + STATE


def apply_event(row: dict | None, e: dict) -> dict | None:
    """The row after an event; None where there is none."""
    kind, at = e["event_type"], e["occurred_at"]
    lease = e["processing_start_time"] or at
    newest = lambda column, than: row[column] is not None and row[column] >= than
    if row is None:
        if kind == 6 or not (e["physical_path"] or "").strip() or not e["physical_present"]:
            return None
        status = e["status"] if e["status"] is not None else {2: 1, 4: 2, 5: 5, 8: 7}.get(kind, 0)
        row = dict.fromkeys(ROW) | {
            "status": status, "processing_start_time": e["processing_start_time"], "available_at": e["available_at"], "retry_count": e["retry_count"] or 0, "last_failed_at": at if kind == 3 else None,
            "completed_at": at if kind in (4, 5) or e["status"] in (2, 5, 6) else None, "dead_lettered_at": at if kind == 8 or e["status"] == 7 else None, "last_error": e["error_message"],
            "physical_path": e["physical_path"], "volume_id": e["volume_id"] or "", "directory_path": e["directory"], "file_size": e["file_size"] or 0, "created_at": at, "accepted_applied": True, "dead_letter_applied": False,
            "delete_succeeded_at": at if e["status"] == 6 else None,
        }
        if kind == 5:
            return row
    if kind == 1:
        return row | {"accepted_applied": True}
    if kind == 6:
        return None
    idle = {"processing_start_time": None, "available_at": None, "dead_lettered_at": None, "delete_succeeded_at": None, "dead_letter_applied": False}
    stale = (row["processing_start_time"] is not None and row["processing_start_time"] > lease) or newest("last_failed_at", at) or newest("completed_at", at)
    released = {"released_lease": e["processing_start_time"] or row["released_lease"]}
    if kind == 2:
        if newest("processing_start_time", lease) or newest("last_failed_at", lease) or newest("completed_at", lease):
            return row
        return row | idle | {"status": 1, "processing_start_time": lease, "completed_at": None, "last_error": e["error_message"] or row["last_error"], "released_lease": None}
    if kind == 3 and not stale:
        status = e["status"] or 0
        retry = row["retry_count"] if e["retry_count"] is None else e["retry_count"]
        return row | idle | released | {"status": status, "completed_at": None, "retry_count": retry, "last_failed_at": at, "last_error": e["error_message"], "available_at": None if status else e["available_at"]}
    if kind == 4 and not stale:
        return row | idle | {"status": 2, "completed_at": at, "last_error": None, "released_lease": e["processing_start_time"]}
    if kind == 5 and not (row["status"] == 5 and row["completed_at"] and not row["processing_start_time"] and not row["available_at"] and not row["last_error"]):
        return row | idle | {"status": 5, "completed_at": row["completed_at"] or at, "last_error": None}
    if kind == 7 and row["status"] == 1 and row["processing_start_time"] and not stale:
        return row | idle | released | {"status": 0, "completed_at": None, "available_at": e["available_at"] or at}
    if kind == 8 and not (row["dead_letter_applied"] and row["status"] == 7 and newest("dead_lettered_at", at)):
        path, volume = e["physical_path"] if e["physical_path"] is not None else row["physical_path"], e["volume_id"] if e["volume_id"] is not None else row["volume_id"]
        return row | idle | {"status": 7, "completed_at": None, "dead_lettered_at": at, "physical_path": path, "volume_id": volume, "dead_letter_applied": True}
    return row


def projected_stream(journal: DataFrame) -> DataFrame:
    """A stream of rows as they change, with ``alive`` false where a file is gone; to be upserted by tenant and key.

    Events of a file are applied in order of their numbers within a micro-batch; batches must follow the journal.
    """
    events = journal.withColumn("directory", normalized_directory(F.col("directory_path"))).select("tenant_id", "file_key", *EVENT_COLUMNS)

    def step(key: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        plain = lambda v: None if pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v
        row = None
        if state.exists:
            old = dict(zip(["alive", *ROW], state.get))
            row = {k: plain(old[k]) for k in ROW} if old["alive"] else None
        for e in pd.concat(list(batches)).sort_values("sequence_number", kind="stable").to_dict("records"):
            row = apply_event(row, {k: plain(v) for k, v in e.items()})
        alive = row is not None
        new = [alive, *((row or dict.fromkeys(ROW))[k] for k in ROW)]
        state.update(tuple(new))
        frame = pd.DataFrame([[*key, *new]], columns=["tenant_id", "file_key", "alive", *ROW])
        yield frame.astype({k: "Int64" for k, v in _TYPES.items() if v in ("int", "bigint")} | {k: "datetime64[us]" for k, v in _TYPES.items() if v.startswith("timestamp")} | {k: "boolean" for k, v in _TYPES.items() if v == "boolean"})

    return events.groupBy("tenant_id", "file_key").applyInPandasWithState(step, OUTPUT, STATE, "update", "NoTimeout")
