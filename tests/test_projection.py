"""The fold of events, in a batch and as a stream, on small lives of files."""

from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from quern.operators import projection as pj
from quern.streaming.projection import apply_event, projected_stream

T0 = datetime(2024, 5, 1, 12)
SCHEMA = (
    "tenant_id string, file_key string, sequence_number long, event_type int, occurred_at timestamp_ntz, volume_id string, physical_path string, directory_path string, file_size long, status int, "
    "processing_start_time timestamp_ntz, retry_count int, available_at timestamp_ntz, error_message string, physical_present boolean"
)
COLUMNS = [c.split(" ")[0] for c in SCHEMA.split(", ")]


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def event(kind, seconds, key="f", **more):
    row = dict.fromkeys(COLUMNS) | {"tenant_id": "t", "file_key": key, "event_type": kind, "occurred_at": at(seconds), "physical_path": f"/m/t/{key}", "directory_path": "/incoming", "file_size": 4, "physical_present": True}
    return row | more


def journal(spark, events):
    rows = [e | {"sequence_number": e["sequence_number"] or i} for i, e in enumerate(events, 1)]
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], SCHEMA)


def fold(spark, *events):
    j = journal(spark, events)
    rows = {r.file_key: r for r in pj.projected_files(j).collect()}
    counts = {r.directory_path: r.current_count for r in pj.quota_counts(j).collect()}
    state = {}
    for e in j.withColumn("directory", F.lit("/incoming")).collect():
        state[e.file_key] = apply_event(state.get(e.file_key), e.asDict())
    assert {k: v for k, v in state.items() if v} == {k: {c: r[c] for c in pj.ROW} for k, r in rows.items()}
    return rows.get("f"), counts


def test_accepted_only(spark):
    row, counts = fold(spark, event(1, 0))
    assert (row.status, row.directory_path, row.accepted_applied) == (0, "/incoming", True)
    assert counts == {"/incoming": 1, "t": 1}


def test_whole_life_leaves_nothing(spark):
    row, counts = fold(
        spark, event(1, 0), event(2, 1, processing_start_time=at(1)), event(3, 2, processing_start_time=at(1), retry_count=1, available_at=at(7)), event(2, 8, processing_start_time=at(8)),
        event(4, 9, processing_start_time=at(8)), event(5, 9), event(6, 10),
    )
    assert row is None
    assert counts == {"/incoming": 0, "t": 0}


def test_stale_failure_leaves_the_new_lease(spark):
    failed = event(3, -15, processing_start_time=at(-20), retry_count=1)
    row, _ = fold(spark, event(1, -30), event(2, -20, processing_start_time=at(-20)), failed, event(2, -5, processing_start_time=at(-5)), failed)
    assert (row.status, row.processing_start_time) == (1, at(-5))


def test_stale_start_after_failure(spark):
    started = event(2, -20, processing_start_time=at(-20))
    row, _ = fold(spark, event(1, -30), started, event(3, -10, processing_start_time=at(-20), retry_count=2), started)
    assert (row.status, row.retry_count, row.last_failed_at) == (0, 2, at(-10))


def test_timed_out(spark):
    row, _ = fold(spark, event(1, 0), event(2, 1, processing_start_time=at(1)), event(7, 50, processing_start_time=at(1)))
    assert (row.status, row.retry_count, row.last_failed_at, row.released_lease, row.available_at) == (0, 0, None, at(1), at(50))
    row, _ = fold(spark, event(1, 0), event(7, 50))
    assert (row.status, row.available_at) == (0, None)


def test_dead_letter_keeps_the_row_and_lowers_the_counts(spark):
    row, counts = fold(spark, event(1, 0), event(8, 5))
    assert (row.status, row.dead_lettered_at) == (7, at(5))
    assert counts == {"/incoming": 0, "t": 0}


@pytest.mark.parametrize("kind, status", [(2, 1), (3, 0), (4, 2), (5, 5), (7, 0), (8, 7)])
def test_birth_from_any_event(spark, kind, status):
    row, _ = fold(spark, event(kind, 3, processing_start_time=at(1), error_message="e"))
    assert (row.status, row.created_at) == (status, at(3))
    if kind in (3, 4, 5):  # what follows a birth finds the event stale, or stops there
        assert (row.processing_start_time, row.last_error) == (at(1), "e")


@pytest.mark.parametrize("more", [{"physical_path": " "}, {"physical_path": None}, {"physical_present": False}])
def test_no_birth_without_a_file(spark, more):
    assert fold(spark, event(1, 0, **more)) == (None, {})


def test_duplicates_in_place_change_nothing(spark):
    life = [event(1, 0), event(2, 1, processing_start_time=at(1)), event(3, 2, processing_start_time=at(1)), event(2, 3, processing_start_time=at(3)), event(4, 4, processing_start_time=at(3)), event(5, 5), event(8, 6)]
    assert fold(spark, *life)[0].asDict() == fold(spark, *[e for e in life for _ in range(2)])[0].asDict()


def test_gaps_use_the_running_maximum(spark):
    numbers = [1, 3, 2, 4, 9]
    j = journal(spark, [event(1, i, key=str(i), sequence_number=n) for i, n in enumerate(numbers)])
    assert sorted(tuple(r)[1:] for r in pj.sequence_gaps(j.where("sequence_number <> 2")).collect()) == [(2, 3), (5, 9)]


def test_count_stops_at_zero(spark):
    events = [event(1, 0), event(8, 1), event(6, 2), event(1, 3, key="g")]
    counts = {r.directory_path: r.current_count for r in pj.quota_counts(journal(spark, events)).collect()}
    assert counts == {"/incoming": 1, "t": 1}  # the deletion of a dead letter doesn't go below 0


def test_snapshot_and_tail_equal_a_full_replay(spark):
    events = [event(1, 0), event(1, 0, key="g"), event(2, 1, processing_start_time=at(1)), event(4, 2, processing_start_time=at(1)), event(6, 3, key="g"), event(1, 4, key="h")]
    j = journal(spark, events)
    whole = sorted(map(repr, pj.projected_files(j).collect()))
    for cut in range(1, 6):
        snapshot = pj.folded(j.where(F.col("sequence_number") <= cut))
        assert sorted(map(repr, pj.projected_files(j.where(F.col("sequence_number") > cut), snapshot).collect())) == whole


def test_stream_equals_batch(spark, tmp_path):
    events = [event(1, i, key=str(i % 3)) for i in range(3)] + [event(2, 5, key="0", processing_start_time=at(5)), event(3, 6, key="0", processing_start_time=at(5), retry_count=1), event(6, 7, key="1"), event(4, 8, key="2")]
    j = journal(spark, events)
    for i, (a, b) in enumerate([(1, 3), (4, 5), (6, 7)]):
        j.where(F.col("sequence_number").between(a, b)).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(j.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = projected_stream(stream).writeStream.outputMode("update").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = {}
    for r in spark.table("live").collect():
        last[r.file_key] = r
    batch = {r.file_key: r for r in pj.projected_files(j).collect()}
    assert {k: v.status for k, v in last.items() if v.alive} == {k: v.status for k, v in batch.items()}
    assert not last["1"].alive
