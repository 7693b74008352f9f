"""Statistics, paths, files, quotas, watching and journal files on small frames."""

import hashlib
import random
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quern.functions import paths
from quern.functions.time import retry_delay, tolerant_timestamp, window_offset
from quern.operators import files as fl, journal as jn, quota as qt, reconcile as rc, statistics as st, watch as wt
from quern.operators.running import floored_totals, running
from quern.sources import journal_files as jf, tables as tb
from quern.streaming.statistics import recorded_stream

T0 = datetime(2024, 5, 1, 12)
M = "name string, value long, ts timestamp_ntz, tenant_id string, volume_id string, watcher_id string, operation string, arrival long"


def one(spark, column, **values):
    return spark.range(1).select(column(*[F.lit(v) for v in values.values()])).first()[0]


@pytest.mark.parametrize("given, wanted", [(None, "/"), ("  ", "/"), ("a", "/a"), ("\\a\\\\b\\", "/a/b"), ("/a/./b/../c", "/a/c"), ("/../../a", "/a"), ("..", "/")])
def test_normalized_directory(spark, given, wanted):
    assert spark.range(1).select(paths.normalized_directory(F.lit(given).cast("string"))).first()[0] == wanted


def test_names(spark):
    row = spark.range(1).select(paths.extension(F.lit("a.tar.gz")), paths.extension(F.lit("a.")), paths.stem(F.lit("/x/a.b.c")), paths.sanitized_name(F.lit(' a<b>:"c. ')), paths.within(F.lit("/a/../b/c"), F.lit("/b")), paths.within(F.lit("/bc"), F.lit("/b")), paths.valid_tenant(F.lit("..")), paths.valid_tenant(F.lit("t-1"))).first()
    assert list(row) == [".gz", "", "a.b", "a_b___c", True, False, False, True]


def test_recovered_directory(spark):
    key = "ab" * 16
    rows = [
        # Stored files: shards lead, in any case of letters; whatever follows them is the logical directory.
        (f"/mnt/v/t/ab/ab/docs/{key}.dcm", "/mnt/v/T", key, "/docs"), (f"/mnt/v/t/AB/{key}", "/mnt/v/t", key, "/"), (f"/mnt/v/t/ab/ab/{key}", "/mnt/v/t", key, "/"),
        # Folders behind another one, or of another length, are no shards.
        (f"/mnt/v/t/docs/ab/{key}", "/mnt/v/t", key, "/docs/ab"), (f"/mnt/v/t/abab/{key}", "/mnt/v/t", key, "/abab"),
        ("/m/t/ab/studies/study-001.dcm", "/m/t/", "study-001", "/ab/studies"), ("/elsewhere/a/x.dat", "/m/t", "x", "/elsewhere/a"), (None, "/m/t", "x", "/"),
    ]
    df = spark.createDataFrame(rows, "path string, root string, key string, wanted string")
    got = df.select(paths.recovered_directory(F.col("path"), F.col("root"), F.col("key")).alias("d"), "wanted").collect()
    assert [r.d for r in got] == [r.wanted for r in got]


def test_physical_path(spark):
    path = lambda key, depth: one(spark, lambda k: paths.physical_path(F.lit("/m"), F.lit("t"), k, F.lit(".x"), depth), key=key)
    assert [path("abcdef", d) for d in range(5)] == ["/m/t/abcdef.x", "/m/t/ab/abcdef.x", "/m/t/ab/cd/abcdef.x", "/m/t/ab/cd/ef/abcdef.x", "/m/t/ab/cd/ef/abcdef.x"]
    assert [path("a", d) for d in (1, 2, 3)] == ["/m/t/a0/a.x", "/m/t/a0/00/a.x", "/m/t/a0/a.x"]
    assert path("abc", 3) == "/m/t/ab/c0/abc.x"


def test_generated_keys(spark):
    def prefix(seed, ordinal):  # in Python's own integers
        x, mask = (seed << 32) ^ ordinal ^ 0x9E3779B97F4A7C15, (1 << 64) - 1
        for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = ((x ^ (x >> 33)) * by) & mask
        return (x ^ (x >> 33)) & 0xFFFF

    rows = [(s, o) for s in (0, 1, 77, 2**31 - 1) for o in (0, 1, 31, 10**12)]
    got = spark.createDataFrame(rows, "s long, o long").select("s", "o", paths.shard_prefix(F.col("s"), F.col("o")).alias("p"), paths.generated_key(F.lit("0123ABCD-" + "ef" * 12), F.col("s"), F.col("o")).alias("k")).collect()
    assert all(r.p == prefix(r.s, r.o) and r.k == f"{r.p:04x}abcd" + "ef" * 12 for r in got)


def test_fingerprints(spark):
    t = F.lit(T0).cast("timestamp_ntz")
    now = spark.range(1).select(paths.fingerprint(F.lit(5), t, t)).first()[0]
    assert now == "fp:v2:5:638501616000000000:638501616000000000"
    assert spark.range(1).select(paths.fingerprint(F.lit(5), t, F.lit(None).cast("timestamp_ntz"))).first()[0] == now
    old = "fp:v1:" + ":".join(now.split(":")[2:4])
    check = lambda a, b: spark.range(1).select(paths.same_fingerprint(F.lit(a), F.lit(b))).first()[0]
    assert check(old, now) and check(now, now)
    assert not any(check(x, now) for x in (now[3:], now + "1", old + "1", "fp:v1:5", "fp:v2:5:1:2", ""))


def test_time_functions(spark):
    delays = [spark.range(1).select(retry_delay(F.lit(n))).first()[0] for n in (0, 1, 2, 3, 99)]
    assert delays == [5, 5, 10, 20, 300]
    assert window_offset(420) == "360 seconds" and window_offset(300) == "0 seconds"
    row = spark.range(1).select(tolerant_timestamp(F.lit("nonsense")), tolerant_timestamp(F.lit("nonsense"), True)).first()
    assert list(row) == [None, datetime(1970, 1, 1)]


def measured(spark, rows):
    return spark.createDataFrame([(n, v, T0 + timedelta(seconds=s), t, vol, None, None, i) for i, (n, v, s, t, vol) in enumerate(rows)], M)


def test_statistics_window(spark):
    m = measured(spark, [("storage.write.success.count", 2, 0, "a", "v"), ("storage.write.bytes", 4 << 20, 1, "a", "v"), (" ", 7, 1, "a", "v"), ("storage.file.dequeued.count", 0, 1, "a", "v")])
    cells = st.recorded(m, 10)
    assert cells.count() == 2
    t = st.snapshot_totals(st.overlapping(cells, F.lit(T0 - timedelta(seconds=5)), F.lit(T0 + timedelta(seconds=5)), 10), 10).first()
    assert (t.write_success_count, t.write_bytes, t.dequeued_count, t.write_megabytes_per_second) == (2, 4 << 20, 0, 0.4)


def test_dimension_off_and_filters(spark):
    m = measured(spark, [("n", 1, 0, "a", "v"), ("n", 1, 1, "b", "v")])
    off = st.snapshot_measurements(st.recorded(m, 10, ("volume_id",))).collect()
    assert [(r.value, r.tenant_id) for r in off] == [(2, None)]
    cells = st.recorded(m, 10)
    found = lambda **f: st.overlapping(cells, F.lit(T0), F.lit(T0 + timedelta(1)), 10, **f).count()
    assert (found(tenant_id="a"), found(tenant_id=""), found(watcher_id="w")) == (1, 2, 0)


def test_retention_and_cap(spark):
    m = measured(spark, [("n", 1, -600, "a", "v")] + [("n", 1, 0, "a", f"v{i}") for i in range(30)] + [("n", 1, 1, "a", "v0")])
    assert st.pruned(st.recorded(m, 10), F.lit(T0), 60, 10).count() == 30
    assert st.capped(m, 5, 10).agg(F.sum("value")).first()[0] == 6


def test_stream_of_statistics(spark, tmp_path):
    m = measured(spark, [("n", i, i, "a", "v") for i in range(50)])
    m.write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema(m.schema).parquet(str(tmp_path / "m"))
    query = recorded_stream(stream, 10, 60).writeStream.outputMode("complete").format("memory").queryName("cells").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    cell = lambda df: sorted((r.bucket_start, r.value) for r in df.collect())
    assert cell(spark.table("cells")) == cell(st.recorded(m, 10))


F_SCHEMA = "tenant_id string, file_key string, status int, created_at timestamp_ntz, available_at timestamp_ntz, processing_start_time timestamp_ntz, completed_at timestamp_ntz, delete_succeeded_at timestamp_ntz, last_failed_at timestamp_ntz, retry_count int, directory_path string, file_size long"


def table(spark, *rows):
    names = [c.split(" ")[0] for c in F_SCHEMA.split(", ")]
    base = {"tenant_id": "t", "created_at": T0, "retry_count": 0, "directory_path": "/", "file_size": 1}
    return spark.createDataFrame([tuple((base | r).get(n) for n in names) for r in rows], F_SCHEMA)


def keys(df):
    return [r.file_key for r in df.collect()]


def test_schedules(spark):
    now = F.lit(T0 + timedelta(minutes=1))
    f = table(spark, {"file_key": "b", "status": 0, "created_at": T0 - timedelta(minutes=5)}, {"file_key": "a", "status": 0, "created_at": T0 - timedelta(minutes=10)}, {"file_key": "c", "status": 0, "created_at": T0 - timedelta(minutes=20), "available_at": T0 + timedelta(minutes=10)})
    assert keys(fl.next_pending(f, now)) == ["a"]
    assert keys(fl.delayed(f, now, 5)) == ["c"]
    p = table(spark, {"file_key": "x", "status": 1, "retry_count": 0, "processing_start_time": T0}, {"file_key": "y", "status": 1, "retry_count": 2, "processing_start_time": T0 + timedelta(seconds=50)})
    after = {r.file_key: (r.status, r.retry_count, r.available_at) for r in fl.failed_once_more(p, now).collect()}
    assert after == {"x": (0, 1, T0 + timedelta(seconds=65)), "y": (4, 3, None)}
    assert keys(fl.timed_out(p, now, 30)) == ["x"]


def test_pages_and_overlay(spark):
    f = table(spark, *[{"file_key": k, "status": 2, "created_at": T0 + timedelta(seconds=i)} for i, k in enumerate("abcde")])
    assert keys(fl.page(f, "t", 1, 2)) == ["b", "c"]
    with pytest.raises(ValueError):
        fl.page(f, "t", -1, 2)
    hot = f.where("file_key = 'a'").withColumn("status", F.lit(1))
    assert {r.file_key: r.status for r in fl.overlaid(hot, f).collect()}["a"] == 1


def test_compare_and_set(spark):
    f = table(spark, {"file_key": "a", "status": 2}, {"file_key": "b", "status": 3})
    commands = spark.createDataFrame([("t", "a", 1, 2), ("t", "a", 2, 2), ("t", "b", 1, 2), ("t", "z", 1, 2)], "tenant_id string, file_key string, ordinal int, expected_status int")
    applied, rejected = fl.compare_and_set(f, commands, ["status"])
    assert keys(applied) == ["a"] and sorted(keys(rejected)) == ["a", "b", "z"]


def test_reconciliation(spark):
    f = table(spark, {"file_key": "a", "status": 0}, {"file_key": "d", "status": 7, "directory_path": "/failed"})
    q = spark.createDataFrame([("t", "/stale", 1, 0, False), ("t", "/limited", 0, 5, True), ("t", "/failed", 1, 0, False)], "tenant_id string, directory_path string, current_count long, max_count long, enabled boolean")
    actions = {r.directory_path: (r.action, r.expected) for r in qt.reconciled(f, q).collect()}
    assert actions == {"/": ("set", 1), "t": ("set", 1), "/stale": ("remove", 0), "/limited": ("keep", 0), "/failed": ("remove", 0)}


def test_orphans(spark):
    listing = spark.createDataFrame([("t", "v", "/mnt/v/t/orphan.dat", 3, "present"), ("t", "v", "/mnt/v/t/known.dat", 3, "present"), ("t", "v", "/mnt/v/t/gone.dat", 3, "missing")], "tenant_id string, volume_id string, path string, length long, presence string")
    f = table(spark, {"file_key": "known", "status": 0}, {"file_key": "lost", "status": 7}).withColumn("physical_path", F.concat(F.lit("/mnt/v/t/"), "file_key", F.lit(".dat"))).withColumn("volume_id", F.lit("v"))
    row = rc.orphan_files(listing, f).collect()
    assert [(r.file_key, r.directory_path, r.file_extension) for r in row] == [("orphan", "/", ".dat")]
    volumes = spark.createDataFrame([("v", True)], "volume_id string, is_healthy boolean")
    assert [(r.file_key, r.lowers_quota) for r in rc.orphan_metadata(f, listing, volumes).collect()] == [("lost", False)]
    assert rc.orphan_metadata(f, listing, volumes.withColumn("is_healthy", F.lit(False))).count() == 0


def test_eligibility(spark):
    rows = [("t", "/w/a.txt", 5, T0 - timedelta(seconds=60), "present"), ("t", "/w/b.txt", 5, T0 - timedelta(seconds=1), "present"), ("t", "/w/big.txt", 900, T0 - timedelta(seconds=60), "present"), ("t", "/w/e.txt", 0, T0 - timedelta(seconds=60), "present"), ("t", "/w/Thumbs.db", 5, T0, "present"), ("t", "/w/nodot", 5, T0, "present")]
    listing = spark.createDataFrame([(*r[:4], r[3], r[4]) for r in rows], "tenant_id string, path string, length long, modified_at timestamp_ntz, created_at timestamp_ntz, presence string")
    none = spark.createDataFrame([], "path string, fingerprint string")
    found = wt.eligibility(listing, none, F.lit(T0), 5, 500, ["*.*"])
    assert {r.path[3:]: r.skip_reason for r in found.collect()} == {"a.txt": None, "b.txt": "too young", "big.txt": "too large", "e.txt": "empty", "Thumbs.db": "junk"}
    assert wt.scan_result(found).first().asDict() == {"discovered": 5, "imported": 1, "skipped": 4, "failed": 0, "imported_bytes": 5, "errors": []}
    again = wt.eligibility(listing, found.select("path", "fingerprint"), F.lit(T0), 5, 500, ["a.*"])
    assert [r.skip_reason for r in again.collect()] == ["imported"]
    probe = listing.where("path = '/w/a.txt'").select("path", F.lit(4).cast("long").alias("length"), "modified_at")
    assert [r.skip_reason for r in wt.eligibility(listing, none, F.lit(T0), 5, 500, ["a.*"], earlier=probe).collect()] == ["still written"]
    going = found.where("path = '/w/a.txt'").select("path", F.lit(None).cast("string").alias("fingerprint"))
    assert [r.skip_reason for r in wt.eligibility(listing, going, F.lit(T0), 5, 500, ["a.*"]).collect()] == ["in flight"]
    assert wt.eligibility(listing, none, F.lit(T0), 5, 0, ["*.TXT"]).count() == 0
    assert wt.eligibility(listing, none, F.lit(T0), 5, 0, ["*.TXT"], ignore_case=True).count() == 4


def records(n):
    return [{"schema_version": 1, "event_type": 1 + i % 8, "occurred_at": T0 + timedelta(microseconds=i), "sequence_number": i + 1, "event_id": f"e{i}", "tenant_id": "t", "file_key": "ключ" * 40, "error_message": None if i % 2 else "", "file_size": None if i % 3 else i, "status": None, "retry_count": i, "processing_start_time": None, "available_at": T0} for i in range(n)]


@pytest.mark.parametrize("encode", [jf.encode_binary, jf.encode_json])
def test_journal_files(spark, tmp_path, encode):
    parts = [encode(r) for r in records(20)]
    whole = b"".join(parts)
    back = list(jf.decode(whole))
    assert [{k: b.get(k) for k in r} for b, r in zip(back, records(20))] == records(20)
    assert [b["end_offset"] for b in back] == [sum(map(len, parts[: i + 1])) for i in range(20)]
    (tmp_path / "j").mkdir()
    broken = b"".join(parts[:5]) + parts[5][:-7] + b"#" * 6 + b"\n"
    (tmp_path / "j" / "whole").write_bytes(whole)
    (tmp_path / "j" / "broken").write_bytes(broken)
    (tmp_path / "j" / "empty").write_bytes(b"")
    read = jf.read_journal(spark, str(tmp_path / "j"))
    state = {r.path.split("/")[-1]: (r.last_valid_offset, r.last_sequence, r.corrupt_tail) for r in jf.scan(read).collect()}
    assert state == {"whole": (len(whole), 20, False), "broken": (sum(map(len, parts[:5])), 5, True)}
    assert read.where("path like '%whole' and occurred_at is null").count() == 0


def test_json_lines_of_others(spark):
    """Lines of the wire format: names, times, escapes and the checksum over the line with a null in its place."""
    first = (
        '{"schemaVersion":1,"eventId":"e1","tenantId":"t","fileKey":"k","eventType":2,"occurredAtUtc":"2024-05-01T12:00:00.0000015Z","sequenceNumber":7,"payloadCrc32":null,"volumeId":"vol-1",'
        '"physicalPath":"/m/\\u0026/\\u00E9","directoryPath":null,"fileSize":5,"status":null,"processingStartTimeUtc":"2024-05-01T12:00:00Z","retryCount":null,"availableForProcessingAtUtc":null,'
        '"errorMessage":"a\\nb \\u0022c\\u0022 \\uD83D\\uDE00","originalFileName":null,"fileExtension":".x"}'
    )
    signed = first.replace('"payloadCrc32":null', f'"payloadCrc32":{zlib.crc32(first.encode())}')
    other_order = '{"tenantId":"t","eventType":1,"fileKey":"k","occurredAtUtc":"2024-05-01T14:00:00+02:00","more":1}'
    rows = list(jf.decode(f"{signed}\n\n{other_order}\r\n{signed.replace(':5,', ':6,')}\n".encode()))
    assert [r["corrupt"] for r in rows] == [False, False, True]
    a, b = rows[:2]
    assert (a["physical_path"], a["error_message"], a["sequence_number"], a["processing_start_time"]) == ("/m/&/é", 'a\nb "c" 😀', 7, T0)
    assert (b["occurred_at"], b["payload_crc32"], b["start_offset"]) == (T0, None, len(signed) + 2)
    again = {k: a[k] for k in jf._MEMBERS.values() if k != "payload_crc32"} | {"occurred_at": T0}
    assert jf.encode_json(again).decode().rstrip() == (lambda x: x.replace('"payloadCrc32":null', f'"payloadCrc32":{zlib.crc32(x.encode())}'))(first.replace(".0000015Z", "Z"))


def test_binary_golden_bytes():
    record = {"event_type": 1, "occurred_at": T0, "sequence_number": 3, "event_id": "e", "tenant_id": "t", "file_key": "k"}
    ticks = (638501616000000000).to_bytes(8, "little")
    payload = bytes.fromhex("0100000001000000") + ticks + bytes.fromhex("ffffffffffffffff000000800000008000000000000000800000000000000080010165010174" "01016b") + bytes(6)
    header = bytes.fromhex("514c4f47" "0100" "0000") + len(payload).to_bytes(4, "little") + (3).to_bytes(8, "little") + zlib.crc32(payload).to_bytes(4, "little")
    assert jf.encode_binary(record) == header + payload
    assert list(jf.decode(header + payload))[0]["file_key"] == "k"
    more = payload + b"\0"
    assert list(jf.decode(header[:8] + len(more).to_bytes(4, "little") + header[12:20] + zlib.crc32(more).to_bytes(4, "little") + more))[0]["corrupt"]


def test_running_in_chunks(spark):
    r = random.Random(1)
    rows = [(k, o, r.randint(-3, 3)) for k in ("a", "b", None) for o in r.sample(range(500), 60)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    for how, begin, step in (("sum", 0, lambda a, x: a + x), ("max", None, lambda a, x: x if a is None else max(a, x))):
        wanted, state = set(), {}
        for k, o, v in sorted(rows, key=lambda x: x[1]):
            wanted.add((k, o, state.get(k, begin)))
            state[k] = step(state.get(k, begin), v)
        assert {(x.k, x.o, x.b) for x in running(df, ["k"], "o", "v", how, "b", size=7).collect()} == wanted
    counts = {}
    for k, o, v in sorted(rows, key=lambda x: x[1]):
        counts[k] = max(0, counts.get(k, 0) + v)
    assert {x.k: x.n for x in floored_totals(df, ["k"], "o", "v", "n", size=7).collect()} == counts


def test_batches_of_a_journal(spark):
    placed = jn.with_offsets(spark.createDataFrame([("t", i, 10) for i in range(1, 6)], "tenant_id string, sequence_number long, record_bytes long"))
    read = lambda *a: (lambda b, s: ([x.sequence_number for x in b.collect()], *s.first()))(*jn.read_batch(placed, *a))
    assert read("t", 0, 2) == ([1, 2], 20, False) and read("t", 25, 9) == ([3, 4, 5], 50, True) and read("t", 30, 1) == ([4], 40, False)
    assert read("t", 5, 2, 20) == ([3, 4], 40, False) and read("t", 70, 2) == ([], 50, True) and read("u", 7, 2) == ([], 0, True)
    with pytest.raises(ValueError):
        jn.read_batch(placed, "t", -1, 1)
    kept, lost = jn.repaired(placed, F.col("sequence_number") == 4)
    assert kept.count() == 3 and [tuple(x) for x in lost.collect()] == [("t", 30, 2)]
    assert jn.single_tenant(placed, "t").count() == 5
    with pytest.raises(Exception, match="one tenant"):
        jn.single_tenant(placed, "u").count()


def test_leases(spark):
    """Late completions and repeated failures are known by the lease that was released."""
    names = "tenant_id string, file_key string, status int, processing_start_time timestamp_ntz, last_failed_at timestamp_ntz, available_at timestamp_ntz, last_error string, released_lease timestamp_ntz"
    at, other = T0, T0 + timedelta(seconds=1)
    f = spark.createDataFrame([("t", "timed out", 0, None, None, at, None, at), ("t", "failed", 4, None, at, None, "e", at), ("t", "fresh", 0, None, None, None, None, at), ("t", "done", 5, None, None, None, None, at), ("t", "busy", 1, at, None, None, None, None)], names)
    commands = spark.createDataFrame([("t", k, kind, lease) for k in ("timed out", "failed", "fresh", "done", "busy", "gone") for kind in ("complete", "fail") for lease in (at, other)], "tenant_id string, file_key string, kind string, lease timestamp_ntz")
    got = {(r.file_key, r.kind, r.lease == at): r.result for r in fl.lease_result(f, commands).collect()}
    assert [got["timed out", "complete", x] for x in (True, False)] == ["late", "mismatch"]
    assert [got["failed", k, True] for k in ("complete", "fail")] == ["late", "idempotent"]
    assert [got["fresh", "complete", x] for x in (True, False)] == ["mismatch", "mismatch"]
    assert [got["done", k, x] for k in ("complete", "fail") for x in (True, False)] == ["idempotent", "idempotent", "idempotent", "mismatch"]
    assert [got["busy", k, x] for k in ("complete", "fail") for x in (True, False)] == ["applied", "mismatch"] * 2
    assert [got["gone", k, True] for k in ("complete", "fail")] == ["idempotent", "mismatch"]


def test_volume_choice(spark):
    volumes = spark.createDataFrame([("v0", 10, True), ("v1", 30, True), ("v2", 20, True), ("v3", 99, False), ("v4", 0, True)], "volume_id string, available_space long, is_healthy boolean")
    requests = spark.createDataFrame([(t, t, 0) for t in range(40)] + [(100, 4, 15), (101, 4, 25), (102, 4, 31)], "request_id long, ticket long, size long")
    got = {r.request_id: r.volume_ids for r in fl.volume_choice(volumes, requests).collect()}
    ids, space = ["v0", "v1", "v2"], {"v0": 10, "v1": 30, "v2": 20}
    for t in range(40):
        i, j = t % 3, (t * 1103515245 + 12345) % 2**32 % 3
        j = (j + 1) % 3 if i == j else j
        pair = sorted((ids[i], ids[j]), key=lambda v: -space[v])
        assert got[t] == pair + [v for v in ids if v not in pair]
    assert got[101] == ["v1"] and got[102] is None and sorted(got[100]) == ["v1", "v2"]
    assert fl.volume_choice(volumes.where("false"), requests).where("volume_ids is not null").count() == 0


def test_choice_of_many_volumes(spark):
    n = 5000
    volumes = spark.range(n).select(F.format_string("v%05d", "id").alias("volume_id"), (100 + F.col("id") % 7).alias("available_space"), F.lit(True).alias("is_healthy"))
    requests = spark.createDataFrame([(t, t, s) for t, s in ((0, 0), (4999, 0), (7, 106), (8, 107))], "request_id long, ticket long, size long")
    got = {r.request_id: r.volume_ids for r in fl.volume_choice(volumes, requests).collect()}
    for t, size in ((0, 0), (4999, 0), (7, 106)):
        ids = [f"v{v:05d}" for v in range(n) if 100 + v % 7 >= size]
        i, j = t % len(ids), (t * 1103515245 + 12345) % 2**32 % len(ids)
        j = (j + 1) % len(ids) if i == j else j
        pair = sorted((ids[i], ids[j]), key=lambda v: -(int(v[1:]) % 7))
        assert got[t] == pair + [v for v in ids if v not in pair]
    assert got[8] is None


def test_choice_as_text(spark, monkeypatch):
    monkeypatch.setattr(fl, "CHOSEN", 50)
    r = random.Random(5)
    ids = [None, *(f"v{'ä' * (v % 3)}{v}" for v in range(30)), "", "v3"]
    volumes = spark.createDataFrame([(v, r.choice([0, 5, 10, 10, 20, 35]), r.random() < 0.9) for v in ids], "volume_id string, available_space long, is_healthy boolean")
    requests = spark.createDataFrame([(i, r.choice([None, 0, 1, 7, i, 10**12]), r.choice([None, -1.0, 0.0, 4.5, 5.0, 5.1, 11.0, 36.0, 35.0, float(i % 40)])) for i in range(400)], "request_id long, ticket long, size double")
    for some in (volumes, volumes.where("available_space = 35").limit(1), volumes.where("false")):
        some = some.cache()
        wanted = {x.request_id: x.volume_ids for x in fl.volume_choice(some, requests).collect()}
        for separator in (",", " ö ", ""):
            got = {x.request_id: x.volume_ids for x in fl.volume_choice(some, requests, separator).collect()}
            assert got == {i: None if v is None else separator.join(x for x in v if x is not None) for i, v in wanted.items()}
    # The text is cut as a whole; no array of names is made of it first.
    assert dict(fl.volume_choice(volumes, requests, ",").dtypes)["volume_ids"] == "string"


def test_directories_meet_before_those_above_them(spark):
    rows = [("/m/t/a/b", False), ("/m/t/a/b", True), ("/m/t/a/c", False), ("/m", False), ("x", False)]
    df = spark.createDataFrame(rows, "path string, flag boolean")
    got = {(r.path, r.flag) for r in rc.with_ancestors(df, "flag").collect()}
    assert got == {("", True), ("/m", True), ("/m/t", True), ("/m/t/a", True), ("/m/t/a/b", True), ("/m/t/a/c", False), ("x", False)}
    assert sorted(r.path for r in rc.with_ancestors(df, "flag", first=4).collect()) == ["/m/t/a", "/m/t/a/b", "/m/t/a/c"]
    plan = rc.with_ancestors(df, "flag")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate") > plan.index("Generate")  # the explosion reads rows that have met


def test_targets_of_imports(spark):
    imported = spark.createDataFrame([("/w/a.txt", 1), ("/x/a.txt", 2), ("/y/a.txt", 3), ("/w/b", 4), ("/w/a_1.txt", 5)], "path string, ordinal long")
    present = spark.createDataFrame([("/done/a.txt",), ("/done/b",), ("/other/a_1.txt",)], "path string")
    got = {r.path: r.target_path for r in wt.import_targets(imported, present, "/done/").collect()}
    assert got == {"/w/a.txt": "/done/a_1.txt", "/x/a.txt": "/done/a_1_2.txt", "/y/a.txt": "/done/a_1_2_3.txt", "/w/b": "/done/b_1", "/w/a_1.txt": "/done/a_1_1.txt"}


def _brute_targets(imported, present):
    """One name after the other, as the watcher moves its files."""
    taken, targets = set(present), []
    for name in imported:
        target, n = name, 1
        while target in taken:
            dot = target.rfind(".")
            head, end = (target[:dot], target[dot:].rstrip(".")) if dot >= 0 else (target, "")
            target, n = f"{head}_{n}{end}", n + 1
        taken.add(target)
        targets.append("/done/" + target)
    return targets


@pytest.mark.parametrize("numbers", [1_000_000, 12, 2])
def test_targets_one_after_the_other(spark, monkeypatch, numbers):
    monkeypatch.setattr(wt, "NUMBERS", numbers)
    r = random.Random(3)
    ends = ["", ".x", ".", "..", ".b.", ".b_1", ".b_1.", ".x_1", "._1", "\n"]
    name = lambda: "".join([r.choice(["a", "", "a.b", "a_"]), *(f"_{r.choice([1, 1, 2, 2, 3, 4, 10, '01', '9' * 30])}" for _ in range(r.choice([0, 0, 1, 2, 3]))), r.choice(ends)])
    chain = "q" + "".join(f"_{i}" for i in range(1, 9)) + ".x"
    names = [name() for _ in range(1500)] + ["q.x"] * 40 + ["q_1.b."] * 20 + ["q.b_1"] * 20
    r.shuffle(names)
    present = list({name() for _ in range(60)} | {chain, "q_1_2_3_4_5_6_7_8_9_10_11.x", "q.b_1"})
    imported = spark.createDataFrame([(f"/w/{i}/{n}", i) for i, n in enumerate(names)], "path string, ordinal long")
    there = spark.createDataFrame([("/done/" + n,) for n in present], "path string")
    got = {row.path: row.target_path for row in wt.import_targets(imported, there, "/done").collect()}
    wanted = _brute_targets(names, present)
    assert len(set(wanted)) == len(wanted)
    assert [got[f"/w/{i}/{n}"] for i, n in enumerate(names)] == wanted


def test_targets_of_many_of_one_name(spark):
    n = 4000  # each going through all names before its own would be 8,000,000 names of up to 19 KB
    imported = spark.range(n).select(F.format_string("/w/%d/a.x", "id").alias("path"), F.col("id").alias("ordinal"))
    targets = wt.import_targets(imported, spark.createDataFrame([("/done/a_1_2.x",)], "path string"), "/done")
    got = {r.path: (r.l, r.h) for r in targets.select("path", F.length("target_path").alias("l"), F.md5("target_path").alias("h")).collect()}
    name = "/done/a"
    for at, i in enumerate([0, 1, *range(3, n + 1)]):  # 2 is taken
        name = "/done/a" + "".join(f"_{k}" for k in range(1, i + 1)) if at < 3 else f"{name}_{i}"
        assert got[f"/w/{at}/a.x"] == (len(name) + 2, hashlib.md5(f"{name}.x".encode()).hexdigest())
    # The names are put together after rows were dealt out anew: no task has all of a stem's.
    plan = targets._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Repartition") < plan.index("MapInArrow")


def test_journal_tables(spark):
    rows = spark.createDataFrame([("t", i, 10 * i) for i in range(1, 6)], "tenant_id string, sequence_number long, record_bytes long")
    placed = jn.with_offsets(rows)
    assert [(r.start_offset, r.end_offset) for r in jn.compacted(placed, 30).orderBy("start_offset").collect()] == [(30, 60), (60, 100), (100, 150)]
    assert jn.normalized_offset(placed, 75).first().normalized_offset == 60
    assert [r.sequence_number for r in jn.valid_prefix(placed, F.col("sequence_number") == 4).orderBy("sequence_number").collect()] == [1, 2, 3]
    assert jn.scan_state(placed, F.col("sequence_number") == 4).first().asDict() == {"tenant_id": "t", "last_valid_offset": 60, "last_sequence": 3, "corrupt_tail": True}
    new = spark.createDataFrame([("t", 1), ("t", 2), ("u", 1)], "tenant_id string, ordinal int")
    assert sorted((r.tenant_id, r.sequence_number) for r in jn.appended(rows, new).collect()) == [("t", 6), ("t", 7), ("u", 1)]


def test_reservations(spark):
    kinds = ["reserve", "reserve", "reserve", "accept", "release", "release", "release"]
    events = spark.createDataFrame([("k", i, k) for i, k in enumerate(kinds)], "key string, seq int, kind string")
    assert qt.reservations(events, 2).first().asDict() == {"key": "k", "projected": 0, "reserved": 0, "rejected": 1}


def test_tables(spark, tmp_path):
    for tenant in ("a", "b"):
        (tmp_path / "r" / tenant).mkdir(parents=True)
        (tmp_path / "r" / tenant / "x.dat").write_bytes(b"123")
    (tmp_path / "r" / "loose.dat").write_bytes(b"1")
    found = tb.by_tenant(tb.read_listing(spark, str(tmp_path / "r")), str(tmp_path / "r"))
    assert sorted((r.tenant_id, r.file_name, r.length) for r in found.collect()) == [("a", "x.dat", 3), ("b", "x.dat", 3)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.json").write_text('{"TenantId": "a",\n "Status": 1, "CreatedAt": "2024-05-01T12:00:00Z", "StoragePath": "/s", "Properties": null}')
    (tmp_path / "t" / "b.json").write_text("{nonsense")
    (tmp_path / "t" / "c.json").write_text('{"tenantId": "c", "status": "Suspended", "createdAt": "?"}')
    assert sorted((r.tenant_id, r.status, r.created_at) for r in tb.read_tenants(spark, str(tmp_path / "t")).collect()) == [("a", 1, T0), ("c", 3, datetime(1970, 1, 1))]
    f = table(spark, {"file_key": "a", "status": 0}, {"file_key": "b", "status": 1, "tenant_id": "u"})
    tb.write_snapshot(f, str(tmp_path / "s"), 7)
    assert tb.read_snapshot(spark, str(tmp_path / "s")).where("cursor = 7").count() == 2
    tb.replace_tenants(f.where("tenant_id = 'u'").withColumn("status", F.lit(2)).withColumn("cursor", F.lit(9)), str(tmp_path / "s"))
    assert sorted((r.tenant_id, r.status) for r in tb.read_snapshot(spark, str(tmp_path / "s")).collect()) == [("t", 0), ("u", 2)]
    assert tb.compact(spark, str(tmp_path / "s"), str(tmp_path / "c")).first().files_after == 1


def test_reservations_hold_no_group(spark):
    rows = [(k, i, ("reserve", "accept", "release", None)[(i * i + (k or 0)) % 7 % 4]) for k in (None, 1, 2, 3) for i in range(25_000 if k == 1 else 40)]
    events = spark.createDataFrame(rows[::-1], "key long, seq long, kind string")
    wanted = {}
    for k, _, kind in rows:
        p, r, x = wanted.get(k, (0, 0, 0))
        if kind == "reserve":
            wanted[k] = (p, r + 1, x) if p + r < 3 else (p, r, x + 1)
        elif kind == "accept":
            wanted[k] = (p + 1, max(0, r - 1), x)
        else:
            wanted[k] = (p, r - 1, x) if r else (max(0, p - 1), r, x)
    got = qt.reservations(events, 3)
    assert {r.key: (r.projected, r.reserved, r.rejected) for r in got.collect()} == wanted
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert qt.reservations(events.where("false"), 3).count() == 0
