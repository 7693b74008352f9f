"""Further queries of the catalogue: commands, budgets, health, keys."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import paths, time as tm
from ..operators import commands as cm, files as fl, reconcile as rc, watch as wt
from .catalogue import NOW, _ts, query

_R = "tenant_id, file_key, status"


def _r(df):
    return df.select(*_R.split(", "))


def _all(f, **expected):
    return f.select("tenant_id", "file_key", *[c.alias(n) for n, c in expected.items()])


_NONE = "CAST(NULL AS TIMESTAMP)"


@query("files", sql=f"SELECT tenant_id, file_key, 1 AS status, TIMESTAMP '{NOW}' AS processing_start_time, {_NONE} AS available_at, {_NONE} AS released_lease FROM files WHERE status = 0 AND (available_at IS NULL OR available_at <= TIMESTAMP '{NOW}')")
def command_lease(f):
    return cm.leased(f, _all(f).unionAll(_all(f)), _ts(NOW)).select("tenant_id", "file_key", "status", "processing_start_time", "available_at", "released_lease")


@query("files", sql="SELECT tenant_id, file_key, 0 AS status, 0 AS retry_count FROM files WHERE status <> 1")
def command_reset(f):
    return cm.reset_to_pending(f, _all(f)).select("tenant_id", "file_key", "status", "retry_count")


@query("files", sql=f"SELECT tenant_id, file_key, 0 AS status, {_NONE} AS processing_start_time, TIMESTAMP '{NOW}' AS available_at, processing_start_time AS released_lease FROM files WHERE status = 1 AND retry_count < 3")
def command_reset_timed_out(f):
    wrong = F.when(F.col("retry_count") < 3, F.col("processing_start_time")).otherwise(F.col("created_at"))
    return cm.reset_timed_out(f, _all(f, expected_start=wrong), _ts(NOW)).select("tenant_id", "file_key", "status", "processing_start_time", "available_at", "released_lease")


@query("files", sql=f"SELECT tenant_id, file_key, 0 AS status, {_NONE} AS available_at, processing_start_time AS released_lease FROM files WHERE status = 1 AND processing_start_time < TIMESTAMP '1996-01-01'")
def command_reset_all_timed_out(f):
    return cm.reset_all_timed_out(f, _ts(NOW), 366 * 86400).select("tenant_id", "file_key", "status", "available_at", "released_lease")


@query("files", sql="SELECT tenant_id, file_key, CASE WHEN status = 1 AND retry_count < 3 THEN 'changed' ELSE 'as it was' END AS last_error FROM files WHERE status <> 1 OR retry_count <> 4")
def command_update_or_remove_processing(f):
    """Rows under the expected lease are changed, those of retry 4 are removed; a wrong lease does neither."""
    right = F.when(F.col("retry_count") < 3, F.col("processing_start_time")).otherwise(F.col("created_at"))
    changed = cm.processing_updated(f, _all(f, expected_start=right), {"last_error": F.lit("changed")})
    gone = _all(f.where("retry_count = 4"), expected_start=F.col("processing_start_time")).unionByName(_all(f.where("retry_count = 3"), expected_start=F.col("created_at")))
    left = cm.processing_removed(f, gone)
    return fl.overlaid(changed.select("tenant_id", "file_key", "last_error"), left.select("tenant_id", "file_key", F.lit("as it was").alias("last_error")))


@query("files", sql=f"SELECT tenant_id, file_key, CASE WHEN delete_succeeded_at >= TIMESTAMP '1993-01-01' THEN status ELSE 6 END AS status, CASE WHEN delete_succeeded_at >= TIMESTAMP '1993-01-01' THEN delete_succeeded_at ELSE TIMESTAMP '1993-01-01' END AS delete_succeeded_at FROM files WHERE status IN (2, 5)")
def command_mark_deleted(f):
    """A row that was deleted later than the command stays as it is."""
    return cm.marked_deleted(f, _all(f, expected_completed_at=F.col("completed_at")), _ts("1993-01-01 00:00:00")).select("tenant_id", "file_key", "status", "delete_succeeded_at")


@query("files", sql="SELECT tenant_id, file_key, status FROM files WHERE NOT (status IN (2, 5) AND retry_count % 2 = 0) AND NOT (status = 4 AND retry_count % 2 = 1)")
def command_remove_settled(f):
    """Completed rows and permanently failed ones go where the command still knows their time."""
    known = lambda c, odd: F.when(F.col("retry_count") % 2 == odd, F.col(c)).otherwise(_ts("1970-01-01 00:00:00"))
    left = cm.completed_removed(f, _all(f, expected_completed_at=known("completed_at", 0)))
    return _r(cm.failed_removed(left, _all(f, expected_failed_at=known("last_failed_at", 1))))


@query("files", sql=f"SELECT tenant_id, file_key, 6 AS status, TIMESTAMP '{NOW}' AS delete_succeeded_at FROM files WHERE status = 4 AND retry_count <> 2")
def command_mark_failed_deleted(f):
    expected = F.when(F.col("retry_count") != 2, F.col("last_failed_at")).otherwise(_ts("1970-01-01 00:00:00"))
    return cm.failed_marked_deleted(f, _all(f, expected_failed_at=expected), _ts(NOW)).select("tenant_id", "file_key", "status", "delete_succeeded_at")


@query("files", sql="SELECT tenant_id, file_key, 7 AS status FROM files WHERE status = 4")
def command_dead_letter(f):
    return _r(cm.dead_lettered(f, _all(f, expected_failed_at=F.col("last_failed_at")), _ts(NOW)))


@query("files", "listing", sql="SELECT f.tenant_id, file_key, 6 AS status FROM files f JOIN listing l ON l.tenant_id = f.tenant_id AND l.path = f.physical_path WHERE presence = 'missing' AND status IN (2, 4, 5, 6)")
def command_converge_missing(f, l):  # noqa: E741
    missing = l.where("presence = 'missing'").select("tenant_id", F.col("path").alias("expected_path"))
    keys = missing.withColumn("file_key", paths.stem(F.col("expected_path")))
    return _r(cm.converged(f, keys, _ts(NOW)))


@query("tenants", sql="SELECT tenant_id, lap, least(lag, 64) AS records FROM (SELECT tenant_id, cast(tenant_id <= 'tenant-017' as int) AS lap, tenant_limit * 3 AS lag FROM tenants ORDER BY lap, tenant_id LIMIT 12)")
def projection_rotation(t):
    return cm.rotation(t.withColumn("lag", F.col("tenant_limit") * 3), "tenant-017", 12, 64)


@query("files", sql="""SELECT tenant_id, file_key, CASE WHEN retry_count IN (0, 1) THEN 0 ELSE status END AS status, CASE WHEN retry_count IN (0, 1) THEN 'a=1' WHEN retry_count = 4 THEN 'a=1,c=3' ELSE 'a=1,b=9' END AS metadata FROM files""")
def metadata_optimistic_merge(f):
    """Rows as they were read, with a null among them; rows changed since in a column; and in the metadata alone."""
    n, text = F.col("retry_count"), lambda m: F.create_map(*[F.lit(x) for x in m])
    error = F.when(n != 1, F.lit("e"))
    row = lambda status, meta: f.select("tenant_id", "file_key", status.cast("int").alias("status"), error.alias("last_error"), meta.alias("metadata"))
    read = row(F.col("status"), text("a0"))
    now = row(F.col("status"), F.when(n.isin(0, 1), text("a0")).when(n == 4, text("a0c3")).otherwise(text("a0b9")))
    changed = row(F.lit(0), text("a1"))
    merged = cm.merged_optimistically(now, changed, read)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return merged.select("tenant_id", "file_key", "status", shown.alias("metadata"))


@query("journal", sql=f"""WITH t AS (SELECT tenant_id, max(sequence_number) AS tail, max(CASE WHEN event_id % 3 = 0 THEN sequence_number END) AS cursor, cast(substr(tenant_id, 8) AS INT) AS i FROM journal GROUP BY tenant_id),
    s AS (SELECT *, CASE WHEN i % 5 > 0 THEN cursor - 40 + 20 * (i % 4) END AS snap, CASE WHEN i % 3 = 0 THEN TIMESTAMP '{NOW}' - INTERVAL 2 HOUR ELSE TIMESTAMP '{NOW}' - INTERVAL 1 MINUTE END AS saved FROM t)
    SELECT tenant_id, cursor <= tail AND cursor - 10 >= 50 AS compact, snap IS NULL OR cursor < snap OR (cursor > snap AND (cursor - snap >= 30 OR saved + INTERVAL 1 HOUR <= TIMESTAMP '{NOW}')) AS snapshot FROM s""")
def journal_maintenance_due(j):
    state = j.groupBy("tenant_id").agg(F.max("sequence_number").alias("tail"), F.max(F.when(F.col("event_id") % 3 == 0, F.col("sequence_number"))).alias("cursor"))
    i = F.substring("tenant_id", 8, 3).cast("int")
    at = F.when(i % 3 == 0, _ts("1996-12-31 22:00:00")).otherwise(_ts("1996-12-31 23:59:00"))
    state = state.withColumns({"base": F.lit(10), "snapshot_cursor": F.when(i % 5 > 0, F.col("cursor") - 40 + 20 * (i % 4)), "snapshot_at": at})
    return cm.maintenance_due(state, 50, 30, _ts(NOW), 3600)


@query("files", sql="SELECT tenant_id, count(*) FILTER (status = 0) AS pending FROM files GROUP BY tenant_id")
def pending_counts(f):
    return fl.pending_counts(f)


@query("volumes", sql="SELECT volume_id, available_space FROM volumes WHERE is_healthy AND available_space >= 500000")
def volumes_writable(v):
    return fl.writable(v, 500_000).select("volume_id", "available_space")


@query("tenants", sql="SELECT k AS kind, count(*) FILTER (present AND readable) AS healthy, count(*) FILTER (present AND NOT readable) AS corrupted, count(*) FILTER (NOT present) AS missing FROM (SELECT k, has_database AS present, status <> 3 AS readable FROM tenants, (VALUES ('metadata'), ('quota')) v(k)) GROUP BY k")
def health_report(t):
    databases = t.select("tenant_id", F.explode(F.array(F.lit("metadata"), F.lit("quota"))).alias("kind"), F.col("has_database").alias("present"), (F.col("status") != 3).alias("readable"))
    return rc.health(databases)


@query("files", sql="SELECT file_key, 'auto-multi-' || sha256('multi:/mnt/' || volume_id)[1:16] AS watcher_id FROM files")
def watcher_ids(f):
    return f.select("file_key", paths.watcher_id(F.lit("multi"), F.concat(F.lit("/mnt/"), "volume_id")).alias("watcher_id"))


_BROKEN = """SELECT CASE retry_count WHEN 1 THEN upper(file_key) WHEN 2 THEN file_key[1:31] WHEN 3 THEN 'g' || file_key[2:] ELSE file_key END AS file_key, CASE file_size % 7 WHEN 0 THEN '..' WHEN 1 THEN tenant_id || '/x' WHEN 2 THEN 'a:b' WHEN 3 THEN NULL WHEN 4 THEN '' ELSE tenant_id END AS tenant_id FROM files"""


@query("files", sql=f"""SELECT file_key, tenant_id, length(file_key) = 32 AND NOT contains(lower(file_key), 'g') AS generated, coalesce(tenant_id LIKE 'tenant-%' AND NOT contains(tenant_id, '/'), FALSE) AS valid_tenant FROM ({_BROKEN})""")
def key_checks(f):
    """Keys in either case, short ones and others; tenants that a path can't hold."""
    k, t, n = F.col("file_key"), F.col("tenant_id"), F.col("file_size") % 7
    key = F.when(F.col("retry_count") == 1, F.upper(k)).when(F.col("retry_count") == 2, F.substring(k, 1, 31)).when(F.col("retry_count") == 3, F.concat(F.lit("g"), F.substring(k, 2, 99))).otherwise(k)
    tenant = F.when(n == 0, "..").when(n == 1, F.concat(t, F.lit("/x"))).when(n == 2, "a:b").when(n == 3, F.lit(None)).when(n == 4, "").otherwise(t)
    broken = f.select(key.alias("file_key"), tenant.alias("tenant_id"))
    return broken.select("file_key", "tenant_id", paths.looks_generated(F.col("file_key")).alias("generated"), paths.valid_tenant(F.col("tenant_id")).alias("valid_tenant"))


_WATCHERS = f"""w AS (SELECT volume_id, is_healthy AS enabled, CASE WHEN sharding_depth > 0 THEN TIMESTAMP '1996-12-31 23:59:00' END AS last_scan, greatest(5, least(3600, CASE sharding_depth WHEN 1 THEN 1 WHEN 2 THEN 30 ELSE 90000 END)) AS every FROM volumes),
    due AS (SELECT *, coalesce(least(last_scan + to_seconds(every), TIMESTAMP '{NOW}' + to_seconds(every)), TIMESTAMP '{NOW}') AS due_at FROM w WHERE enabled)"""


def _watchers(v):
    last = F.when(F.col("sharding_depth") > 0, _ts("1996-12-31 23:59:00"))
    interval = F.when(F.col("sharding_depth") == 1, 1).when(F.col("sharding_depth") == 2, -7).otherwise(90_000)
    return v.select("volume_id", F.col("is_healthy").alias("enabled"), last.alias("last_scan"), interval.alias("interval_seconds"))


@query("volumes", sql=f"WITH {_WATCHERS} SELECT volume_id FROM due WHERE due_at <= TIMESTAMP '{NOW}'")
def watchers_due(v):
    """Intervals below the least one, without a value, and above the greatest."""
    return cm.watchers_due(_watchers(v), _ts(NOW)).select("volume_id")


@query("volumes", sql=f"""WITH {_WATCHERS}, x AS (SELECT 'all' AS who, min(due_at) AS due_at FROM due UNION ALL SELECT 'waiting', min(due_at) FROM due WHERE due_at > TIMESTAMP '{NOW}' UNION ALL SELECT 'none', TIMESTAMP '{NOW}' + INTERVAL 30 SECOND)
    SELECT who, due_at, CASE WHEN due_at > TIMESTAMP '{NOW}' THEN (epoch_us(due_at) - epoch_us(TIMESTAMP '{NOW}')) / 1e6 ELSE 0.2::DOUBLE END AS wait_seconds FROM x""")
def watchers_next_due(v):
    """Of all watchers, of those that aren't due yet, and of none."""
    w = _watchers(v)
    waiting = w.where("interval_seconds > 3600 and last_scan is not null")
    side = lambda who, rows: cm.next_due(rows, _ts(NOW)).select(F.lit(who).alias("who"), "due_at", "wait_seconds")
    return side("all", w).unionByName(side("waiting", waiting)).unionByName(side("none", w.where("false")))


@query("files", sql="SELECT count(*) AS rows, count(*) FILTER (status = 7) AS dead_lettered, count(*) FILTER (delete_succeeded_at IS NOT NULL) AS deleted, cast(coalesce(sum(file_size) FILTER (delete_succeeded_at IS NOT NULL), 0) AS BIGINT) AS bytes_freed FROM files")
def cleanup_statistics(f):
    gone = F.col("delete_succeeded_at").isNotNull()
    return f.agg(F.count("*").alias("rows"), F.count_if(F.col("status") == 7).alias("dead_lettered"), F.count_if(gone).alias("deleted"), F.coalesce(F.sum(F.when(gone, F.col("file_size"))), F.lit(0)).alias("bytes_freed"))


@query("files", sql="SELECT tenant_id, array_to_string(list_sort(list(DISTINCT e))[1:5], ';') AS errors, greatest(count(DISTINCT e) - 5, 0) AS more FROM (SELECT tenant_id, last_error || CASE WHEN tenant_id > 'tenant-010' THEN cast(retry_count AS VARCHAR) ELSE '' END AS e FROM files WHERE last_error IS NOT NULL) GROUP BY tenant_id")
def error_samples(f):
    """Distinct errors of a tenant: the first five by name and how many more."""
    more = F.when(F.col("tenant_id") > "tenant-010", F.col("retry_count").cast("string")).otherwise("")
    return wt.distinct_errors(f.select("tenant_id", F.concat("last_error", more).alias("error")), "tenant_id").select("tenant_id", F.array_join("errors", ";").alias("errors"), "more")


@query("journal", sql="""WITH s AS (SELECT tenant_id AS watcher_id, sequence_number // 8 AS scan, list_sort(list(DISTINCT error_message)) AS errors FROM (SELECT tenant_id, sequence_number, substr(error_message, 1, 7) AS error_message FROM journal WHERE error_message IS NOT NULL) GROUP BY ALL)
    SELECT watcher_id, scan, len(errors) AS distinct_errors, coalesce(errors = lag(errors) OVER (PARTITION BY watcher_id ORDER BY scan), FALSE) AS repeated FROM s""")
def watch_repeated_errors(j):
    scans = j.where("error_message is not null").select(F.col("tenant_id").alias("watcher_id"), F.floor(F.col("sequence_number") / 8).alias("scan"), F.substring("error_message", 1, 7).alias("error"))
    return wt.repeated_errors(scans)


@query("journal", sql="""WITH c AS (SELECT tenant_id, file_key, event_id AS seq, CASE WHEN event_type IN (1, 7) THEN 'Create' WHEN event_type IN (2, 3) THEN 'Update' WHEN event_type = 4 THEN 'Disable' WHEN event_type = 5 THEN 'Enable' ELSE 'Delete' END AS op, 'size ' || file_size AS settings FROM journal),
    f AS (SELECT tenant_id, file_key, list_reduce(list({'o': op, 's': settings} ORDER BY seq), lambda a, x: CASE WHEN x.o = 'Delete' THEN {'there': FALSE, 's': NULL::VARCHAR, 'e': FALSE} WHEN x.o = 'Create' AND NOT a.there THEN {'there': TRUE, 's': x.s, 'e': TRUE}
      WHEN NOT a.there OR x.o = 'Create' THEN a WHEN x.o = 'Update' THEN {'there': TRUE, 's': x.s, 'e': a.e} ELSE {'there': TRUE, 's': a.s, 'e': x.o = 'Enable'} END, {'there': FALSE, 's': NULL::VARCHAR, 'e': FALSE}) AS a FROM c GROUP BY ALL)
    SELECT tenant_id, file_key, a.s AS settings, a.e AS enabled FROM f WHERE a.there""")
def watcher_configuration(j):
    """Watchers (or, with other keys, tenants) after a log of changes."""
    e = F.col("event_type")
    op = F.when(e.isin(1, 7), "Create").when(e.isin(2, 3), "Update").when(e == 4, "Disable").when(e == 5, "Enable").otherwise("Delete")
    return wt.configured(j.select("tenant_id", "file_key", F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("size "), F.col("file_size").cast("string")).alias("settings")), ["tenant_id", "file_key"])


@query("journal", sql="""WITH c AS (SELECT tenant_id, event_id AS seq, CASE WHEN sequence_number = 1 THEN 'Create' WHEN event_type IN (3, 7) THEN 'Disable' WHEN event_type IN (1, 4) THEN 'Enable' WHEN event_type = 2 THEN 'Update' ELSE 'Touch' END AS op, 'at ' || sequence_number AS settings FROM journal)
    SELECT tenant_id, arg_max(settings, seq) FILTER (op IN ('Create', 'Update')) AS settings, arg_max(op, seq) FILTER (op IN ('Create', 'Enable', 'Disable')) <> 'Disable' AS enabled FROM c GROUP BY tenant_id""")
def tenant_registry(j):
    """Tenants after a log of creations and changes."""
    e = F.col("event_type")
    op = F.when(F.col("sequence_number") == 1, "Create").when(e.isin(3, 7), "Disable").when(e.isin(1, 4), "Enable").when(e == 2, "Update").otherwise("Touch")
    return wt.configured(j.select("tenant_id", F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("at "), F.col("sequence_number").cast("string")).alias("settings")), ["tenant_id"])


@query("listing", sql="""WITH RECURSIVE m AS (SELECT path, row_number() OVER (PARTITION BY n ORDER BY path) AS r, n FROM (SELECT path, 'lost-' || (length % 40) || CASE WHEN length % 3 = 0 THEN '' ELSE '.dat' END AS n FROM listing WHERE presence = 'present' AND path LIKE '%/Incoming/%')),
      there AS (SELECT DISTINCT 'lost-' || (length % 40) || '.dat' AS n FROM listing WHERE length % 5 = 0),
      names AS (SELECT n, n AS target, 0 AS i FROM (SELECT DISTINCT n FROM m) UNION ALL SELECT n, CASE WHEN contains(target, '.') THEN string_split(target, '.')[1] || '_' || (i + 1) || '.dat' ELSE target || '_' || (i + 1) END, i + 1 FROM names WHERE i < 400)
    SELECT m.path, '/done/' || names.target AS target_path FROM m LEFT JOIN there ON there.n = m.n JOIN names ON names.n = m.n AND names.i = m.r - 1 + CASE WHEN there.n IS NULL THEN 0 ELSE 1 END""")
def import_targets(l):  # noqa: E741
    """Imported files moved to one folder, where some of their names are taken, under names of few kinds."""
    name = F.concat(F.lit("lost-"), (F.col("length") % 40).cast("string"))
    there = l.where("length % 5 = 0").select(F.concat(F.lit("/done/"), name, F.lit(".dat")).alias("path")).distinct()
    moved = l.where("presence = 'present' and path like '%/Incoming/%'").select("path", F.concat(F.lit("/in/"), F.col("path"), F.lit("/"), name, F.when(F.col("length") % 3 == 0, "").otherwise(".dat")).alias("as_named"))
    # Files come in order of their paths within a name.
    ordered = moved.withColumn("ordinal", F.row_number().over(Window.partitionBy(paths.file_name(F.col("as_named"))).orderBy("path")))
    return wt.import_targets(ordered.select(F.col("as_named").alias("path"), "ordinal"), there, "/done").select(F.regexp_replace(F.substring("path", 5, 10_000), "/[^/]*$", "").alias("path"), "target_path")


_SEEN = """s AS (SELECT f.*, presence, mount_path, CASE f.volume_id WHEN 'vol-2' THEN 1 WHEN 'vol-3' THEN 0 END AS disposition FROM files f LEFT JOIN listing l ON l.tenant_id = f.tenant_id AND l.path = f.physical_path LEFT JOIN (SELECT volume_id, mount_path FROM volumes WHERE volume_id NOT IN ('vol-0', 'vol-2')) v ON v.volume_id = f.volume_id
      WHERE status = 4 AND last_failed_at < TIMESTAMP '1996-06-01'),
    a AS (SELECT *, CASE WHEN presence = 'unknown' OR (presence IS NULL AND mount_path IS NULL) THEN CASE WHEN disposition = 1 THEN 'purge_metadata' ELSE 'blocked: presence unknown' END WHEN mount_path IS NULL THEN 'blocked: no volume' ELSE 'act' END AS action FROM s)"""


def _failed(f, l, v, disposition):  # noqa: E741
    retired = v.sparkSession.createDataFrame([("vol-2", 1), ("vol-3", 0)], "volume_id string, disposition int")
    return fl.failed_dispositions(f, l, v.where("volume_id not in ('vol-0', 'vol-2')"), retired, _ts("1996-06-01 00:00:00"), disposition, _ts(NOW))


@query("files", "listing", "volumes", sql=f"""WITH {_SEEN} SELECT tenant_id, file_key, volume_id, CASE WHEN action = 'act' THEN 'dead_letter' ELSE action END AS action,
    CASE WHEN action = 'act' THEN CASE WHEN presence = 'present' THEN mount_path || '/.deadletter/' || tenant_id || '/19970101/' || file_key[1:2] || '/' || file_key[3:4] || '/' || file_key || file_extension ELSE physical_path END END AS target_path,
    CASE action WHEN 'act' THEN 7 WHEN 'purge_metadata' THEN 6 ELSE 4 END AS next_status, 0::BIGINT AS bytes_freed FROM a""")
def cleanup_failed_dead_letter(f, l, v):  # noqa: E741
    """Permanently failed rows to dead letters: files there, missing and of unknown presence, volumes registered, retired and gone."""
    return _failed(f, l, v, "dead_letter")


@query("files", "listing", "volumes", sql=f"""WITH {_SEEN} SELECT tenant_id, file_key, volume_id, CASE WHEN action = 'act' THEN 'delete' ELSE action END AS action, CAST(NULL AS VARCHAR) AS target_path, CASE WHEN action IN ('act', 'purge_metadata') THEN 6 ELSE 4 END AS next_status,
    CASE WHEN action = 'act' AND presence = 'present' THEN file_size ELSE 0 END AS bytes_freed FROM a""")
def cleanup_failed_delete(f, l, v):  # noqa: E741
    return _failed(f, l, v, "delete")


@query("files", "listing", "volumes", sql=f"""WITH {_SEEN} SELECT CASE WHEN action = 'act' THEN 'blocked: kept' ELSE action END AS action, count(*) AS n FROM a GROUP BY 1""")
def cleanup_failed_keep(f, l, v):  # noqa: E741
    return _failed(f, l, v, "keep").groupBy("action").agg(F.count("*").alias("n"))


@query("files", "listing", "volumes", sql=f"""WITH {_SEEN} SELECT tenant_id, file_key, CASE WHEN action = 'act' THEN 'delete' ELSE action END AS action, 6 AS next_status, CASE WHEN action = 'act' AND presence = 'present' THEN file_size ELSE 0 END AS bytes_freed FROM a WHERE action IN ('act', 'purge_metadata')
    UNION ALL SELECT tenant_id, file_key, 'reset', 0, 0 FROM files WHERE status = 1 AND processing_start_time < TIMESTAMP '{NOW}' - INTERVAL 1 DAY""")
def cleanup_status_combined(f, l, v):  # noqa: E741
    """Timed-out rows reset and failed ones deleted in one set of changes."""
    return fl.status_cleanup(f, _failed(f, l, v, "delete"), _ts(NOW), 86400)


@query("files", sql="SELECT DISTINCT volume_id, cast((epoch_us(created_at) - epoch_us(date_trunc('day', created_at))) * 10 AS BIGINT) AS ticks, (epoch_us(created_at) - epoch_us(date_trunc('day', created_at))) / 1000.0::DOUBLE AS ms FROM files")
def tick_durations(f):
    ticks = (F.unix_micros(F.col("created_at").cast("timestamp")) - F.unix_micros(F.date_trunc("day", F.col("created_at")).cast("timestamp"))) * 10
    return f.select("volume_id", ticks.alias("ticks")).distinct().withColumn("ms", tm.milliseconds(F.col("ticks")))


@query("files", sql="""SELECT file_key, CASE WHEN retry_count = 0 THEN NULL ELSE '{"queue.flag":"' || CASE WHEN retry_count % 2 = 0 THEN 'True' ELSE 'False' END || '","n":"' || status || '"}' END AS json, retry_count IN (2, 4) AS was_set, CASE WHEN retry_count = 0 THEN 'on' ELSE 'n,on' END AS with_keys, CASE WHEN retry_count = 0 THEN '' ELSE 'n' END AS without_keys FROM files""")
def metadata_maps(f):
    """Maps of strings to JSON text and back, and flags in them set and cleared."""
    value = F.when(F.col("retry_count") % 2 == 0, "True").otherwise("False")
    m = F.when(F.col("retry_count") > 0, F.create_map(F.lit("queue.flag"), value, F.lit("n"), F.col("status").cast("string")))
    rows = f.select("file_key", tm.map_to_json(m).alias("json")).withColumn("back", tm.map_from_json(F.col("json")))
    names = lambda x: F.array_join(F.array_sort(F.map_keys(x)), ",")
    cleared = tm.with_flag(F.col("back"), "queue.flag", None)
    return rows.select("file_key", "json", tm.flag(F.col("back"), "queue.flag").alias("was_set"), names(tm.with_flag(cleared, "on", "True")).alias("with_keys"), names(cleared).alias("without_keys"))


@query("files", sql="SELECT f.tenant_id, f.file_key, status, retry_count FROM files f JOIN (SELECT DISTINCT tenant_id, file_key FROM files WHERE file_size % 1000 < 3) w USING (tenant_id, file_key)")
def files_point_lookup(f):
    """Rows of wanted tenants and keys, one of which isn't there."""
    wanted = f.where("file_size % 1000 < 3").select("tenant_id", "file_key").unionByName(f.where("file_size % 1000 < 3").select(F.lit("nobody").alias("tenant_id"), "file_key"))
    return fl.looked_up(f, wanted).select("tenant_id", "file_key", "status", "retry_count")


@query("files", sql="SELECT tenant_id, file_key, status, tenant_id AS lease_tenant, file_key AS lease_key, processing_start_time AS lease_start FROM files WHERE status = 1")
def files_leased_locations(f):
    """Rows in work with the lease that belongs to each."""
    return fl.locations(f.where("status = 1")).select("tenant_id", "file_key", "status", F.col("lease.tenant_id").alias("lease_tenant"), F.col("lease.file_key").alias("lease_key"), F.col("lease.processing_start_time").alias("lease_start"))


@query("files", "listing", sql="SELECT path, EXISTS (SELECT 1 FROM files WHERE physical_path = path AND status IN (0, 1, 3)) AS hot FROM listing")
def files_exist_by_path(f, l):  # noqa: E741
    hot = fl.hot(f).select(F.col("physical_path").alias("path"), F.lit(True).alias("hot"))
    return l.select("path").join(hot, "path", "left").select("path", F.coalesce("hot", F.lit(False)).alias("hot"))


_TIMES = "(({x})::UHUGEINT * {by}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"
_FOLD = "xor({x}, ({x}) >> 33)"


@query("files", sql=f"""WITH a AS (SELECT file_key, xor(xor((file_size % 65536)::UBIGINT << 32, (file_size // 7)::UBIGINT), 11400714819323198485::UBIGINT) AS x FROM files),
    b AS (SELECT file_key, {_TIMES.format(x=_FOLD.format(x="x"), by="18397679294719823053")} AS x FROM a), c AS (SELECT file_key, {_TIMES.format(x=_FOLD.format(x="x"), by="14181476777654086739")} AS x FROM b)
    SELECT file_key AS uuid, lpad(lower(to_hex({_FOLD.format(x="x")} & 65535)), 4, '0') || file_key[5:] AS generated FROM c""")
def generated_keys(f):
    """Keys from a uuid, a seed and the ordinal of a batch of writes: keys of one batch share their shards."""
    return f.select(F.col("file_key").alias("uuid"), paths.generated_key(F.col("file_key"), F.col("file_size") % 65536, F.floor(F.col("file_size") / 7)).alias("generated"))
