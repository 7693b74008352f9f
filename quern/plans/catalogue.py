"""The library's queries over the driver's tables, and their SQL twins.

Constants (dates, limits, page sizes) are parameters of the queries and the same in the twins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import paths
from ..functions.time import retry_delay
from ..operators import files as fl, journal as jn, projection as pj, quota as qt, reconcile as rc, statistics as st, watch as wt
from ..schema import DIMENSIONS, TOTALS
from . import fold_twin
from .views import twin, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "projection_fold"

NOW, FROM, TO, STATS_NOW = "1997-01-01 00:00:00", "2024-01-05 00:02:00", "2024-01-20 00:00:00", "2024-01-25 00:00:00"
SPAN = 15 * 86400 - 120.0
_D = ", ".join(DIMENSIONS)


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


def query(*views: str, sql: str | None = None):
    """Registers a query over ``views``, which it gets as DataFrames, and its twin."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(view(spark, sf_dir, v) for v in views))
        if sql is not None:
            text = sql.strip()
            recursive, own = text.startswith("WITH RECURSIVE "), text.removeprefix("WITH RECURSIVE ").removeprefix("WITH ")
            ORACLE_SQL[f.__name__] = twin(*views, recursive=recursive) + (", " + own if own != text else " " + text)
        return f

    return register


# --- statistics -------------------------------------------------------------------------------------


def _cells(width: int = 300, dims: tuple[str, ...] = DIMENSIONS) -> str:
    kept = ", ".join(d if d in dims else f"NULL::VARCHAR AS {d}" for d in DIMENSIONS)
    return f"""WITH c AS (SELECT bucket_start, name, {_D}, cast(sum(value) AS BIGINT) AS value FROM (
        SELECT time_bucket(INTERVAL '{width} seconds', ts, TIMESTAMP '0001-01-01') AS bucket_start, name, value, {kept} FROM measurements WHERE value <> 0 AND trim(name) <> '') GROUP BY ALL)"""


_OVERLAP = f"WHERE bucket_start + INTERVAL '300 seconds' > TIMESTAMP '{FROM}' AND bucket_start < TIMESTAMP '{TO}'"


@query("measurements", sql=_cells() + " SELECT * FROM c")
def stats_buckets(m):
    return st.recorded(m)


@query("measurements", sql=_cells(420) + " SELECT * FROM c")
def stats_offset_window_7min(m):
    return st.recorded(m, 420)


@query("measurements", sql=_cells(dims=("volume_id",)) + f" SELECT name, {_D}, cast(sum(value) AS BIGINT) AS value FROM c {_OVERLAP} GROUP BY name, {_D}")
def stats_dimension_disabled(m):
    return st.snapshot_measurements(st.overlapping(st.recorded(m, dimensions=("volume_id",)), _ts(FROM), _ts(TO)))


@query("measurements", sql=_cells() + f" SELECT name, {_D}, cast(sum(value) AS BIGINT) AS value FROM c {_OVERLAP} AND tenant_id = 'tenant-003' GROUP BY name, {_D}")
def stats_snapshot_measurements(m):
    return st.snapshot_measurements(st.overlapping(st.recorded(m), _ts(FROM), _ts(TO), tenant_id="tenant-003", volume_id=None, operation=""))


_TOTALS = ", ".join(f"cast(coalesce(sum(value) FILTER (name = '{m}'), 0) AS BIGINT) AS {t}" for t, m in TOTALS.items())


@query("measurements", sql=_cells() + f", t AS (SELECT {_TOTALS} FROM c {_OVERLAP}) SELECT *, write_bytes / 1024 / 1024 / {SPAN}::DOUBLE AS write_megabytes_per_second FROM t")
def stats_snapshot_totals(m):
    return st.snapshot_totals(st.overlapping(st.recorded(m), _ts(FROM), _ts(TO)), SPAN)


@query("measurements", sql=_cells() + f", t AS (SELECT volume_id, cast(sum(value) AS BIGINT) AS write_bytes FROM c {_OVERLAP} AND name = 'storage.write.bytes' GROUP BY volume_id) SELECT *, write_bytes / 1024 / 1024 / {SPAN}::DOUBLE AS write_megabytes_per_second FROM t")
def stats_rate_by_volume(m):
    return st.rates(st.overlapping(st.recorded(m), _ts(FROM), _ts(TO)), SPAN, "volume_id")


@query("measurements", sql=_cells() + f" SELECT * FROM c WHERE bucket_start >= TIMESTAMP '{STATS_NOW}' - INTERVAL '{7 * 86400 + 300} seconds'")
def stats_retention_prune(m):
    return st.pruned(st.recorded(m), _ts(STATS_NOW), 7 * 86400)


@query("measurements", sql=f"""WITH k AS (SELECT *, time_bucket(INTERVAL '300 seconds', ts, TIMESTAMP '0001-01-01') AS bucket_start FROM measurements WHERE value <> 0 AND trim(name) <> ''),
    s AS (SELECT bucket_start, name, {_D}, min(arrival) AS first, cast(sum(value) AS BIGINT) AS value FROM k GROUP BY bucket_start, name, {_D}) SELECT bucket_start, name, {_D}, value FROM s ORDER BY first LIMIT 1024""")
def stats_series_cap(m):
    return st.capped(m, 1024)


@query("measurements", sql=f"""WITH k AS (SELECT *, time_bucket(INTERVAL '300 seconds', ts, TIMESTAMP '0001-01-01') AS bucket_start FROM measurements WHERE value <> 0 AND trim(name) <> ''),
    s AS (SELECT bucket_start, name, {_D}, min(arrival) AS first, cast(sum(value) AS BIGINT) AS value FROM k WHERE bucket_start >= TIMESTAMP '{STATS_NOW}' - INTERVAL '{7 * 86400 + 300} seconds' GROUP BY bucket_start, name, {_D}) SELECT bucket_start, name, {_D}, value FROM s ORDER BY first LIMIT 300""")
def stats_series_cap_after_prune(m):
    """Series that are pruned take no place under the cap."""
    return st.capped(m, 300, now=_ts(STATS_NOW), retention=7 * 86400)


_BOUNDS = [5.0, 50.0, 500.0, 5000.0]


@query("measurements", sql="SELECT name, count(value) AS n, cast(sum(value) AS BIGINT) AS total, min(value) AS least, max(value) AS greatest, concat_ws(',', count(*) FILTER (value <= 5), count(*) FILTER (value > 5 AND value <= 50), count(*) FILTER (value > 50 AND value <= 500), count(*) FILTER (value > 500 AND value <= 5000), count(*) FILTER (value > 5000)) AS buckets FROM measurements GROUP BY name")
def stats_instruments(m):
    return st.instrument_totals(m, _BOUNDS).withColumn("buckets", F.concat_ws(",", F.col("buckets").cast("array<string>")))


@query("measurements", sql="SELECT name, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM measurements GROUP BY name")
def stats_quantiles(m):
    return st.quantiles(m, [0.5, 0.95, 0.99], 1_000_000)


_LINE = "'Statistics summary: Window=15d, WriteFiles=' || write_success_count || ', WriteMBps=' || printf('%.3f', write_bytes / 1024 / 1024 / {span}::DOUBLE) || ', WriteBytes=' || write_bytes || ', DequeuedFiles=' || dequeued_count || ', ReadFiles=' || read_count || ', CompletedFiles=' || completed_count || ', SqliteOps=' || persisted_operations || ', WatcherImportedFiles=' || imported_count || ', WatcherImportedBytes=' || imported_bytes"


@query("measurements", sql=_cells() + f", t AS (SELECT {_TOTALS} FROM c {_OVERLAP}) SELECT {_LINE.format(span=SPAN)} AS line FROM t")
def stats_summary_line(m):
    """The line of a window with measurements; one without has none."""
    cells = st.recorded(m)
    empty = st.snapshot_totals(st.overlapping(cells, _ts("1990-01-01 00:00:00"), _ts("1990-01-02 00:00:00")), 86400.0)
    return st.summary_line(st.snapshot_totals(st.overlapping(cells, _ts(FROM), _ts(TO)), SPAN), "15d").unionByName(st.summary_line(empty, "15d"))


@query("measurements", sql="SELECT operation, count(*) AS batches, count(*) FILTER (value = 1) AS single_batches, count(*) FILTER (value > 1) AS multi_batches, cast(sum(value) AS BIGINT) AS records, max(value) AS largest FROM measurements GROUP BY operation")
def stats_operation_log(m):
    return st.operation_log_totals(m)


# --- journal and projection -------------------------------------------------------------------------


_normal, _steps = fold_twin.normal, fold_twin.steps
_ROW = ", ".join(pj.ROW)
_FILES = f"SELECT t AS tenant_id, k AS file_key, {_ROW} FROM final WHERE alive"


@query("journal", sql=f"{_steps()} {_FILES}")
def projection_fold(j):
    return pj.projected_files(j)


@query("journal", sql=f"{_steps()} SELECT t AS tenant_id, status, count(*) AS n, cast(sum(file_size) AS BIGINT) AS bytes, count(*) FILTER (status IN (0, 1, 2, 3, 4, 5)) AS active FROM final WHERE alive GROUP BY ALL")
def projection_status_counts(j):
    return fl.status_counts(pj.projected_files(j))


@query("journal", sql=f"{_steps(copies=2)} {_FILES}")
def projection_duplicate_delivery(j):
    """Every event delivered twice in place."""
    return pj.projected_files(j.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("sequence_number", F.col("sequence_number") * 2 + F.col("copy")).drop("copy"))


@query("journal", sql=f"{_steps()} {_FILES}")
def projection_snapshot_tail(j):
    """A snapshot of the first events, and the fold of the rest from there: as a full replay."""
    return pj.projected_files(j.where("sequence_number > 60"), pj.folded(j.where("sequence_number <= 60")))


_UNKNOWN = "SELECT * REPLACE (CASE WHEN event_id % 301 = 7 THEN NULL ELSE physical_present END AS physical_present) FROM journal"
_WAIT = """, w AS (SELECT t AS tenant_id, min(waits_at) AS deferred_at FROM final WHERE waits_at IS NOT NULL GROUP BY t), pl AS (SELECT tenant_id, sequence_number, (row_number() OVER (PARTITION BY tenant_id ORDER BY sequence_number) - 1) // 16 AS b FROM journal),
    h AS (SELECT pl.tenant_id, deferred_at, b FROM pl JOIN w ON w.tenant_id = pl.tenant_id AND sequence_number = deferred_at), u AS (SELECT h.tenant_id, h.deferred_at, coalesce(max(sequence_number), 0) AS applied_until FROM h LEFT JOIN pl ON pl.tenant_id = h.tenant_id AND pl.b < h.b GROUP BY ALL)"""


def _unknown(j: DataFrame) -> DataFrame:
    return j.withColumn("physical_present", F.when(F.col("event_id") % 301 != 7, F.col("physical_present")))


@query("journal", sql=f"{_steps(_UNKNOWN)}{_WAIT} SELECT * FROM u")
def projection_deferred(j):
    """Tenants whose batch of 16 records waits, as it would make a row of a file of unknown presence."""
    return pj.deferred(_unknown(j), 16)


@query("journal", sql=f"{_steps(_UNKNOWN)}{_WAIT}, l AS (SELECT st.* FROM st LEFT JOIN u ON u.tenant_id = st.t WHERE u.tenant_id IS NULL OR seq <= applied_until QUALIFY row_number() OVER (PARTITION BY t, k ORDER BY n DESC) = 1) SELECT t AS tenant_id, k AS file_key, {_ROW} FROM l WHERE alive")
def projection_until_deferred(j):
    return pj.projected_until_deferred(_unknown(j), 16)


@query("journal", "quotas", sql=f"""{_steps()}, f AS (SELECT t AS tenant_id, directory_path, status FROM final WHERE alive AND status IN (0, 1, 2, 3, 4, 5)), expected AS (SELECT tenant_id, directory_path, count(*) AS expected FROM f GROUP BY ALL UNION ALL SELECT tenant_id, tenant_id, count(*) FROM f GROUP BY tenant_id)
    SELECT tenant_id, directory_path, coalesce(expected, 0) AS expected, coalesce(current_count, 0) AS current, coalesce(max_count, 0) AS max_count,
    CASE WHEN coalesce(expected, 0) = 0 AND coalesce(max_count, 0) = 0 AND directory_path <> tenant_id THEN 'remove' WHEN current_count IS NULL OR coalesce(expected, 0) <> current_count THEN 'set' ELSE 'keep' END AS action FROM expected FULL JOIN quotas USING (tenant_id, directory_path)""")
def projection_rebuild(j, q):
    """Rebuilt from a snapshot and the tail behind it, and what then becomes of the quota rows."""
    return pj.rebuilt(j, pj.folded(j.where("sequence_number <= 60")), 60, q)[1]


_STEPS = """, steps AS (SELECT t AS tenant_id, seq, n, plus_in AS directory_path, 1 AS d FROM st WHERE plus_in IS NOT NULL UNION ALL SELECT t, seq, n, minus_in, -1 FROM st WHERE minus_in IS NOT NULL),
  both_ AS (SELECT * FROM steps UNION ALL SELECT tenant_id, seq, n, tenant_id, d FROM steps)"""


@query("journal", sql=f"""{_steps()}{_STEPS} SELECT tenant_id, directory_path, list_reduce(list(d ORDER BY seq, d), lambda a, x: greatest(0, a + x), 0)::BIGINT AS current_count FROM both_ GROUP BY tenant_id, directory_path""")
def quota_event_sourced(j):
    return pj.quota_counts(j)


@query("journal", sql="SELECT DISTINCT tenant_id FROM journal ORDER BY tenant_id")
def journal_tenants(j):
    return j.select("tenant_id").distinct().orderBy("tenant_id")


_EVENT = "tenant_id, sequence_number, file_key, event_type, occurred_at"


_OFFSETS = """o AS (SELECT *, 24 + length(file_key) + length(physical_path) AS bytes, sum(24 + length(file_key) + length(physical_path)) OVER (PARTITION BY tenant_id ORDER BY sequence_number) AS end_offset FROM journal)"""


def _placed(j: DataFrame) -> DataFrame:
    return jn.with_offsets(j.withColumn("record_bytes", 24 + F.length("file_key") + F.length("physical_path")))


@query("journal", sql=f"WITH {_OFFSETS} SELECT {_EVENT} FROM o WHERE tenant_id = 'tenant-002' AND end_offset > 750 ORDER BY sequence_number LIMIT 64")
def journal_read_batch(j):
    """From an offset inside a record: that record is the first."""
    return jn.read_batch(_placed(j), "tenant-002", 750, 64)[0].select(*_EVENT.split(", "))


@query("journal", sql=f"""WITH {_OFFSETS}, w AS (SELECT * FROM (VALUES ('inside', 'tenant-002', 777, 300, 5), ('before the base', 'tenant-003', 0, 400, 3), ('behind the end', 'tenant-004', 99999999, 0, 5), ('to the end', 'tenant-005', 0, 0, 1000000), ('no journal', 'nobody', 500, 0, 5)) v(name, tenant, off, base, most)),
    b AS (SELECT name, greatest(off, base) AS off, end_offset, row_number() OVER (PARTITION BY name ORDER BY end_offset) AS r, most, max(end_offset) OVER (PARTITION BY name) AS last_of_rest FROM w LEFT JOIN o ON o.tenant_id = tenant AND end_offset > greatest(off, base))
    SELECT name, cast(CASE WHEN max(last_of_rest) IS NULL THEN least(max(off), coalesce((SELECT max(end_offset) FROM o JOIN w ON o.tenant_id = w.tenant WHERE w.name = b.name), (SELECT max(base) FROM w WHERE w.name = b.name))) ELSE max(end_offset) FILTER (r <= most) END AS BIGINT) AS next_offset,
      coalesce(max(end_offset) FILTER (r <= most) >= max(last_of_rest), TRUE) AS reached_eof FROM b GROUP BY name""")
def journal_read_state(j):
    """Where a batch ends and whether that is the end, for offsets inside a record, before the base, behind the end, and a tenant without a journal."""
    placed, out = _placed(j), None
    for name, tenant, offset, base, most in (("inside", "tenant-002", 777, 300, 5), ("before the base", "tenant-003", 0, 400, 3), ("behind the end", "tenant-004", 99_999_999, 0, 5), ("to the end", "tenant-005", 0, 0, 1_000_000), ("no journal", "nobody", 500, 0, 5)):
        one = jn.read_batch(placed, tenant, offset, most, base)[1].select(F.lit(name).alias("name"), "next_offset", "reached_eof")
        out = one if out is None else out.unionByName(one)
    return out


_GAPS = """g AS (SELECT *, max(sequence_number) OVER (PARTITION BY tenant_id ORDER BY sequence_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM journal WHERE sequence_number > 0)"""


@query("journal", sql=f"WITH {_GAPS} SELECT tenant_id, last + 1 AS expected_sequence, sequence_number AS observed_sequence FROM g WHERE last > 0 AND sequence_number > last + 1")
def journal_gap_audit(j):
    return pj.sequence_gaps(j)


@query("journal", sql=f"""WITH {_GAPS}, gaps AS (SELECT tenant_id, max(sequence_number) AS gap_observed, max(last + 1) AS gap_expected FROM g WHERE sequence_number <= 80 AND last > 0 AND sequence_number > last + 1 GROUP BY tenant_id),
    t AS (SELECT tenant_id, max(sequence_number) AS tail_sequence, max(sequence_number) FILTER (sequence_number <= 80) AS last_projected FROM journal GROUP BY tenant_id)
    SELECT tenant_id, tail_sequence, last_projected, greatest(0, tail_sequence - coalesce(last_projected, 0)) AS lag, gap_observed IS NOT NULL AS gap_detected, gap_expected, gap_observed FROM t LEFT JOIN gaps USING (tenant_id)""")
def journal_lag_state(j):
    return pj.tenant_state(j, 80)


@query("journal", sql=f"""WITH bad AS (SELECT tenant_id, min(sequence_number) AS first FROM journal WHERE event_id % 997 = 5 GROUP BY tenant_id)
    SELECT {_EVENT} FROM journal LEFT JOIN bad USING (tenant_id) WHERE first IS NULL OR sequence_number < first""")
def journal_corrupt_prefix(j):
    """Records before a tenant's first bad one; from there on nothing is read."""
    return jn.valid_prefix(j, F.col("event_id") % 997 == 5).select(*_EVENT.split(", "))


@query("journal", sql="""WITH o AS (SELECT *, 24 + length(file_key) + length(physical_path) AS bytes FROM journal),
    c AS (SELECT tenant_id, sequence_number, sum(bytes) OVER (PARTITION BY tenant_id ORDER BY sequence_number ROWS UNBOUNDED PRECEDING) AS end_offset, bytes FROM o)
    SELECT tenant_id, cast(end_offset - bytes AS BIGINT) AS start_offset, cast(end_offset AS BIGINT) AS end_offset, sequence_number FROM c WHERE end_offset > 1000""")
def journal_compaction(j):
    """Records behind a processed offset with their logical offsets, which compaction doesn't change."""
    return jn.compacted(_placed(j), 1000).select("tenant_id", "start_offset", "end_offset", "sequence_number")


@query("journal", sql="""WITH o AS (SELECT *, 24 + length(file_key) + length(physical_path) AS bytes FROM journal),
    c AS (SELECT tenant_id, sum(bytes) OVER (PARTITION BY tenant_id ORDER BY sequence_number ROWS UNBOUNDED PRECEDING) AS end_offset FROM o)
    SELECT tenant_id, cast(coalesce(max(end_offset) FILTER (end_offset <= 777), 0) AS BIGINT) AS normalized_offset FROM c GROUP BY tenant_id""")
def journal_offset_normalized(j):
    return jn.normalized_offset(_placed(j), 777)


# --- quotas -----------------------------------------------------------------------------------------

_EXPECTED = f"""WITH a AS (SELECT tenant_id, {_normal("directory_path")} AS directory FROM files WHERE status IN (0, 1, 2, 3, 4, 5)),
  expected AS (SELECT tenant_id, directory AS directory_path, count(*) AS expected FROM a GROUP BY ALL UNION ALL SELECT tenant_id, tenant_id, count(*) FROM a GROUP BY tenant_id)"""


@query("files", sql=_EXPECTED + " SELECT * FROM expected")
def quota_expected_dirs(f):
    return qt.expected_counts(f)


@query("files", "quotas", sql=_EXPECTED + """ SELECT tenant_id, directory_path, coalesce(expected, 0) AS expected, coalesce(current_count, 0) AS current, coalesce(max_count, 0) AS max_count,
    CASE WHEN coalesce(expected, 0) = 0 AND coalesce(max_count, 0) = 0 AND directory_path <> tenant_id THEN 'remove' WHEN current_count IS NULL OR coalesce(expected, 0) <> current_count THEN 'set' ELSE 'keep' END AS action
    FROM expected FULL JOIN quotas USING (tenant_id, directory_path)""")
def quota_reconcile_actions(f, q):
    return qt.reconciled(f, q)


_OLD = "1996-01-01 00:00:00"


def _dated(q: DataFrame) -> DataFrame:
    return q.withColumn("last_updated", _ts(_OLD)).withColumn("created_at", _ts(_OLD))


@query("files", "quotas", sql=_EXPECTED + f""" SELECT tenant_id, directory_path, coalesce(expected, 0) AS current_count, coalesce(max_count, 0) AS max_count, coalesce(enabled, FALSE) AS enabled,
    CASE WHEN current_count = coalesce(expected, 0) THEN TIMESTAMP '{_OLD}' ELSE TIMESTAMP '{NOW}' END AS last_updated, CASE WHEN current_count IS NULL THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '{_OLD}' END AS created_at
    FROM expected FULL JOIN quotas USING (tenant_id, directory_path) WHERE NOT (coalesce(expected, 0) = 0 AND coalesce(max_count, 0) = 0 AND directory_path <> tenant_id)""")
def quota_reconciled_table(f, q):
    return qt.applied(_dated(q), qt.reconciled(f, q), _ts(NOW))


@query("files", "quotas", sql="""WITH live AS (SELECT tenant_id, '/' AS directory_path, count(*) AS live_count FROM files WHERE status = 0 GROUP BY tenant_id)
    SELECT tenant_id, directory_path, coalesce(live_count, current_count) AS current_count, coalesce(max_count, 0) AS max_count, coalesce(enabled, FALSE) AS enabled FROM quotas FULL JOIN live USING (tenant_id, directory_path)""")
def quota_live_counts(f, q):
    """Stored rows under the counts that are live."""
    live = f.where("status = 0").groupBy("tenant_id").agg(F.count("*").alias("live_count")).withColumn("directory_path", F.lit("/"))
    return qt.overridden(q, live)


@query("quotas", "tenants", sql=f"""WITH ch AS (SELECT tenant_id, tenant_id AS directory_path, CASE WHEN status = 2 THEN NULL ELSE tenant_limit END AS new_max FROM tenants UNION ALL SELECT tenant_id, '/stale', 7 FROM tenants)
    SELECT coalesce(q.tenant_id, ch.tenant_id) AS tenant_id, coalesce(q.directory_path, ch.directory_path) AS directory_path, coalesce(current_count, 0) AS current_count, CASE WHEN ch.tenant_id IS NULL THEN max_count ELSE coalesce(new_max, 0) END AS max_count,
      CASE WHEN ch.tenant_id IS NULL THEN enabled WHEN ch.directory_path = ch.tenant_id THEN coalesce(new_max, 0) > 0 ELSE TRUE END AS enabled,
      CASE WHEN ch.tenant_id IS NULL THEN TIMESTAMP '{_OLD}' ELSE TIMESTAMP '{NOW}' END AS last_updated, CASE WHEN q.tenant_id IS NULL THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '{_OLD}' END AS created_at
    FROM quotas q FULL JOIN ch ON q.tenant_id = ch.tenant_id AND q.directory_path = ch.directory_path WHERE q.tenant_id IS NOT NULL OR new_max IS NOT NULL""")
def quota_set_limits(q, t):
    """Limits of tenants set, or taken away from disabled ones, and of one directory each."""
    own = t.select("tenant_id", F.col("tenant_id").alias("directory_path"), F.when(F.col("status") != 2, F.col("tenant_limit")).alias("new_max"))
    return qt.with_limits(_dated(q), own.unionByName(t.select("tenant_id", F.lit("/stale").alias("directory_path"), F.lit(7).cast("bigint").alias("new_max"))), _ts(NOW))


_SHARDS = "CASE WHEN regexp_matches(key, '^[0-9a-fA-F]{32}$') THEN CASE WHEN lower(d[1]) = lower(key[1:2]) THEN CASE WHEN lower(d[2]) = lower(key[3:4]) THEN CASE WHEN lower(d[3]) = lower(key[5:6]) THEN 3 ELSE 2 END ELSE 1 END ELSE 0 END ELSE 0 END"
# Below /mnt/volume/tenant; the name is the last segment.
_ON_DISK = f"""disk AS (SELECT *, string_split(path, '/') AS s, regexp_replace(s[-1], '\\.[^.]*$', '') AS key, s[5:-2] AS d, '/' || array_to_string(d[{_SHARDS} + 1:], '/') AS recovered FROM listing)"""


@query("listing", sql=f"""WITH {_ON_DISK}, c AS (SELECT tenant_id, recovered, count(*) AS current_count FROM disk WHERE presence <> 'missing' AND key <> '' GROUP BY ALL)
    SELECT tenant_id, recovered AS directory_path, current_count FROM c UNION ALL SELECT tenant_id, tenant_id, cast(sum(current_count) AS BIGINT) FROM c GROUP BY tenant_id""")
def quota_physical_counts(l):  # noqa: E741
    return qt.physical_counts(l, F.concat(F.lit("/mnt/"), "volume_id", F.lit("/"), "tenant_id"))


@query("quotas", sql="SELECT tenant_id, directory_path, NOT enabled OR max_count = 0 OR current_count + 3 < max_count AS can_add FROM quotas")
def quota_can_add(q):
    return qt.can_add(q, F.lit(3))


@query("tenants", sql="SELECT tenant_id, cast(coalesce(nullif(tenant_limit, 0), 25) AS BIGINT) AS effective_limit FROM tenants")
def quota_effective_limit(t):
    return qt.effective_limits(t, 25)


@query("journal", sql="""WITH k AS (SELECT tenant_id AS key, sequence_number AS seq, CASE WHEN event_type IN (1, 2) THEN 'reserve' WHEN event_type IN (4, 5) THEN 'accept' WHEN event_type = 6 THEN 'delete' WHEN event_type = 8 THEN 'undo_delete'
        WHEN event_type = 7 THEN CASE WHEN event_id % 2 = 0 THEN 'undo_accept' ELSE 'undo_accept_reserved' END ELSE 'release' END AS kind FROM journal),
    f AS (SELECT key, list_reduce(list(kind ORDER BY seq), lambda s, x: CASE x
      WHEN 'reserve' THEN {'p': s.p, 'r': s.r + CASE WHEN s.p + s.r < 12 THEN 1 ELSE 0 END, 'x': s.x + CASE WHEN s.p + s.r < 12 THEN 0 ELSE 1 END}
      WHEN 'accept' THEN {'p': s.p + 1, 'r': greatest(0, s.r - 1), 'x': s.x}
      WHEN 'delete' THEN {'p': greatest(0, s.p - 1), 'r': s.r, 'x': s.x} WHEN 'undo_delete' THEN {'p': s.p + 1, 'r': s.r, 'x': s.x}
      WHEN 'undo_accept' THEN {'p': greatest(0, s.p - 1), 'r': s.r, 'x': s.x} WHEN 'undo_accept_reserved' THEN {'p': greatest(0, s.p - 1), 'r': s.r + 1, 'x': s.x}
      ELSE {'p': CASE WHEN s.r > 0 THEN s.p ELSE greatest(0, s.p - 1) END, 'r': greatest(0, s.r - 1), 'x': s.x} END, {'p': 0, 'r': 0, 'x': 0}) AS s FROM k GROUP BY key)
    SELECT key, cast(s.p AS BIGINT) AS projected, cast(s.r AS BIGINT) AS reserved, cast(s.x AS BIGINT) AS rejected FROM f""")
def quota_reservations(j):
    undo = F.when(F.col("event_id") % 2 == 0, "undo_accept").otherwise("undo_accept_reserved")
    kind = F.when(F.col("event_type").isin(1, 2), "reserve").when(F.col("event_type").isin(4, 5), "accept").when(F.col("event_type") == 6, "delete").when(F.col("event_type") == 8, "undo_delete").when(F.col("event_type") == 7, undo).otherwise("release")
    return qt.reservations(j.select(F.col("tenant_id").alias("key"), F.col("sequence_number").alias("seq"), kind.alias("kind")), 12)


@query("journal", sql="""WITH k AS (SELECT tenant_id || '/' || volume_id AS key, sequence_number AS seq, CASE WHEN event_type IN (1, 2, 4) THEN 'increment' WHEN event_type IN (3, 5, 6) THEN 'decrement' ELSE 'force' END AS kind,
        CASE WHEN volume_id = 'vol-3' THEN 0 ELSE 2 END AS most, volume_id <> 'vol-2' AS enabled FROM journal),
    f AS (SELECT key, list_reduce(list({'k': kind, 'm': most, 'e': enabled} ORDER BY seq), lambda s, x: CASE
      WHEN x.k = 'decrement' THEN {'c': CASE WHEN s.c > 0 THEN s.c - 1 ELSE 0 END, 'x': s.x}
      WHEN x.k = 'increment' AND x.e AND x.m > 0 AND s.c >= x.m THEN {'c': s.c, 'x': s.x + 1} ELSE {'c': s.c + 1, 'x': s.x} END, {'c': 0, 'x': 0}) AS s FROM k GROUP BY key)
    SELECT key, cast(s.c AS BIGINT) AS current_count, cast(s.x AS BIGINT) AS rejected FROM f""")
def quota_increments(j):
    """Increments that a limit may reject, decrements and forced increments of a directory each."""
    kind = F.when(F.col("event_type").isin(1, 2, 4), "increment").when(F.col("event_type").isin(3, 5, 6), "decrement").otherwise("force")
    most, enabled = F.when(F.col("volume_id") == "vol-3", 0).otherwise(2), F.col("volume_id") != "vol-2"
    return qt.counted(j.select(F.concat_ws("/", "tenant_id", "volume_id").alias("key"), F.col("sequence_number").alias("seq"), kind.alias("kind"), most.alias("max_count"), enabled.alias("enabled")))


# --- file table -------------------------------------------------------------------------------------

_F = "tenant_id, file_key, status, file_size, created_at"


def _cols(df: DataFrame, names: str) -> DataFrame:
    return df.select(*names.split(", "))


@query("files", sql=f"SELECT {_F} FROM files WHERE tenant_id = 'tenant-005' ORDER BY created_at, file_key OFFSET 10 LIMIT 25")
def files_by_tenant_page(f):
    return _cols(fl.page(f, "tenant-005", 10, 25), _F)


@query("files", sql=f"SELECT {_F} FROM files WHERE status = 4")
def files_by_status(f):
    return _cols(fl.by_status(f, 4), _F)


@query("files", sql="SELECT tenant_id, file_key, status, CASE WHEN status IN (0, 1, 3) THEN retry_count + 100 ELSE retry_count END AS retry_count FROM files")
def files_hot_cold_overlay(f):
    f = _cols(f, "tenant_id, file_key, status, retry_count")
    return fl.overlaid(fl.hot(f).withColumn("retry_count", F.col("retry_count") + 100), f)


@query("journal", sql="""WITH o AS (SELECT tenant_id, file_key, CASE WHEN event_type = 6 THEN 'Delete' ELSE 'Upsert' END AS op, event_type, sequence_number,
    row_number() OVER (PARTITION BY tenant_id, file_key ORDER BY sequence_number DESC) AS r FROM journal) SELECT tenant_id, file_key, op, event_type, sequence_number FROM o WHERE r = 1 AND op <> 'Delete'""")
def files_latest_op(j):
    ops = j.select("tenant_id", "file_key", F.when(F.col("event_type") == 6, "Delete").otherwise("Upsert").alias("op"), "event_type", "sequence_number")
    return fl.latest(ops, ["tenant_id", "file_key"], "sequence_number")


_READY = f"status = 0 AND (available_at IS NULL OR available_at <= TIMESTAMP '{NOW}')"


def _next(k: int) -> str:
    return f"SELECT {_F}, rank FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at, file_key) AS rank FROM files WHERE {_READY}) WHERE rank <= {k}"


@query("files", sql=_next(1))
def sched_next_pending(f):
    return _cols(fl.next_pending(f, _ts(NOW)), _F + ", rank")


@query("files", sql=_next(8))
def sched_next_batch(f):
    return _cols(fl.next_pending(f, _ts(NOW), 8), _F + ", rank")


@query("files", sql=f"SELECT {_F}, available_at FROM files WHERE status = 0 AND available_at > TIMESTAMP '{NOW}' ORDER BY available_at, created_at, file_key LIMIT 64")
def sched_delayed_queue(f):
    return _cols(fl.delayed(f, _ts(NOW), 64), _F + ", available_at")


@query("files", sql="SELECT DISTINCT retry_count, least(5.0::DOUBLE * pow(2.0, greatest(0, least(retry_count - 1, 62))), 300.0::DOUBLE) AS delay_seconds FROM files")
def sched_retry_delay(f):
    return f.select("retry_count").distinct().withColumn("delay_seconds", retry_delay(F.col("retry_count")))


@query("files", sql=f"""SELECT tenant_id, file_key, CASE WHEN retry_count + 1 >= 3 THEN 4 ELSE 0 END AS status, retry_count + 1 AS retry_count,
    CASE WHEN retry_count + 1 < 3 THEN TIMESTAMP '{NOW}' + to_seconds(least(5.0 * pow(2.0, retry_count), 300.0)) END AS available_at, processing_start_time AS released_lease FROM files WHERE status = 1""")
def sched_fail_transition(f):
    return _cols(fl.failed_once_more(f, _ts(NOW)), "tenant_id, file_key, status, retry_count, available_at, released_lease")


_LATE = f"status = 1 AND processing_start_time < TIMESTAMP '{NOW}' - INTERVAL 1 DAY"
_AWAY = f"TIMESTAMP '{NOW}' AS available_at, processing_start_time AS released_lease"


@query("files", sql=f"SELECT tenant_id, file_key, 0 AS status, {_AWAY} FROM files WHERE {_LATE} ORDER BY processing_start_time, file_key LIMIT 500")
def sched_timeout_recovery(f):
    """The 500 oldest; the batch is the feature."""
    return _cols(fl.timed_out(f, _ts(NOW), 86400, 500), "tenant_id, file_key, status, available_at, released_lease")


@query("files", sql=f"SELECT tenant_id, batch, count(*) AS n, min(s) AS first, max(s) AS last FROM (SELECT tenant_id, processing_start_time AS s, (row_number() OVER (PARTITION BY tenant_id ORDER BY processing_start_time) - 1) // 20 AS batch FROM files WHERE {_LATE}) GROUP BY ALL")
def sched_timeout_batches(f):
    """All timed-out rows of each tenant in batches of 20, oldest first."""
    rows = fl.timed_out_by_tenant(f, _ts(NOW), 86400, 20)
    return rows.groupBy("tenant_id", "batch").agg(F.count("*").alias("n"), F.min("released_lease").alias("first"), F.max("released_lease").alias("last"))


@query("files", sql=f"SELECT tenant_id, file_key, 1 AS status, TIMESTAMP '{NOW}' AS processing_start_time, available_at FROM files WHERE {_READY} QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY created_at, file_key) <= 3")
def sched_lease_next(f):
    return _cols(fl.leased_next(f, _ts(NOW), 3), "tenant_id, file_key, status, processing_start_time, available_at")


@query("files", sql=f"""WITH own AS (SELECT * FROM files WHERE NOT (status = 0 AND tenant_id >= 'tenant-008')),
    a AS (SELECT tenant_id, file_key FROM own WHERE {_READY} QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY created_at, file_key) <= 2),
    b AS (SELECT * FROM own WHERE {_LATE} AND tenant_id NOT IN (SELECT tenant_id FROM a) QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY processing_start_time, file_key) <= 5),
    c AS (SELECT tenant_id, file_key FROM b QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY created_at, file_key) <= 2)
    SELECT tenant_id, file_key, 1 AS status, TIMESTAMP '{NOW}' AS processing_start_time FROM (SELECT * FROM a UNION ALL SELECT * FROM c)""")
def sched_reclaim_and_lease(f):
    """Tenants from tenant-008 on have nothing pending: their oldest timed-out rows are reclaimed first."""
    own = f.where("not (status = 0 and tenant_id >= 'tenant-008')")
    return _cols(fl.leased_after_reclaim(own, _ts(NOW), 86400, 2, 5), "tenant_id, file_key, status, processing_start_time")


@query("files", sql="SELECT tenant_id, file_key, processing_start_time FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, file_key ORDER BY ordinal) AS r FROM (SELECT tenant_id, md5(cast(file_size % 500 AS VARCHAR)) AS file_key, processing_start_time, file_key AS ordinal FROM files WHERE processing_start_time IS NOT NULL)) WHERE r = 1")
def lease_rollback_once(f):
    """A list of leases to take back that names files several times: the first of each."""
    leases = f.where("processing_start_time is not null").select("tenant_id", F.md5((F.col("file_size") % 500).cast("string")).alias("file_key"), "processing_start_time", F.col("file_key").alias("ordinal"))
    return fl.first_of_each(leases, ["tenant_id", "file_key"], "ordinal").select("tenant_id", "file_key", "processing_start_time")


@query("volumes", "files", sql="""WITH v AS (SELECT list({'id': volume_id, 'space': available_space} ORDER BY volume_id) AS a FROM volumes WHERE is_healthy AND available_space > 0),
    r AS (SELECT file_key AS request_id, retry_count + 7 * status + file_size % 1000 AS ticket, file_size % 400000 AS need FROM files),
    f AS (SELECT request_id, ticket, list_filter(a, lambda x: need <= 0 OR x.space >= need) AS fit FROM r, v),
    p AS (SELECT *, len(fit) AS n, CASE WHEN len(fit) > 0 THEN ticket % len(fit) END AS i, CASE WHEN len(fit) > 0 THEN ((ticket * 1103515245 + 12345) % 4294967296) % len(fit) END AS j0 FROM f),
    q AS (SELECT *, CASE WHEN j0 = i THEN (j0 + 1) % n ELSE j0 END AS j FROM p),
    o AS (SELECT *, CASE WHEN fit[i + 1].space >= fit[j + 1].space THEN i ELSE j END AS lead FROM q)
    SELECT request_id, array_to_string(CASE WHEN n = 1 THEN [fit[1].id] WHEN n > 1 THEN list_concat([fit[lead + 1].id, fit[(i + j - lead) + 1].id], [x.id for x in fit if x.id <> fit[i + 1].id and x.id <> fit[j + 1].id]) END, ',') AS volume_ids FROM o""")
def sched_volume_choice(v, f):
    return fl.volume_choice(v, f.select(F.col("file_key").alias("request_id"), (F.col("retry_count") + 7 * F.col("status") + F.col("file_size") % 1000).alias("ticket"), (F.col("file_size") % 400000).alias("size")), ",")


@query("files", sql=f"SELECT {_F}, completed_at FROM files WHERE status = 2 AND completed_at < TIMESTAMP '{NOW}' AND delete_succeeded_at IS NULL ORDER BY completed_at, file_key LIMIT 500")
def retention_completed(f):
    return _cols(fl.retained_until(f, 2, "completed_at", _ts(NOW), undeleted=True, most=500), _F + ", completed_at")


@query("files", sql=f"SELECT {_F}, completed_at FROM files WHERE status = 5 AND completed_at < TIMESTAMP '{NOW}'")
def retention_delete_requested(f):
    return _cols(fl.retained_until(f, 5, "completed_at", _ts(NOW)), _F + ", completed_at")


@query("files", sql=f"SELECT {_F}, last_failed_at FROM files WHERE status = 4 AND last_failed_at < TIMESTAMP '{NOW}' AND last_error <> 'error 4'")
def retention_permanently_failed(f):
    blocked = f.where("last_error = 'error 4'").select("file_key")
    return _cols(fl.retained_until(f, 4, "last_failed_at", _ts(NOW), excluded=blocked), _F + ", last_failed_at")


@query("files", sql=f"SELECT {_F}, CASE WHEN status = 5 THEN 0 ELSE 1 END AS priority FROM files WHERE status IN (2, 5) AND delete_succeeded_at IS NULL AND completed_at < TIMESTAMP '{NOW}' ORDER BY priority, completed_at, file_key LIMIT 300")
def cleanup_priority_batch(f):
    return _cols(fl.cleanup_batch(f, _ts(NOW), 300), _F + ", priority")


_RETIRED = "SELECT volume_id, cast(CASE WHEN volume_id = 'vol-2' THEN 1 ELSE 0 END as int) AS disposition FROM volumes WHERE volume_id IN ('vol-1', 'vol-2')"
_DUE = f"""WITH a AS (SELECT f.*, CASE WHEN disposition = 1 THEN 'purge_metadata' WHEN disposition = 0 THEN 'blocked: volume kept' WHEN presence = 'unknown' THEN 'blocked: presence unknown'
    WHEN presence IS NULL OR presence = 'missing' THEN 'converge' ELSE 'delete' END AS action FROM files f LEFT JOIN ({_RETIRED}) r USING (volume_id) LEFT JOIN listing l ON l.tenant_id = f.tenant_id AND l.path = f.physical_path
    WHERE f.status IN (2, 5) AND f.delete_succeeded_at IS NULL AND f.completed_at < TIMESTAMP '{NOW}')"""


def _actions(f, l, v):  # noqa: E741
    retired = v.where("volume_id in ('vol-1', 'vol-2')").select("volume_id", F.when(F.col("volume_id") == "vol-2", 1).otherwise(0).alias("disposition"))
    return fl.dispositions(f, l, retired, _ts(NOW))


@query("files", "listing", "volumes", sql=_DUE + " SELECT tenant_id, file_key, action FROM a")
def cleanup_actions(f, l, v):  # noqa: E741
    return _cols(_actions(f, l, v), "tenant_id, file_key, action")


@query("files", "listing", "volumes", sql=_DUE + " SELECT action, count(*) AS n, cast(sum(file_size) AS BIGINT) AS bytes FROM a GROUP BY action")
def cleanup_disposition_summary(f, l, v):  # noqa: E741
    return _actions(f, l, v).groupBy("action").agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes"))


@query("files", sql="SELECT file_key, '/dead/' || tenant_id || '/' || strftime(dead_lettered_at, '%Y%m%d') || '/' || file_key[1:2] || '/' || file_key[3:4] || '/' || file_key || file_extension AS path FROM files WHERE status = 7")
def dead_letter_paths(f):
    return f.where("status = 7").select("file_key", paths.dead_letter_path(F.lit("/dead"), F.col("tenant_id"), F.col("dead_lettered_at"), F.col("file_key"), F.col("file_extension")).alias("path"))


_COMMANDS = """c AS (SELECT tenant_id, file_key, x.kind AS kind, CASE x.which WHEN 0 THEN processing_start_time WHEN 1 THEN released_lease ELSE TIMESTAMP '1992-01-01' END AS lease
      FROM files, (VALUES ('complete', 0), ('complete', 1), ('complete', 2), ('fail', 0), ('fail', 1), ('fail', 2)) x(kind, which)
      UNION ALL SELECT tenant_id, 'none-' || file_key, CASE WHEN retry_count % 2 = 0 THEN 'complete' ELSE 'fail' END, created_at FROM files)"""
_RESULT = """CASE
      WHEN status IS NULL AND kind = 'complete' THEN 'idempotent'
      WHEN status IS NULL THEN 'mismatch'
      WHEN kind = 'complete' AND status IN (2, 5, 6) THEN 'idempotent'
      WHEN kind = 'complete' AND processing_start_time IS NULL AND released_lease = lease AND (status IN (4, 7) OR (status = 0 AND (last_failed_at IS NOT NULL OR available_at IS NOT NULL OR last_error <> ''))) THEN 'late'
      WHEN kind = 'fail' AND status IN (2, 5, 6) THEN CASE WHEN processing_start_time IS NULL AND released_lease = lease THEN 'idempotent' ELSE 'mismatch' END
      WHEN kind = 'fail' AND status IN (0, 4, 7) AND processing_start_time IS NULL AND released_lease = lease THEN 'idempotent'
      WHEN status = 1 AND processing_start_time = lease THEN 'applied' ELSE 'mismatch' END"""


def _commands(f: DataFrame) -> DataFrame:
    """For each row both kinds of commands under its lease, under its released one and under a wrong one, and one for a row that isn't there."""
    lease = [F.col("processing_start_time"), F.col("released_lease"), _ts("1992-01-01 00:00:00")]
    each = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), x.alias("lease")) for kind in ("complete", "fail") for x in lease]))
    none = f.select("tenant_id", F.concat(F.lit("none-"), "file_key").alias("file_key"), F.when(F.col("retry_count") % 2 == 0, "complete").otherwise("fail").alias("kind"), F.col("created_at").alias("lease"))
    return f.select("tenant_id", "file_key", each.alias("x")).select("tenant_id", "file_key", "x.kind", "x.lease").unionByName(none)


@query("files", sql=f"WITH {_COMMANDS} SELECT c.tenant_id, c.file_key, kind, lease, {_RESULT} AS result FROM c LEFT JOIN files USING (tenant_id, file_key)")
def lease_classification(f):
    return fl.lease_result(f, _commands(f))


@query("files", sql=f"WITH {_COMMANDS}, d AS (SELECT DISTINCT tenant_id, file_key, lease FROM (SELECT c.*, {_RESULT} AS result FROM c JOIN files USING (tenant_id, file_key) WHERE kind = 'complete') WHERE result IN ('applied', 'late')) SELECT tenant_id, file_key, 2 AS status, TIMESTAMP '{NOW}' AS completed_at, lease AS released_lease, CAST(NULL AS TIMESTAMP) AS processing_start_time, CAST(NULL AS TIMESTAMP) AS available_at, CAST(NULL AS VARCHAR) AS last_error FROM d")
def command_complete(f):
    """Completions under the row's lease, or late ones under a released lease."""
    return _cols(fl.completed(f, _commands(f), _ts(NOW)), "tenant_id, file_key, status, completed_at, released_lease, processing_start_time, available_at, last_error")


@query("files", sql=f"WITH {_COMMANDS}, d AS (SELECT DISTINCT tenant_id, file_key, lease FROM (SELECT c.*, {_RESULT} AS result FROM c JOIN files USING (tenant_id, file_key) WHERE kind = 'complete') WHERE result IN ('applied', 'late')) SELECT tenant_id, file_key, 4 AS event_type, TIMESTAMP '{NOW}' AS occurred_at, lease AS processing_start_time FROM d UNION ALL SELECT tenant_id, file_key, 5, TIMESTAMP '{NOW}', NULL FROM d")
def command_complete_events(f):
    return fl.completion_events(fl.completed(f, _commands(f), _ts(NOW)), _ts(NOW))


@query("files", sql="SELECT tenant_id, file_key, CASE WHEN retry_count % 2 = 0 AND status IN (2, 5) THEN 'applied' ELSE 'rejected' END AS outcome FROM files")
def conditional_mark_deleted(f):
    """Marks deleted what still has the expected completion time; every other command names a wrong one."""
    commands = f.select("tenant_id", "file_key", F.lit(1).alias("ordinal"), F.when(F.col("retry_count") % 2 == 0, F.col("completed_at")).otherwise(F.col("created_at")).alias("expected_completed_at"), F.when(F.col("status").isin(2, 5), F.col("status")).otherwise(-1).alias("expected_status"))
    applied, rejected = fl.compare_and_set(f, commands, ["completed_at", "status"])
    return applied.select("tenant_id", "file_key", F.lit("applied").alias("outcome")).unionByName(rejected.select("tenant_id", "file_key", F.lit("rejected").alias("outcome")))


@query("files", sql="SELECT tenant_id, file_key, CASE WHEN status = 4 THEN 0 ELSE status END AS status FROM files WHERE status <> 7")
def files_upsert_and_remove(f):
    f = _cols(f, "tenant_id, file_key, status")
    return fl.removed(fl.upserted(f, f.where("status = 4").withColumn("status", F.lit(0))), f.where("status = 7"))


# --- audits -----------------------------------------------------------------------------------------

_LOST = """WITH lost AS (SELECT l.* FROM listing l LEFT JOIN files f ON f.tenant_id = l.tenant_id AND f.physical_path = l.path WHERE f.file_key IS NULL AND l.presence <> 'missing' AND NOT regexp_matches(l.path, '/\\.[^./]*$'))"""


@query("listing", "files", sql=f"""WITH {_ON_DISK} SELECT l.tenant_id, key AS file_key, l.volume_id, path AS physical_path, recovered AS directory_path, length AS file_size, nullif(regexp_extract(path, '(\\.[^./]+)$', 1), '') AS file_extension, 0 AS status
    FROM disk l LEFT JOIN files f ON f.tenant_id = l.tenant_id AND f.physical_path = l.path WHERE f.file_key IS NULL AND presence <> 'missing' AND key <> ''""")
def orphan_files(l, f):  # noqa: E741
    return rc.orphan_files(l, f)


@query("listing", "files", sql=_LOST + """ SELECT tenant_id, path AS physical_path, (SELECT count(*) FROM lost WHERE path > '/mnt/vol-1/') > 20 AS has_more FROM lost WHERE path > '/mnt/vol-1/' ORDER BY path LIMIT 20""")
def orphan_scan_page(l, f):  # noqa: E741
    return rc.orphan_page(l, f, "/mnt/vol-1/", 20)


@query("files", "listing", "volumes", sql="""SELECT f.tenant_id, f.file_key, f.status, f.status <> 7 AS lowers_quota FROM files f SEMI JOIN (SELECT * FROM volumes WHERE is_healthy) v USING (volume_id)
    LEFT JOIN listing l ON l.tenant_id = f.tenant_id AND l.path = f.physical_path WHERE presence IS NULL OR presence = 'missing'""")
def orphan_metadata(f, l, v):  # noqa: E741
    return rc.orphan_metadata(f, l, v)


@query("listing", "files", sql="""WITH r AS (SELECT tenant_id, CASE WHEN file_size % 5 = 3 THEN 'other-' || file_key ELSE file_key END AS file_key, physical_path AS row_path,
        CASE file_size % 5 WHEN 0 THEN upper(physical_path) WHEN 1 THEN physical_path || 'x' WHEN 2 THEN replace(physical_path, '/mnt', '/MNT') ELSE physical_path END AS physical_path FROM files),
      here AS (SELECT tenant_id, path FROM listing WHERE presence = 'present' UNION ALL SELECT tenant_id, replace(path, '/mnt', '/MNT') FROM listing WHERE presence = 'missing')
    SELECT r.tenant_id, r.file_key, r.physical_path, CASE WHEN f.file_key IS NULL THEN 'new' WHEN f.physical_path = r.physical_path THEN 'known'
      WHEN lower(f.physical_path) = lower(r.physical_path) AND NOT EXISTS (SELECT 1 FROM here h WHERE h.tenant_id = r.tenant_id AND h.path = f.physical_path) AND EXISTS (SELECT 1 FROM here h WHERE h.tenant_id = r.tenant_id AND h.path = r.physical_path) THEN 'correct_path' ELSE 'skip' END AS resolution
    FROM r LEFT JOIN files f ON f.tenant_id = r.tenant_id AND f.file_key = r.file_key""")
def orphan_conflicts(l, f):  # noqa: E741
    """Files under their row's path, under another one, and under the same one in another case, with the old one there or lost."""
    kind, path = F.col("file_size") % 5, F.col("physical_path")
    other = F.replace(path, F.lit("/mnt"), F.lit("/MNT"))
    recovered = f.select("tenant_id", F.when(kind == 3, F.concat(F.lit("other-"), "file_key")).otherwise(F.col("file_key")).alias("file_key"), F.when(kind == 0, F.upper(path)).when(kind == 1, F.concat(path, F.lit("x"))).when(kind == 2, other).otherwise(path).alias("physical_path"))
    moved = l.where("presence = 'missing'").select("tenant_id", F.replace("path", F.lit("/mnt"), F.lit("/MNT")).alias("path"), F.lit("present").alias("presence"))
    return rc.conflicts(recovered, f, l.where("presence = 'present'").select("tenant_id", "path", "presence").unionByName(moved))


@query("files", "volumes", "listing", sql="""WITH v AS (SELECT * FROM volumes WHERE volume_id <> 'vol-0'), here AS (SELECT tenant_id, path FROM listing WHERE presence = 'present' AND length % 3 > 0 UNION ALL SELECT tenant_id, upper(path) FROM listing WHERE presence = 'present' AND length % 3 = 0),
    h AS (SELECT tenant_id, lower(path) AS folded, min(path) AS least FROM here GROUP BY ALL)
    SELECT f.tenant_id, f.file_key, mount_path, CASE WHEN mount_path IS NOT NULL AND is_healthy AND least IS NOT NULL AND e.path IS NULL THEN least ELSE physical_path END AS physical_path,
      CASE WHEN mount_path IS NULL THEN 'no volume' WHEN NOT is_healthy THEN 'unhealthy' WHEN least IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'corrected' ELSE 'ready' END AS status
    FROM files f LEFT JOIN v USING (volume_id) LEFT JOIN h ON h.tenant_id = f.tenant_id AND folded = lower(physical_path) LEFT JOIN here e ON e.tenant_id = f.tenant_id AND e.path = physical_path""")
def read_locations(f, v, l):  # noqa: E741
    """Where rows are read: one volume isn't registered, and a third of the files lie under another case."""
    return rc.read_locations(f, v.where("volume_id <> 'vol-0'"), l.withColumn("path", F.when(F.col("length") % 3 == 0, F.upper("path")).otherwise(F.col("path"))))


@query("listing", "tenants", sql="SELECT DISTINCT tenant_id FROM listing WHERE tenant_id NOT IN (SELECT tenant_id FROM tenants WHERE has_database)")
def metadata_loss_tenants(l, t):  # noqa: E741
    return rc.metadata_loss(l, t)


@query("tenants", "listing", sql="SELECT tenant_id FROM tenants WHERE status = 1 AND tenant_id NOT IN (SELECT tenant_id FROM listing)")
def missing_tenant_dirs(t, l):  # noqa: E741
    return rc.missing_tenant_directories(t, l)


@query("volumes", sql="SELECT cast(sum(total_capacity) AS BIGINT) AS total_capacity, cast(sum(available_space) AS BIGINT) AS available_space, count(*) AS healthy_volumes FROM volumes WHERE is_healthy")
def capacity_totals(v):
    return rc.capacity(v)


@query("listing", sql="""WITH p AS (SELECT path, presence, string_split(path, '/') AS s, array_to_string(s[1:4], '/') AS root, lower(s[-1]) IN ('thumbs.db', '.ds_store', 'desktop.ini') AS junk FROM listing),
    below AS (SELECT root, array_to_string(s[1:i], '/') AS path FROM p, LATERAL (SELECT unnest(range(4, len(s))) AS i)),
    dirs AS (SELECT DISTINCT root, path FROM below UNION SELECT DISTINCT root, root || '/Empty' FROM p UNION SELECT DISTINCT root, root || '/Empty/inner' FROM p
      UNION SELECT DISTINCT root, root || '/Deep' || repeat('/x', 20) FROM p WHERE presence = 'unknown' UNION SELECT DISTINCT root, root || '/Deep' FROM p),
    held AS (SELECT DISTINCT array_to_string(s[1:i], '/') AS path FROM p, LATERAL (SELECT unnest(range(1, len(s))) AS i) WHERE NOT junk AND presence <> 'missing'),
    deep AS (SELECT DISTINCT root || '/Deep' AS path FROM p WHERE presence = 'unknown')
    SELECT path FROM dirs WHERE len(string_split(path, '/')) - 4 BETWEEN 2 AND 20 AND path NOT IN (SELECT path FROM held) AND path NOT IN (SELECT path FROM deep)
""")
def empty_directory_sweep(l):  # noqa: E741
    """Folders of all files and some without any; tenants' roots and one level of shards stay, as does what lies above a folder too deep to look at."""
    folders = rc.with_ancestors(l.select(paths.parent(F.col("path")).alias("path"), (F.col("presence") == "unknown").alias("unknown")), "unknown", first=4)
    below = lambda end: F.concat("path", F.lit(end))
    added = F.array("path", below("/Empty"), below("/Empty/inner"), below("/Deep"), F.when(F.col("unknown"), below("/Deep" + "/x" * 20)))
    dirs = folders.select(F.substring_index("path", "/", 4).alias("tenant_root"), F.explode(F.when(F.size(F.split("path", "/")) == 4, F.array_compact(added)).otherwise(F.array("path"))).alias("path"))
    return rc.empty_directories(l, dirs.distinct().withColumn("sharding_depth", F.lit(1)))


@query("listing", sql="SELECT tenant_id, count(*) AS files_removed, cast(sum(length) AS BIGINT) AS space_freed FROM listing WHERE path ILIKE '%.corrupted.%' AND presence <> 'missing' GROUP BY tenant_id")
def corruption_backups(l):  # noqa: E741
    return rc.corruption_backups(l)


# --- paths and watched folders ----------------------------------------------------------------------


@query("files", sql=f"SELECT DISTINCT directory_path, {_normal('directory_path')} AS normalized FROM files")
def path_normalize(f):
    return f.select("directory_path").distinct().withColumn("normalized", paths.normalized_directory(F.col("directory_path")))


@query("listing", sql=f"WITH {_ON_DISK} SELECT path, recovered FROM disk")
def path_recover_logical_dir(l):  # noqa: E741
    """Stored files, whose shards go, and others, whose folders stay."""
    root = F.concat(F.lit("/mnt/"), "volume_id", F.lit("/"), "tenant_id")
    return l.select("path", paths.recovered_directory(F.col("path"), root, paths.stem(F.col("path"))).alias("recovered"))


@query("files", sql="""WITH k AS (SELECT file_key, n, CASE WHEN n < 8 THEN file_key[1:n] ELSE file_key END AS key, '/mnt/' || volume_id || '/' || tenant_id || '/' AS root, file_extension AS ext FROM files, (VALUES (1), (2), (3), (4), (5), (8)) v(n))
    SELECT key, root || key || ext AS depth_0, root || rpad(key, 2, '0')[1:2] || '/' || key || ext AS depth_1, root || rpad(key, 4, '0')[1:2] || '/' || rpad(key, 4, '0')[3:4] || '/' || key || ext AS depth_2,
      root || rpad(key, 2, '0')[1:2] || CASE WHEN len(key) > 2 THEN '/' || rpad(key, 4, '0')[3:4] ELSE '' END || CASE WHEN len(key) > 4 THEN '/' || rpad(key, 6, '0')[5:6] ELSE '' END || '/' || key || ext AS depth_3 FROM k""")
def path_physical_build(f):
    """Paths of whole and of short keys at every depth."""
    key = F.when(F.col("n") < 8, F.substring("file_key", 1, F.col("n"))).otherwise(F.col("file_key"))
    rows = f.withColumn("n", F.explode(F.array(*map(F.lit, (1, 2, 3, 4, 5, 8))))).withColumn("key", key)
    mount = F.concat(F.lit("/mnt/"), "volume_id")
    return rows.select("key", *[paths.physical_path(mount, F.col("tenant_id"), F.col("key"), F.col("file_extension"), d).alias(f"depth_{d}") for d in range(4)])


@query("listing", "volumes", sql="""WITH p AS (SELECT path, '/mnt/' || volume_id AS mount, string_split(path, '/') AS s FROM listing UNION ALL SELECT '/mnt/' || volume_id || '/loose.dat', '/mnt/' || volume_id, ['', 'mnt', volume_id, 'loose.dat'] FROM listing WHERE length = 0)
    SELECT path, CASE WHEN len(s) >= 5 AND regexp_replace(s[-1], '\\.[^.]*$', '') <> '' THEN s[4] || '|' || regexp_replace(s[-1], '\\.[^.]*$', '') || '|' || regexp_extract(s[-1], '(\\.[^./]+)$', 1) END AS identity FROM p""")
def path_identity(l, v):  # noqa: E741
    """Tenant, key and extension that a path tells; files beside the tenants' folders and names without a stem tell none."""
    mount = F.concat(F.lit("/mnt/"), "volume_id")
    rows = l.select("path", mount.alias("mount")).unionByName(l.where("length = 0").select(F.concat(mount, F.lit("/loose.dat")).alias("path"), mount.alias("mount")))
    return rows.withColumn("i", paths.identity_from_path(F.col("path"), F.col("mount"))).select("path", F.when(F.col("i").isNotNull(), F.concat_ws("|", "i.tenant_id", "i.file_key", "i.file_extension")).alias("identity"))


@query("listing", sql="""SELECT path, regexp_extract(path, '[^/]*$', 0) AS name, regexp_extract(path, '(\\.[^./]+)$', 1) AS extension FROM listing""")
def path_names(l):  # noqa: E741
    return l.select("path", paths.file_name(F.col("path")).alias("name"), paths.extension(paths.file_name(F.col("path"))).alias("extension"))


_PRINT = "'fp:v2:' || length || ':' || ((epoch_us(modified_at) + 62135596800000000) * 10) || ':' || ((epoch_us(created_at) + 62135596800000000) * 10)"
_V1 = "'fp:v1:' || length || ':' || ((epoch_us(modified_at) + 62135596800000000) * 10)"
# What has been imported: in the new kind, in the old one, under another time, in no known kind, or still going on.
_SCAN = f"""WITH e AS (SELECT tenant_id, path, length, {_PRINT} AS fingerprint, CASE WHEN lower(regexp_extract(path, '[^/]*$', 0)) IN ('thumbs.db', '.ds_store', 'desktop.ini') THEN 'junk' WHEN length = 0 THEN 'empty'
    WHEN modified_at > TIMESTAMP '{NOW}' - INTERVAL 5 SECOND THEN 'too young' WHEN length % 11 = 4 THEN 'still written' WHEN length % 9 = 6 THEN 'in flight' WHEN length % 9 IN (0, 1) THEN 'imported' WHEN presence = 'unknown' THEN 'locked' WHEN length > 15000000 THEN 'too large' END AS skip_reason FROM listing)"""


def _eligible(l):  # noqa: E741
    kind = F.col("length") % 9
    now = paths.fingerprint(F.col("length"), F.col("modified_at"), F.col("created_at"))
    old = F.concat_ws(":", F.lit("fp:v1"), F.slice(F.split(now, ":"), 3, 2))
    stored = F.when(kind == 0, now).when(kind == 1, old).when(kind == 2, F.concat(now, F.lit("1"))).when(kind == 3, F.substring(now, 4, 99))
    history = l.where("length % 9 in (0, 1, 2, 3, 6)").select("path", stored.alias("fingerprint"))
    earlier = l.where("length % 2 = 0 or length % 11 = 4").select("path", F.when(F.col("length") % 11 == 4, F.col("length") - 1).otherwise(F.col("length")).alias("length"), "modified_at")
    return wt.eligibility(l, history, _ts(NOW), max_size=15_000_000, earlier=earlier)


def _failures(l):  # noqa: E741
    return l.where("length % 37 = 5").select("path", F.concat(F.lit("cannot write "), (F.col("length") % 150).cast("string")).alias("error"))


@query("listing", sql=_SCAN + " SELECT * FROM e")
def watch_eligible(l):  # noqa: E741
    return _eligible(l)


@query("listing", sql=_SCAN + """, f AS (SELECT *, length % 37 = 5 AS failed FROM e) SELECT count(*) AS discovered, count(*) FILTER (skip_reason IS NULL AND NOT failed) AS imported, count(*) FILTER (skip_reason IS NOT NULL AND NOT failed) AS skipped, count(*) FILTER (failed) AS failed,
    cast(coalesce(sum(length) FILTER (skip_reason IS NULL AND NOT failed), 0) AS BIGINT) AS imported_bytes, array_to_string(list_sort(list(DISTINCT 'cannot write ' || (length % 150)) FILTER (failed))[1:100], ';') AS errors FROM f""")
def watch_scan_result(l):  # noqa: E741
    return wt.scan_result(_eligible(l), _failures(l)).withColumn("errors", F.array_join("errors", ";"))


@query("listing", sql=_SCAN + " SELECT coalesce(skip_reason, 'import') AS outcome, count(*) AS n FROM e GROUP BY 1")
def watch_skip_counts(l):  # noqa: E741
    return wt.skip_counts(_eligible(l))


@query("listing", sql="SELECT path, regexp_matches(path, '/lost-1[^/]*\\.dat$') OR regexp_matches(path, '\\.TXT$') AS strict, regexp_matches(lower(path), '\\.txt$') AS loose FROM listing")
def watch_pattern_match(l):  # noqa: E741
    name = paths.file_name(F.col("path"))
    return l.select("path", paths.matches_any(name, ["lost-1*.dat", "*.TXT"]).alias("strict"), paths.matches_any(name, ["*.txt"], ignore_case=True).alias("loose"))


@query("listing", sql=f"SELECT path, {_PRINT} AS fingerprint FROM listing")
def watch_fingerprint_dedupe(l):  # noqa: E741
    """A listing that meets each path twice, one of them with an older fingerprint."""
    prints = l.select("path", paths.fingerprint(F.col("length"), F.col("modified_at"), F.col("created_at")).alias("fingerprint"), F.lit("Upsert").alias("op"), F.lit(2).alias("seq"))
    return wt.replayed_history(prints.unionByName(prints.withColumn("fingerprint", F.lit("fp:v2:0:0:0")).withColumn("seq", F.lit(1))))


_OPS = """lines AS (SELECT CASE WHEN event_type IN (6, 8) THEN 'Delete' WHEN event_id % 50 = 3 THEN 'Touch' ELSE 'Upsert' END AS op, physical_path AS path, CASE WHEN event_id % 70 > 0 THEN cast(file_size AS VARCHAR) END AS fingerprint, event_id AS seq FROM journal),
    good AS (SELECT * FROM lines WHERE op <> 'Touch' AND trim(path) <> '' AND (op = 'Delete' OR fingerprint IS NOT NULL))"""


def _lines(j: DataFrame) -> DataFrame:
    op = F.when(F.col("event_type").isin(6, 8), "Delete").when(F.col("event_id") % 50 == 3, "Touch").otherwise("Upsert")
    return j.select(op.alias("op"), F.col("physical_path").alias("path"), F.when(F.col("event_id") % 70 > 0, F.col("file_size").cast("string")).alias("fingerprint"), F.col("event_id").alias("seq"))


@query("journal", sql=f"""WITH {_OPS}, every AS (SELECT * FROM good UNION ALL SELECT 'Upsert', '/checkpoint/' || tenant_id, 'kept', -1 FROM (SELECT DISTINCT tenant_id FROM journal) UNION ALL SELECT 'Upsert', physical_path, 'old', -1 FROM (SELECT DISTINCT physical_path FROM journal WHERE physical_path <> '' AND event_type = 6))
    SELECT path, fingerprint FROM every QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1 AND op = 'Upsert'""")
def history_replay(j):
    """A checkpoint with a log on top, some of whose lines aren't valid."""
    kept = j.select(F.concat(F.lit("/checkpoint/"), "tenant_id").alias("path"), F.lit("kept").alias("fingerprint")).distinct()
    old = j.where("physical_path <> '' and event_type = 6").select(F.col("physical_path").alias("path"), F.lit("old").alias("fingerprint")).distinct()
    return wt.replayed_history(_lines(j), kept.unionByName(old))


@query("journal", sql=f"WITH {_OPS} SELECT (SELECT count(*) FROM lines) - (SELECT count(*) FROM good) AS invalid, (SELECT count(*) FROM lines) AS lines")
def history_invalid_lines(j):
    return wt.invalid_operations(_lines(j))


@query("files", "listing", sql="SELECT path, fingerprint FROM (SELECT physical_path AS path, file_key AS fingerprint FROM files WHERE physical_path > '/mnt/vol-1/' ORDER BY 1 LIMIT 500) WHERE path NOT IN (SELECT path FROM listing WHERE presence <> 'missing')")
def history_stale(f, l):  # noqa: E741
    """One round: the next 500 paths behind a place; the budget is the feature."""
    return wt.stale_history(f.select(F.col("physical_path").alias("path"), F.col("file_key").alias("fingerprint")), l, "/mnt/vol-1/", 500)


@query("listing", "tenants", sql="SELECT tenant_id, count(*) AS n FROM listing SEMI JOIN (SELECT * FROM tenants WHERE status = 1) t USING (tenant_id) GROUP BY tenant_id")
def watch_enabled_tenants(l, t):  # noqa: E741
    return wt.of_enabled_tenants(l, t).groupBy("tenant_id").agg(F.count("*").alias("n"))
