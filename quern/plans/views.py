"""The model's tables as views of the driver's tables: one SQL text each, for Spark and for the SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCES = {"events": ["events"], "orders": ["orders"], "customer": ["customer"], "supplier": ["supplier"], "nation": ["nation"], "lineitem": ["lineitem"]}


class Spark:
    """Where Spark's SQL differs from the twins'."""

    seconds = staticmethod(lambda n: f"make_dt_interval(0, 0, 0, cast({n} as decimal(18,6)))")
    div = staticmethod(lambda a, b: f"(({a}) div {b})")
    backslash = "'\\\\'"


class Twin:
    seconds = staticmethod(lambda n: f"to_seconds({n})")
    div = staticmethod(lambda a, b: f"(({a}) // {b})")
    backslash = "'\\'"


def _tenant(expression: str, n: int) -> str:
    return f"'tenant-' || lpad(cast({expression} % {n} as string), 3, '0')"


def _messy(n: str, d) -> str:
    """Directories as clients write them: mixed slashes, dots, steps up, blanks."""
    return f"""CASE {n} % 7 WHEN 0 THEN '/incoming/' WHEN 1 THEN 'incoming//studies' WHEN 2 THEN concat('in', {d.backslash}, 'box', {d.backslash}, '.', {d.backslash}, 'a')
        WHEN 3 THEN '/a/../incoming/studies/' WHEN 4 THEN ' ' WHEN 5 THEN '/x/y/../../../z' ELSE '/' END"""


def journal(d) -> str:
    """64 tenants with sequence numbers that the event's own number gives, a jump after every 97th; a file's events are those of 16 users."""
    file = "concat(cast(event_id % 64 as string), '-', cast(" + d.div("user_id", "16") + " as string))"
    n = f"({d.div('event_id', '64')} + 1)"
    path = "concat('/mnt/vol-', cast(f % 4 as string), '/', tenant_id, '/', substring(file_key, 1, 2), '/', substring(file_key, 3, 2), '/', file_key, '.dat')"
    return f"""
    WITH base AS (
      SELECT *, {_tenant("event_id", 64)} AS tenant_id, md5({file}) AS file_key, {d.div("user_id", "16")} + event_id % 64 AS f, cast(regexp_extract(props, '[0-9]+', 0) as int) AS k,
        {n} + {d.div(n, "97")} AS seq FROM events),
    seen AS (
      SELECT *, max(CASE WHEN event_type = 'view' THEN ts END) OVER (PARTITION BY tenant_id, file_key ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS viewed FROM base),
    coded AS (
      SELECT *, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 4
          WHEN 'purchase' THEN CASE WHEN k < 45 OR (k >= 60 AND k < 95) THEN 5 WHEN k < 60 THEN 6 ELSE 8 END
          ELSE CASE WHEN k < 30 THEN 7 ELSE 3 END END AS code FROM seen)
    SELECT tenant_id, file_key, event_id, code AS event_type, ts AS occurred_at, cast(seq as bigint) AS sequence_number,
      concat('vol-', cast(f % 4 as string)) AS volume_id,
      CASE WHEN event_id % 41 = 0 THEN '' ELSE {path} END AS physical_path,
      {_messy("f", d)} AS directory_path, cast(floor(value * 100) as bigint) AS file_size,
      cast(CASE WHEN code = 3 AND k % 10 = 0 THEN 4 WHEN code = 4 AND k % 25 = 1 THEN 6 END as int) AS status,
      CASE WHEN code IN (3, 4, 7) THEN CASE WHEN event_id % 13 = 0 THEN viewed - interval '1' day ELSE viewed END WHEN code = 2 AND k % 3 > 0 THEN ts END AS processing_start_time,
      cast(CASE WHEN code = 3 THEN k % 4 END as int) AS retry_count,
      CASE WHEN code IN (3, 7) AND k % 2 = 0 THEN ts + interval '5' minute END AS available_at,
      CASE WHEN code = 3 THEN concat('error ', cast(k as string)) WHEN code = 2 AND k % 9 = 0 THEN 'slow' END AS error_message,
      concat('file ', cast(f as string), '.dat') AS original_file_name, '.dat' AS file_extension, f % 11 <> 0 AS physical_present
    FROM coded"""


def _stored(key: str, k: str) -> str:
    """Where a volume keeps a file: mount, tenant, two shards of the key, name."""
    return f"""concat('/mnt/vol-', cast({k} % 4 as string), '/', {_tenant("o_custkey", 16)}, '/', substring({key}, 1, 2), '/', substring({key}, 3, 2), '/', {key}, '.dat')"""


def files(d) -> str:
    k = "o_orderkey"
    key = f"md5(cast({k} as string))"
    at = lambda hours: f"o_orderdate + {d.seconds(f'({hours}) * 3600')}"
    return f"""
    SELECT {key} AS file_key, {_tenant("o_custkey", 16)} AS tenant_id, concat('vol-', cast({k} % 4 as string)) AS volume_id, {_stored(key, k)} AS physical_path,
      {_messy(k, d)} AS directory_path, cast(floor(o_totalprice * 100) as bigint) AS file_size, o_orderdate AS created_at, cast({k} % 8 as int) AS status,
      cast({k} % 5 as int) AS retry_count,
      CASE WHEN {k} % 8 IN (3, 4) OR {k} % 5 = 1 THEN {at(f"1 + {k} % 40")} END AS last_failed_at,
      CASE WHEN {k} % 8 = 1 THEN {at(f"2 + {k} % 30")} END AS processing_start_time,
      CASE WHEN {k} % 8 IN (2, 5, 6) THEN {at(f"3 + {k} % 50")} END AS completed_at,
      CASE WHEN {k} % 8 = 6 OR {k} % 64 = 2 THEN {at(f"60 + {k} % 9")} END AS delete_succeeded_at,
      CASE WHEN {k} % 8 = 7 THEN {at("80")} END AS dead_lettered_at,
      CASE WHEN {k} % 8 = 0 AND {k} % 3 > 0 THEN {at(f"{k} % 1000")} END AS available_at,
      CASE WHEN {k} % 8 IN (3, 4) THEN concat('error ', cast({k} % 6 as string)) END AS last_error,
      CASE WHEN {k} % 8 <> 1 AND {k} % 3 <> 1 THEN {at(f"1 + {k} % 20")} END AS released_lease, '.dat' AS file_extension
    FROM orders"""


def tenants(d) -> str:
    return f"""SELECT {_tenant("n_nationkey", 100)} AS tenant_id, cast(CASE WHEN n_nationkey % 6 = 4 THEN 2 WHEN n_nationkey % 6 = 5 THEN 3 ELSE 1 END as int) AS status,
      cast(n_regionkey * 10 as bigint) AS tenant_limit, n_nationkey % 3 <> 1 AS has_database FROM nation"""


def volumes(d) -> str:
    return """SELECT concat('vol-', cast(s_suppkey as string)) AS volume_id, concat('/mnt/vol-', cast(s_suppkey as string)) AS mount_path,
      cast(1000000 + s_suppkey * 1000 as bigint) AS total_capacity, cast(CASE WHEN s_suppkey % 10 = 9 THEN 0 ELSE floor(s_acctbal * 100) + 200000 END as bigint) AS available_space,
      s_suppkey % 7 <> 3 AS is_healthy, cast(s_suppkey % 4 as int) AS sharding_depth FROM supplier"""


def quotas(d) -> str:
    return f"""SELECT {_tenant("c_custkey", 16)} AS tenant_id, directory_path,
      cast(count(*) as bigint) AS current_count, cast(max(CASE WHEN c_custkey % 16 % 3 = 0 THEN 120 ELSE 0 END) as bigint) AS max_count, min(c_custkey) % 2 = 0 AS enabled
    FROM (SELECT c_custkey, CASE c_nationkey % 6 WHEN 0 THEN '/' WHEN 1 THEN '/incoming' WHEN 2 THEN '/incoming/studies' WHEN 3 THEN '/stale' WHEN 4 THEN '/limited' ELSE {_tenant("c_custkey", 16)} END AS directory_path FROM customer) c
    GROUP BY 1, 2"""


def listing(d) -> str:
    """Files on disk: nine in ten of those known, one in ten under another name that nothing knows, with junk, other cases and lost ones."""
    k = "o_orderkey"
    key = f"md5(cast({k} as string))"
    root = f"""'/mnt/vol-', cast({k} % 4 as string), '/', {_tenant("o_custkey", 16)}"""
    lost = f"""CASE {k} % 100 WHEN 3 THEN concat({root}, '/Incoming/lost-', cast({k} as string), '.TXT') WHEN 13 THEN concat({root}, '/Incoming/', cast({k} as string), '/Thumbs.db') WHEN 23 THEN concat({root}, '/Incoming/', cast({k} as string), '/.DS_Store')
        WHEN 33 THEN concat({root}, '/', substring({key}, 1, 2), '/', substring({key}, 3, 2), '/Studies/a/', {key}, '.dcm') WHEN 43 THEN concat({root}, '/docs/', substring({key}, 1, 2), '/', {key}, '.dat')
        WHEN 53 THEN concat({root}, '/metadata.db.Corrupted.', cast({k} as string)) ELSE concat({root}, '/Incoming/lost-', cast({k} as string), '.dat') END"""
    return f"""
    SELECT {_tenant("o_custkey", 16)} AS tenant_id, concat('vol-', cast({k} % 4 as string)) AS volume_id, CASE WHEN {k} % 10 = 3 THEN {lost} ELSE {_stored(key, k)} END AS path,
      cast(CASE WHEN {k} % 17 = 0 THEN 0 ELSE floor(o_totalprice * 100) END as bigint) AS length, o_orderdate + interval '1' hour AS modified_at, o_orderdate AS created_at,
      CASE WHEN {k} % 23 = 0 THEN 'unknown' WHEN {k} % 19 = 0 OR {k} % 10 = 7 THEN 'missing' ELSE 'present' END AS presence
    FROM orders"""


def measurements(d) -> str:
    return f"""
    SELECT CASE event_type WHEN 'view' THEN 'storage.file.read.count' WHEN 'click' THEN 'storage.file.dequeued.count' WHEN 'signup' THEN 'storage.write.success.count'
        WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'storage.write.bytes' ELSE 'storage.file.completed.count' END
        ELSE CASE event_id % 4 WHEN 0 THEN 'watcher.files.imported.count' WHEN 1 THEN 'watcher.files.imported.bytes' WHEN 2 THEN 'metadata.sqlite.persisted.operation.count' ELSE ' ' END END AS name,
      cast(floor(value) as bigint) * (event_id % 29) AS value, ts, {_tenant("user_id", 8)} AS tenant_id,
      CASE WHEN event_id % 5 > 0 THEN concat('vol-', cast(user_id % 4 as string)) END AS volume_id, CASE WHEN event_type = 'error' THEN concat('w-', cast(user_id % 3 as string)) END AS watcher_id,
      CASE WHEN event_id % 3 = 0 THEN 'write' WHEN event_id % 3 = 1 THEN 'read' END AS operation, event_id AS arrival
    FROM events"""


VIEWS = {"journal": (journal, "events"), "files": (files, "orders"), "tenants": (tenants, "nation"), "volumes": (volumes, "supplier"), "quotas": (quotas, "customer"), "listing": (listing, "orders"), "measurements": (measurements, "events")}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, source = VIEWS[name]
    table = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return spark.sql(text(Spark).replace(f"FROM {source}", "FROM {" + source + "}"), **{source: table})


def twin(*names: str, recursive: bool = False) -> str:
    """The views as the beginning of a WITH clause."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(f"{n} AS ({VIEWS[n][0](Twin)})" for n in names)
