"""Other sources and sinks: listings, tenant registries, snapshots, tables by tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.paths import file_name
from ..functions.time import tolerant_timestamp
from ..schema import TENANT_DISABLED, TENANT_ENABLED, TENANT_SUSPENDED


def read_listing(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Files below ``root`` with length and change time; the contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true").load(root)
    return files.select("path", F.col("length"), F.col("modificationTime").cast("timestamp_ntz").alias("modified_at"))


def by_tenant(listing: DataFrame, root: str) -> DataFrame:
    """Files with the first folder below ``root`` as their tenant; files beside the folders have none and fall away."""
    base = root.rstrip("/").removeprefix("file://")
    rest = F.regexp_extract("path", r"^(?:file:)?/*" + base.lstrip("/") + "/([^/]+)/", 1)
    return listing.withColumn("tenant_id", rest).where("tenant_id <> ''").withColumn("file_name", file_name(F.col("path")))


def read_tenants(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file per tenant (TenantId, Status, CreatedAt, UpdatedAt, StoragePath, Properties; names in any case, status by code or name).

    Files that don't parse are skipped.
    """
    names = {"tenantid": "tenant_id", "status": "status", "createdat": "created_at", "updatedat": "updated_at", "storagepath": "storage_path", "properties": "properties"}
    text = spark.read.text(path, wholetext=True)
    found = text.select(F.from_json("value", "map<string,string>").alias("m")).where("m is not null")
    folded = found.select(F.map_from_entries(F.transform(F.map_entries("m"), lambda e: F.struct(F.lower(F.replace(e["key"], F.lit("_"), F.lit(""))), e["value"]))).alias("m"))
    rows = folded.select(*[F.element_at("m", k).alias(v) for k, v in names.items()])
    code = F.coalesce(F.expr("try_cast(status as int)"), F.when(F.lower("status") == "enabled", TENANT_ENABLED).when(F.lower("status") == "disabled", TENANT_DISABLED).when(F.lower("status") == "suspended", TENANT_SUSPENDED))
    known = rows.where("tenant_id is not null").withColumn("status", F.coalesce(code, F.lit(0)))
    return known.withColumns({c: tolerant_timestamp(F.col(c), True) for c in ("created_at", "updated_at")})


def write_snapshot(files: DataFrame, path: str, cursor: int) -> None:
    """A projection at a cursor, by tenant and in order of creation and key within it."""
    files.withColumn("cursor", F.lit(cursor)).repartition("tenant_id").sortWithinPartitions("tenant_id", "created_at", "file_key").write.mode("overwrite").partitionBy("tenant_id").parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def replace_tenants(files: DataFrame, path: str) -> None:
    """Overwrites the partitions of the tenants that ``files`` has rows of, and no others."""
    files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant_id").parquet(path)


def compact(spark: SparkSession, path: str, target: str, bytes_per_file: int = 128 << 20) -> DataFrame:
    """Rewrites a table into files of about ``bytes_per_file``; returns file counts and bytes before and after."""
    sizes = lambda p: read_listing(spark, p).where("path like '%.parquet'").agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    before = sizes(path).first()
    n = max(1, -(-before["bytes"] // bytes_per_file))
    spark.read.parquet(path).repartition(n).write.mode("overwrite").parquet(target)
    after = sizes(target).first()
    return spark.createDataFrame([(before["files"], before["bytes"], after["files"], after["bytes"])], "files_before long, bytes_before long, files_after long, bytes_after long")

