"""Files on disk against rows: orphans of either kind, conflicts, missing tenants and directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.paths import extension, file_name, is_corruption_backup, is_junk, parent, recovered_directory, stem
from ..schema import ACTIVE


def orphan_files(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Files that no row knows, as new pending rows: key from the name, directory from the path less its shards."""
    known = files.select("tenant_id", F.col("physical_path").alias("path"))
    lost = listing.where("presence <> 'missing'").where(stem(F.col("path")) != "").join(known, ["tenant_id", "path"], "left_anti")
    root = F.concat(F.lit("/mnt/"), F.col("volume_id"), F.lit("/"), F.col("tenant_id"))
    key = stem(F.col("path"))
    return lost.select(
        "tenant_id", key.alias("file_key"), "volume_id", F.col("path").alias("physical_path"), recovered_directory(F.col("path"), root, key).alias("directory_path"),
        F.col("length").alias("file_size"), F.nullif(extension(file_name(F.col("path"))), F.lit("")).alias("file_extension"), F.lit(0).alias("status"),
    )


def orphan_page(listing: DataFrame, files: DataFrame, resume_after: str | None, most: int = 5000) -> DataFrame:
    """The next page of unknown paths by name, with whether more follow; the page is the feature."""
    rows = orphan_files(listing, files).select("tenant_id", "physical_path")
    rows = rows.where(F.col("physical_path") > resume_after) if resume_after else rows
    top = rows.orderBy("physical_path").limit(most + 1)
    ranked = top.agg(F.array_sort(F.collect_list(F.struct("physical_path", "tenant_id"))).alias("p"))
    return ranked.select(F.explode(F.slice("p", 1, most)).alias("x"), (F.size("p") > most).alias("has_more")).select("x.tenant_id", "x.physical_path", "has_more")


def orphan_metadata(files: DataFrame, listing: DataFrame, volumes: DataFrame) -> DataFrame:
    """Rows whose file is confirmed missing on a healthy volume, and whether their removal lowers the quota.

    A file whose presence is unknown, or whose volume is unhealthy or absent, is left alone.
    """
    seen = listing.select("tenant_id", F.col("path").alias("physical_path"), "presence")
    healthy = volumes.where("is_healthy").select("volume_id")
    gone = files.join(healthy, "volume_id", "left_semi").join(seen, ["tenant_id", "physical_path"], "left").where("presence is null or presence = 'missing'")
    return gone.select("tenant_id", "file_key", "status", F.col("status").isin(*ACTIVE, 6).alias("lowers_quota"))


def conflicts(recovered: DataFrame, files: DataFrame, listing: DataFrame) -> DataFrame:
    """Recovered files against rows of their key: ``new`` without a row, ``known`` on the same path, ``correct_path``, or ``skip``.

    A row's path is corrected if it differs in case alone, nothing is at the old path and the file is at the
    new one; ``listing`` (tenant_id, path, presence) tells what is there. Any other path is left alone.
    """
    at = lambda path: listing.where("presence = 'present'").select("tenant_id", F.col("path").alias(path), F.lit(True).alias(f"{path}_there")).distinct()
    row = files.select("tenant_id", "file_key", F.col("physical_path").alias("row_path"))
    out = recovered.join(row, ["tenant_id", "file_key"], "left").join(at("row_path"), ["tenant_id", "row_path"], "left").join(at("physical_path"), ["tenant_id", "physical_path"], "left")
    case_only = F.lower("physical_path") == F.lower("row_path")
    moved = F.col("row_path_there").isNull() & F.col("physical_path_there").isNotNull()
    resolution = F.when(F.col("row_path").isNull(), "new").when(F.col("physical_path") == F.col("row_path"), "known").when(case_only & moved, "correct_path").otherwise("skip")
    return out.select("tenant_id", "file_key", "physical_path", resolution.alias("resolution"))


def metadata_loss(listing: DataFrame, tenants: DataFrame) -> DataFrame:
    """Tenants that have files but no database."""
    return listing.select("tenant_id").distinct().join(tenants.where("has_database").select("tenant_id"), "tenant_id", "left_anti")


def missing_tenant_directories(tenants: DataFrame, listing: DataFrame) -> DataFrame:
    """Enabled tenants without a directory."""
    return tenants.where("status = 1").select("tenant_id").join(listing.select("tenant_id").distinct(), "tenant_id", "left_anti")


def capacity(volumes: DataFrame) -> DataFrame:
    """Capacity, space and number of healthy volumes."""
    return volumes.where("is_healthy").agg(F.coalesce(F.sum("total_capacity"), F.lit(0)).alias("total_capacity"), F.coalesce(F.sum("available_space"), F.lit(0)).alias("available_space"), F.count("*").alias("healthy_volumes"))


def with_ancestors(directories: DataFrame, flag: str, first: int = 1) -> DataFrame:
    """The ``directories`` (path, ``flag``) and those above them of at least ``first`` parts, once each: whether the flag holds for any below or itself.

    Many files share a directory: these meet before the ones above them are written out.
    """
    own = directories.groupBy("path").agg(F.max(flag).alias(flag))
    up = F.transform(F.sequence(F.lit(first), F.size(F.split("path", "/"))), lambda i: F.call_function("substring_index", F.col("path"), F.lit("/"), i))
    return own.where(F.size(F.split("path", "/")) >= first).select(F.explode(up).alias("path"), flag).groupBy("path").agg(F.max(flag).alias(flag))


def empty_directories(listing: DataFrame, directories: DataFrame, most_depth: int = 20) -> DataFrame:
    """Directories (path, tenant_root, sharding_depth) to delete: no file but junk is left below them.

    A tenant's root and its shards (down to ``sharding_depth`` below the root) always stay, and so does what lies
    more than ``most_depth`` below the root, with all directories above it.
    """
    deep = directories.withColumn("depth", F.size(F.split("path", "/")) - F.size(F.split("tenant_root", "/")))
    real = listing.where(~is_junk(file_name(F.col("path")))).where("presence <> 'missing'").select(parent(F.col("path")).alias("path"))
    held = with_ancestors(real.unionByName(deep.where(F.col("depth") > most_depth).select("path")).withColumn("held", F.lit(True)), "held")
    inner = deep.where((F.col("depth") > F.col("sharding_depth")) & (F.col("depth") > 0) & (F.col("depth") <= most_depth))
    return inner.join(held, "path", "left_anti").select("path")


def corruption_backups(listing: DataFrame) -> DataFrame:
    """Backups of corrupt databases by tenant: how many there are and the space they take."""
    old = listing.where(is_corruption_backup(file_name(F.col("path"))) & (F.col("presence") != "missing"))
    return old.groupBy("tenant_id").agg(F.count("*").alias("files_removed"), F.sum("length").alias("space_freed"))


def read_locations(files: DataFrame, volumes: DataFrame, listing: DataFrame) -> DataFrame:
    """Where to read each row's file: its volume's mount path, and the path, in another case where only that one is there.

    status: ``ready``, ``corrected`` (the path on disk differs in case), ``missing``, ``unhealthy`` or ``no volume``.
    """
    row = files.select("tenant_id", "file_key", "volume_id", "physical_path")
    seen = listing.where("presence = 'present'").select("tenant_id", F.lower("path").alias("folded"), "path").groupBy("tenant_id", "folded").agg(F.min("path").alias("least"), F.collect_set("path").alias("spellings"))
    out = row.join(volumes.select("volume_id", "mount_path", "is_healthy"), "volume_id", "left").withColumn("folded", F.lower("physical_path")).join(seen, ["tenant_id", "folded"], "left")
    exact = F.array_contains("spellings", F.col("physical_path"))
    status = F.when(F.col("mount_path").isNull(), "no volume").when(~F.col("is_healthy"), "unhealthy").when(F.col("least").isNull(), "missing").when(exact, "ready").otherwise("corrected")
    path = F.when(F.col("status") == "corrected", F.col("least")).otherwise(F.col("physical_path"))
    return out.withColumn("status", status).select("tenant_id", "file_key", "mount_path", path.alias("physical_path"), "status")


def health(tables: DataFrame) -> DataFrame:
    """Databases (tenant_id, kind, present, readable) by kind: healthy, corrupted (there but not readable) and missing ones."""
    return tables.groupBy("kind").agg(F.count_if(F.col("present") & F.col("readable")).alias("healthy"), F.count_if(F.col("present") & ~F.col("readable")).alias("corrupted"), F.count_if(~F.col("present")).alias("missing"))
