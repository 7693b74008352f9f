"""The data model: codes, row types and names of measurements."""

from __future__ import annotations

from pyspark.sql import types as T

# Codes of events and states.
EVENT = {"Accepted": 1, "ProcessingStarted": 2, "ProcessingFailed": 3, "ProcessingCompleted": 4, "DeleteRequested": 5, "DeleteSucceeded": 6, "ProcessingTimedOut": 7, "DeadLettered": 8}
STATUS = {"Pending": 0, "Processing": 1, "Completed": 2, "Failed": 3, "PermanentlyFailed": 4, "DeleteRequested": 5, "DeleteSucceeded": 6, "DeadLettered": 7}
HOT, ACTIVE, COMMITTED = (0, 1, 3), (0, 1, 2, 3, 4, 5), (2, 5, 6)
TENANT_ENABLED, TENANT_DISABLED, TENANT_SUSPENDED = 1, 2, 3
RETIRED_KEEP, RETIRED_PURGE = 0, 1

#: Totals of a statistics snapshot and the measurement each one sums.
TOTALS = {
    "write_success_count": "storage.write.success.count",
    "write_bytes": "storage.write.bytes",
    "read_count": "storage.file.read.count",
    "dequeued_count": "storage.file.dequeued.count",
    "completed_count": "storage.file.completed.count",
    "imported_count": "watcher.files.imported.count",
    "imported_bytes": "watcher.files.imported.bytes",
    "persisted_operations": "metadata.sqlite.persisted.operation.count",
}
DIMENSIONS = ("tenant_id", "volume_id", "watcher_id", "operation")


def _struct(text: str) -> T.StructType:
    """A struct from ``name type`` pairs; a trailing ! makes a column required."""
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "t": T.TimestampNTZType(), "b": T.BooleanType(), "m": T.MapType(T.StringType(), T.StringType())}
    fields = (x.split(":") for x in text.split())
    return T.StructType([T.StructField(name, kinds[k[0]], not k.endswith("!")) for name, k in fields])


JOURNAL = _struct(
    "tenant_id:s! file_key:s! event_id:s! schema_version:i! event_type:i! occurred_at:t! sequence_number:l payload_crc32:l volume_id:s physical_path:s directory_path:s "
    "file_size:l status:i processing_start_time:t retry_count:i available_at:t error_message:s original_file_name:s file_extension:s"
)
FILES = _struct(
    "file_key:s! tenant_id:s! volume_id:s physical_path:s directory_path:s file_size:l created_at:t status:i retry_count:i last_failed_at:t processing_start_time:t completed_at:t "
    "delete_succeeded_at:t dead_lettered_at:t available_at:t last_error:s original_file_name:s file_extension:s metadata:m"
)
QUOTAS = _struct("tenant_id:s! directory_path:s! current_count:i max_count:i enabled:b last_updated:t created_at:t")
TENANTS = _struct("tenant_id:s! status:i created_at:t updated_at:t storage_path:s properties:s")
VOLUMES = _struct("volume_id:s! mount_path:s total_capacity:l available_space:l is_healthy:b sharding_depth:i")
MEASUREMENTS = _struct("name:s value:l ts:t tenant_id:s volume_id:s watcher_id:s operation:s arrival:l")
