"""Journals as tables: offsets, valid prefixes, compaction, sequence numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .running import running


def with_offsets(records: DataFrame, size: str = "record_bytes", base: int = 0) -> DataFrame:
    """Logical start and end offsets of a tenant's records, whose bytes lie one after the other from ``base`` on."""
    placed = running(records, ["tenant_id"], "sequence_number", size, "sum", "start_offset")
    return placed.withColumn("start_offset", F.col("start_offset") + base).withColumn("end_offset", F.col("start_offset") + F.col(size))


def valid_prefix(records: DataFrame, bad: Column) -> DataFrame:
    """Records before a tenant's first bad one; the bad ones' first place comes from partial minima."""
    first = records.where(bad).groupBy("tenant_id").agg(F.min("sequence_number").alias("first_bad"))
    return records.join(first, "tenant_id", "left").where(F.col("first_bad").isNull() | (F.col("sequence_number") < F.col("first_bad"))).drop("first_bad")


def scan_state(records: DataFrame, bad: Column) -> DataFrame:
    """Per tenant the last valid offset and sequence, and whether a corrupt tail follows."""
    kept = valid_prefix(records, bad).groupBy("tenant_id").agg(F.max("end_offset").alias("last_valid_offset"), F.max("sequence_number").alias("last_sequence"))
    tails = records.groupBy("tenant_id").agg(F.max(bad.cast("int")).alias("corrupt"))
    return tails.join(kept, "tenant_id", "left").select("tenant_id", F.coalesce("last_valid_offset", F.lit(0)).alias("last_valid_offset"), F.coalesce("last_sequence", F.lit(0)).alias("last_sequence"), (F.col("corrupt") == 1).alias("corrupt_tail"))


def compacted(records: DataFrame, processed_offset: int) -> DataFrame:
    """Records that end behind ``processed_offset``; their logical offsets stay."""
    return records.where(F.col("end_offset") > processed_offset)


def normalized_offset(records: DataFrame, offset: int) -> DataFrame:
    """Per tenant the last record boundary at or before ``offset``."""
    return records.groupBy("tenant_id").agg(F.coalesce(F.max(F.when(F.col("end_offset") <= offset, F.col("end_offset"))), F.lit(0)).cast("bigint").alias("normalized_offset"))


def read_batch(records: DataFrame, tenant: str, offset: int, most: int, base: int = 0) -> tuple[DataFrame, DataFrame]:
    """The next ``most`` records of a tenant from ``offset`` on, and one row of next_offset and reached_eof.

    ``records`` have start_offset and end_offset. An offset before ``base`` begins there, one behind the end at the
    end, and one inside a record at that record's start. Without records the next offset is the offset as clamped.
    """
    if offset < 0 or most <= 0:
        raise ValueError("offset is 0 or more, most 1 or more")
    own = records.where(F.col("tenant_id") == tenant)
    ends = own.agg(F.coalesce(F.max("end_offset"), F.lit(base)).cast("bigint").alias("tail"))
    # A record that the offset lies in ends behind it, too.
    batch = own.where(F.col("end_offset") > max(offset, base)).orderBy("start_offset").limit(most)
    sides = ends.select("tail", F.lit(None).cast("bigint").alias("end_offset")).unionByName(batch.select(F.lit(None).cast("bigint").alias("tail"), "end_offset"))
    state = sides.agg(F.max("tail").alias("tail"), F.max("end_offset").alias("last")).select(
        F.coalesce("last", F.least(F.lit(max(offset, base)), "tail")).cast("bigint").alias("next_offset"), F.coalesce(F.col("last") >= F.col("tail"), F.lit(True)).alias("reached_eof")
    )
    return batch, state


def appended(journal: DataFrame, events: DataFrame, order: str = "ordinal") -> DataFrame:
    """``events`` with sequence numbers that go on from each tenant's last one in ``journal``, in order of the number ``order``."""
    last = journal.groupBy("tenant_id").agg(F.max("sequence_number").alias("last"))
    ranked = running(events.withColumn("_one", F.lit(1)), ["tenant_id"], order, "_one", "sum", "_before").drop("_one")
    return ranked.join(last, "tenant_id", "left").withColumn("sequence_number", F.coalesce("last", F.lit(0)) + F.col("_before") + 1).drop("last", "_before")


def single_tenant(events: DataFrame, tenant: str) -> DataFrame:
    """``events``, which fail to be read if one of them is another tenant's: a batch belongs to one journal."""
    return events.where(F.when(F.col("tenant_id").eqNullSafe(tenant), True).otherwise(F.raise_error(F.lit("a batch holds events of one tenant")).cast("boolean")))


def repaired(records: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """Records before each tenant's first bad one, and per tenant with such a tail: what was cut off (truncated_at, records_lost)."""
    kept = valid_prefix(records, bad)
    first = records.where(bad).groupBy("tenant_id").agg(F.min("sequence_number").alias("first_bad"))
    lost = records.join(first, "tenant_id").where("sequence_number >= first_bad").groupBy("tenant_id").agg(F.min("start_offset").alias("truncated_at"), F.count("*").alias("records_lost"))
    return kept, lost
