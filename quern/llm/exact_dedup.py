"""Exact duplicates: groups by a 128-bit content hash, bytes compared within them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import documents

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character as it is."""
    # lower() does the same, and faster, where no character is outside ASCII.
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def exact_duplicates(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty one. Of equal texts
    the row with the ``smallest`` or ``largest`` doc_id stays; rows that repeat that id are all marked
    kept, and a null id stays only where its group has no other (keep_id is null then). An empty table
    gives no rows.

    Grouping by the hash and the text itself compares the bytes inside each hash group, so texts whose
    hashes collide fall apart; copies meet before the shuffle, which one text crosses once per task.
    Rows then find their group by hash and digest in a join that can split a hot key.
    """
    rows = documents(docs).withColumn("norm", ascii_lower(F.col("text")))
    first = {"smallest": F.min, "largest": F.max}[keep]
    groups = (
        rows.groupBy(F.unhex(F.md5("norm")).alias("hash"), "norm")
        .agg(first("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("hash", F.unhex(F.sha2("norm", 256)).alias("digest"), "keep_id", "group_size")
    )
    keyed = rows.select("doc_id", F.unhex(F.md5("norm")).alias("hash"), F.unhex(F.sha2("norm", 256)).alias("digest"))
    return keyed.join(groups, ["hash", "digest"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def deduplicated(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, in one shuffle of each text.

    Rows that are equal in id and text are one row: of their other columns, the one whose hash is least (or greatest) stays. Otherwise as ``exact_duplicates``.
    """
    norm = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    best = {"smallest": F.min_by, "largest": F.max_by}[keep]
    whole = F.struct(*docs.columns)
    # A null id must win only where there is no other.
    others = [F.col(f.name) for f in docs.schema if f.name not in ("doc_id", "text") and "map<" not in f.dataType.simpleString()]
    order = F.struct((F.col("doc_id").isNull() == F.lit(keep == "smallest")).alias("last"), "doc_id", F.xxhash64(F.lit(1), "text", *others).alias("rest"))
    return docs.groupBy(F.md5(norm), norm).agg(best(whole, order).alias("row")).select("row.*")
