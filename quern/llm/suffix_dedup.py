"""Repeated byte strings across documents, by suffixes sorted one bucket at a time.

Documents lie in blocks of consecutive ids. Each block names its suffixes on a difference cover, and one
bucket of these names after another is sorted over all blocks: a mask goes back to each block that tells
which of its names occur elsewhere. Only suffixes near such tied cover positions can tie for the full
length; these few are named in full and sorted by bucket in turn, and the masks that come back tell which
occur in an earlier block. What moves is names and masks, in rows of a block and a bucket; texts move once.
Whole copies of an earlier document, all of whose suffixes are ties, are told apart by hash and left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType

from .common import documents, scratch_table, written

#: Bytes of text in a block and of names in a bucket, about; both bound what a task holds at once.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 24 << 20
#: Notes to a block: a ``copy`` (doc_id and hash of a text that an earlier document has), or the mask of its ``cover`` or ``full`` names in a bucket.
NOTE = "block long, kind string, number long, data binary"


def _bounds(rows: DataFrame, block_bytes: int) -> list[int]:
    """Last ids of blocks of at most about ``block_bytes`` of consecutive documents: 8 bytes for each block reach the driver."""
    sizes = rows.select("doc_id", F.octet_length("text").cast("long").alias("bytes")).where("doc_id is not null").repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, rest = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = held + np.cumsum(batch.column(1).to_numpy())
            full = ends // block_bytes
            last = np.flatnonzero(np.diff(full, prepend=held // block_bytes) > 0)
            held, rest = int(ends[-1]), batch.column(0).slice(batch.num_rows - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(last))], ["doc_id"])
        if rest is not None:
            # What is left of a range is a block of its own: ranges may be many and small.
            yield pa.RecordBatch.from_arrays([rest], ["doc_id"])

    return [r["doc_id"] for r in sizes.mapInArrow(cut, "doc_id long").collect()]


def _blocks(docs: DataFrame, length: int, block_bytes: int) -> tuple[DataFrame, DataFrame, int]:
    """Documents with the number of their block, in a table bucketed by it; notes of copies; all bytes of text."""
    spark, rows = docs.sparkSession, documents(docs).select(F.col("doc_id").cast("long"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bounds = _bounds(rows, block_bytes) if total > block_bytes else []
    shared = spark.sparkContext.broadcast(np.unique(np.array(bounds, np.int64)))

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            yield batch.append_column("block", pa.array(np.searchsorted(shared.value, ids, side="left")))

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Later passes join by block without moving the texts again.
    placed = rows.mapInArrow(place, "doc_id long, text string, block long")
    table = scratch_table(placed.repartition(partitions, "block").sortWithinPartitions("block"), "block", partitions)
    hashes = rows.where(F.octet_length("text") >= length).select("doc_id", F.unhex(F.sha2("text", 256)).alias("data"))
    first = written(hashes.groupBy("data").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    copies = hashes.join(first, "data").where("doc_id > first").select("doc_id", "data").distinct().mapInArrow(place, "doc_id long, data binary, block long")
    return table, copies.select("block", F.lit("copy").alias("kind"), F.col("doc_id").alias("number"), "data"), total


def _block(texts, notes, length: int):
    """Ids and texts of a block in order, which of them are copies, and the block of all others."""
    import hashlib

    from .suffix_names import Block

    texts = texts.sort_values(["doc_id", "text"], na_position="first", kind="stable")
    raw = [t.encode() for t in texts.text]
    known = {(n, d) for n, d in zip(notes.number[notes.kind == "copy"], notes.data[notes.kind == "copy"])}
    ids = {n for n, _ in known}
    copy = [i in ids and (i, hashlib.sha256(t).digest()) in known for i, t in zip(texts.doc_id, raw)]
    return texts.doc_id, raw, copy, Block([t for t, c in zip(raw, copy) if not c], length)


def _by_bucket(block: int, what: np.ndarray, bits: int, kind: str):
    """A block's sorted distinct names as rows of a bucket: the upper ``bits`` of a name are its bucket."""
    import pandas as pd

    bucket = (what >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(what), np.int64)
    there, first = np.unique(bucket, return_index=True)
    rest = what << np.uint64(bits) if bits else what
    low = (rest >> np.uint64(32)).astype("<u4") if kind == "<u4" else rest.astype(kind)
    return pd.DataFrame({"block": np.full(len(there), block), "bucket": there, "names": [p.tobytes() for p in np.split(low, first[1:])] if len(there) else []})


def _masks(rows: DataFrame, name: str, kind: str, earlier: bool) -> DataFrame:
    """Sorts a bucket of all blocks' names: which of a block's names another (or an ``earlier``) block has too."""

    def sort(part):
        import pandas as pd

        part = part.sort_values("block")
        each = [np.frombuffer(x, kind) for x in part.names]
        what = np.concatenate(each)
        order = np.argsort(what, kind="stable")  # equal names stay in the order of their blocks
        ranked = what[order]
        same = ranked[1:] == ranked[:-1]
        tied = np.zeros(len(what), bool)
        tied[order[1:]] = same
        if not earlier:
            tied[order[:-1]] |= same
        masks = [np.packbits(m).tobytes() for m in np.split(tied, np.cumsum([len(x) for x in each])[:-1])]
        return pd.DataFrame({"block": part.block.to_numpy(), "kind": name, "number": part.bucket.to_numpy(), "data": masks})

    return rows.groupBy("bucket").applyInPandas(sort, NOTE)


def _unmasked(notes, name: str, what: np.ndarray, bits: int) -> np.ndarray:
    """The masks of a block put together, for its sorted distinct names."""
    masks = notes[notes.kind == name]
    bucket = (what >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(what), np.int64)
    sizes = dict(zip(*np.unique(bucket, return_counts=True)))
    parts = [np.unpackbits(np.frombuffer(m, np.uint8), count=sizes[b]) for b, m in sorted(zip(masks.number, masks.data))]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def repeats_removed(docs: DataFrame, length: int = 100, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``_removed`` for ids of any type with an order: others than whole numbers are numbered in their order first, which moves the texts once more."""
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, IntegralType):
        return _removed(docs, length, block_bytes, bucket_bytes).withColumn("doc_id", F.col("doc_id").cast(kind))
    ids = docs.select("doc_id").where("doc_id is not null").distinct().repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ids = written(ids.withColumn("number", F.monotonically_increasing_id()))
    plain = docs.select("doc_id", "text").join(ids, "doc_id", "left").select(F.col("number").alias("doc_id"), "text")
    out = _removed(plain, length, block_bytes, bucket_bytes).withColumnRenamed("doc_id", "number")
    return out.join(ids, "number", "left").select("doc_id", *[c for c in out.columns if c != "number"])


def _removed(docs: DataFrame, length: int, block_bytes: int, bucket_bytes: int) -> DataFrame:
    """Per row doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay).

    Removes each byte covered by a string of ``length`` UTF-8 bytes that also starts earlier: in a
    document of smaller id, or earlier in the same. Overlaps count; strings are judged on the input and
    never cross documents. Null texts are empty; rows of equal id are ordered by text, a null id comes
    first; shorter texts stay as they are; an empty table gives no rows. Strings are told apart by 64-bit
    names (polynomials modulo 2^64), which two different ones rarely share; copies of whole texts by SHA-256.
    """
    from .suffix_names import cover, distinct

    table, copies, total = _blocks(docs, length, block_bytes)
    copies = written(copies)
    period, residues = cover(length)
    bits = max(0, math.ceil(math.log2(max(1.0, total * len(residues) / period * 4 / bucket_bytes))))
    by_block = table.groupBy("block")

    def sample(texts, notes):
        if texts.empty:
            return _by_bucket(0, np.zeros(0, np.uint64), bits, "<u4")
        *_, block = _block(texts, notes, length)
        return _by_bucket(int(texts.block.iloc[0]), distinct(block.samples()[1])[0], bits, "<u4")

    def tied_suffixes(block, notes):
        where, what = block.samples()
        known, rank, again = distinct(what)
        twice = np.zeros(len(known), bool)
        twice[rank[again]] = True
        return block.suffixes(where[(_unmasked(notes, "cover", known, bits) | twice)[rank]])

    def suffixes(texts, notes):
        if texts.empty:
            return _by_bucket(0, np.zeros(0, np.uint64), bits + 1, "<u8")
        *_, block = _block(texts, notes, length)
        return _by_bucket(int(texts.block.iloc[0]), distinct(tied_suffixes(block, notes)[1])[0], bits + 1, "<u8")

    named = "block long, bucket long, names binary"
    pass_over = lambda notes, f, schema: by_block.cogroup(notes.groupBy("block")).applyInPandas(f, schema)
    notes = copies.unionByName(written(_masks(pass_over(copies, sample, named), "cover", "<u4", earlier=False)))
    notes = notes.unionByName(written(_masks(pass_over(notes, suffixes, named), "full", "<u8", earlier=True)))

    def remove(texts, notes):
        import hashlib

        import pandas as pd

        columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        if texts.empty:
            return pd.DataFrame(columns=columns)
        ids, raw, copy, block = _block(texts, notes, length)
        where, what = tied_suffixes(block, notes)
        known, rank, again = distinct(what)
        covered = block.covered(where[again | _unmasked(notes, "full", known, bits + 1)[rank]])
        out, at = [], 0
        for key, text, whole in zip(ids, raw, copy):
            gone = np.ones(len(text), bool) if whole else covered[at : at + len(text)]
            at += 0 if whole else len(text)
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            out.append((key, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        return pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

    return pass_over(notes, remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
