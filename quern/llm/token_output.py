"""Token ids of documents in files of Simple-8b payloads, and reading them back.

The files are Parquet written by Spark's committer, so a lost executor or a repeated task leaves no half
or double file. A row is a chunk of whole documents in ascending order of the key:

    part, chunk    place of the writing partition in key order, and of the chunk within it
    start          ids of the same partition before the chunk
    doc_ids        the chunk's documents in order
    n_tokens       their numbers of ids, the end id included
    payload        their ids one after the other (simple8b)

A reader needs nothing but the rows: a partition's first id follows from the sizes of those before it,
and a document's from the lengths before it in its chunk.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import arrow_type, documents

CHUNK_SCHEMA = "part int, chunk int, start long, doc_ids array<{key}>, n_tokens array<long>, payload binary"
#: Ids after which a chunk is closed; a longer document has a chunk of its own.
CHUNK_IDS = 1 << 18


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encodes every whole text (null: empty), adds ``end_id`` to each and writes the files to ``path``.

    Ids are of any type with an order. Rows of an equal doc_id keep one order, by text; a null doc_id comes
    first; an empty table gives no chunks. One shuffle, by ranges of doc_id; a task holds one batch of rows and one chunk.
    """
    spread = documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    key_type = arrow_type(spread, "doc_id")

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from . import simple8b
        from .tokens import encoder

        encode_text, part, chunk, start = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u4").tobytes()
        keys: list = []
        parts: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal chunk, start, keys, parts
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = {"part": [part], "chunk": [chunk], "start": [start], "doc_ids": [keys], "n_tokens": [[len(x) // 4 for x in parts]], "payload": [simple8b.pack(ids)]}
            chunk, start, keys, parts = chunk + 1, start + len(ids), [], []
            types = (("part", pa.int32()), ("chunk", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(key_type)), ("n_tokens", pa.list_(pa.int64())), ("payload", pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array(row[k], t) for k, t in types], [k for k, _ in types])

        size = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(key)
                parts.append(encode_text(text.as_py()) + end)
                size += len(parts[-1]) // 4
                if size >= CHUNK_IDS:
                    yield close()
                    size = 0
        if keys:
            yield close()

    spread.mapInArrow(encode, CHUNK_SCHEMA.format(key=spread.schema["doc_id"].dataType.simpleString())).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and its place (part, chunk)."""
    chunks = spark.read.parquet(path)
    ids = chunks.select(F.explode("doc_ids").alias("doc_id"))
    key, key_type = ids.schema["doc_id"].dataType.simpleString(), arrow_type(ids, "doc_id")
    sizes = chunks.select("part", (F.col("start") + F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("end")).groupBy("part").agg(F.max("end").alias("size"))
    # One row for each task that wrote: a bounded window and a join side that grows with tasks, not with rows.
    base = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base"))

    def decode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from . import simple8b

        for batch in batches:
            for row in batch.to_pylist():
                ids = memoryview(simple8b.unpack(row["payload"]).astype("<u4")).cast("B")
                ends = np.cumsum(np.array(row["n_tokens"], np.int64))
                begins = ends - row["n_tokens"]
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], key_type), pa.array(begins + (row["base"] + row["start"])), pa.array(row["n_tokens"], pa.int64()), pa.array(crc, pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array([row["chunk"]] * n, pa.int32())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "part", "chunk"],
                )

    return chunks.join(F.broadcast(base), "part").select("part", "chunk", "start", "doc_ids", "n_tokens", "payload", "base").mapInArrow(decode, f"doc_id {key}, start long, n_tokens long, ids_crc32 long, part int, chunk int")
