"""Hierarchical packing of tokenised documents into sequences of several context sizes.

A document gives full windows of the longest context size; what is left of it goes to the smallest tier
that holds it. From the longest tier down, each document left opens a sequence of its tier and the gap is
filled from shorter tiers, largest fitting piece first; the last piece is cut to close the gap. At most
the last sequence of a task is short. Finished sequences are dealt to step groups of equal attention cost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from .common import documents, slim

TIERS = (256, 512, 1024, 2048)
SCHEMA = "doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Packs the documents of one task. ``add`` and ``close`` give finished sequences as lists of pieces.

    A piece is (doc, start, length); pieces still to place wait by length, so the largest that fits a gap
    is found with one look at a bit mask. Only pieces shorter than the longest tier ever wait, and they
    are placed as soon as ``batch`` tokens wait, so a task holds a bounded number of ids.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS, batch: int = 4_000_000):
        self.tiers, self.top, self.batch = sorted(tiers), max(tiers), batch
        self.waiting: dict[int, list[tuple[int, int]]] = {}
        self.mask, self.tokens = 0, 0

    def _put(self, doc: int, start: int, length: int) -> None:
        self.waiting.setdefault(length, []).append((doc, start))
        self.mask |= 1 << length
        self.tokens += length

    def _take(self, most: int) -> tuple[int, int, int] | None:
        """The longest waiting piece of at most ``most`` ids."""
        length = (self.mask & ((2 << most) - 1)).bit_length() - 1
        if length < 1:
            return None
        stack = self.waiting[length]
        doc, start = stack.pop()
        if not stack:
            self.mask ^= 1 << length
        self.tokens -= length
        return doc, start, length

    def add(self, doc: int, n: int) -> Iterator[list[tuple[int, int, int]]]:
        for start in range(0, n - self.top + 1, self.top):
            yield [(doc, start, self.top)]
        if rest := n % self.top:
            self._put(doc, n - rest, rest)
        if self.tokens >= self.batch:
            yield from self.place()

    def place(self) -> Iterator[list[tuple[int, int, int]]]:
        """Sequences of what waits, all full but the last one."""
        for tier, below in zip(self.tiers[::-1], [*self.tiers[-2::-1], 0]):
            while (first := self._take(tier)) and first[2] > below:
                sequence, gap = [first], tier - first[2]
                while gap and (piece := self._take(gap)):
                    sequence.append(piece)
                    gap -= piece[2]
                if gap and self.mask:  # all that wait are longer than the gap: cut one of the shortest
                    length = (self.mask & -self.mask).bit_length() - 1
                    doc, start, _ = self._take(length)
                    sequence.append((doc, start, gap))
                    self._put(doc, start + gap, length - gap)
                yield sequence
            if first:
                self._put(*first)


def step_groups(costs: list[int], tokens: list[int], per_step: int) -> list[int]:
    """A group for each sequence: about ``per_step`` tokens each, of costs as equal as dealing in a snake makes them."""
    n = max(1, round(sum(tokens) / per_step))
    out = [0] * len(costs)
    for k, i in enumerate(sorted(range(len(costs)), key=lambda i: -costs[i])):
        lap, at = divmod(k, n)
        out[i] = at if lap % 2 == 0 else n - 1 - at
    return out


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, per_step: int = 1 << 17) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    Every whole text (null: empty) is encoded and closed with ``end_id``, so an empty document has one
    id; each id lies in one piece. Rows of an equal or null doc_id are packed as documents of their own.
    Sequences are made within a partition and nothing is shuffled; ids of sequences and groups hold the
    partition in their upper bits. A task's last sequence may be short of its tier. An empty table gives
    no rows. ``tier`` is the context size that the sequence is padded to.
    """
    top = max(tiers)

    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import encoder

        encode, packer, part = encoder(tokenizer).encode, Packer(tiers), TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4").tobytes()
        held: dict[int, list] = {}  # doc_id, ids and how many of them aren't placed yet, by row
        row, n_sequences, n_groups, done = 0, 0, 0, []

        def flush() -> pa.RecordBatch:
            nonlocal n_sequences, n_groups, done
            tokens = [sum(p[2] for p in s) for s in done]
            groups = step_groups([sum(p[2] * p[2] for p in s) for s in done], tokens, per_step)
            out: list[tuple] = []
            for sequence, size, group in zip(done, tokens, groups):
                at, tier = 0, next(t for t in sorted(tiers) if t >= size)
                for doc, start, length in sequence:
                    key, ids, _ = held[doc]
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                    out.append((key, start, length, crc, len(ids) // 4, part | n_sequences, at, tier, part | (n_groups + group)))
                    at += length
                    held[doc][2] -= length
                    if not held[doc][2]:
                        del held[doc]
                n_sequences += 1
            n_groups += max(groups, default=-1) + 1
            done = []
            columns = list(zip(*out)) or [()] * 9
            types = [key_type, *[pa.int64()] * 6, pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                held[row] = [key, ids, len(ids) // 4]
                done.extend(packer.add(row, len(ids) // 4))
                row += 1
                if len(done) >= 1024:
                    yield flush()
        if key_type is not None:
            done.extend(packer.place())
            yield flush()
        # New words keep coming, so the cache is worth little to other tasks, and their worker would hold it through all of them.
        encoder(tokenizer).forget()

    if top & (top - 1) or any(t & (t - 1) for t in tiers):
        raise ValueError("context sizes are powers of two")
    rows = documents(docs)
    return rows.mapInArrow(slim(pack), SCHEMA.format(key=rows.schema["doc_id"].dataType.simpleString()))


def sequences(pieces: DataFrame) -> DataFrame:
    """Per sequence: its tier, pieces, tokens, padding and step group."""
    return pieces.groupBy("sequence_id", "tier", "step_group").agg(F.count("*").alias("n_pieces"), F.sum("length").alias("n_tokens"), (F.col("tier") - F.sum("length")).alias("padding"))
