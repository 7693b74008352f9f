"""Quality of texts: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import documents, ship, slim
from .ngrams import SLOTS

#: Labelled rows a model is fitted on at most, by hash of their ids; the rest of them aren't needed.
MAX_LABELLED = 20_000
SHARDS = 4


def held_out(key: Column) -> Column:
    """Whether a row's label is kept from training: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Leader:
    """FTRL-proximal state: z and n for each slot, the bias last. Weights follow from them when needed."""

    alpha: float = 0.5
    beta: float = 0.02
    l1: float = 0.002
    l2: float = 0.002

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, slot: np.ndarray, value: np.ndarray, label: int) -> None:
        at, x = np.append(slot, SLOTS), np.append(value, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_LABELLED, epochs: int = 4) -> np.ndarray:
    """Weights of the model: SLOTS of them and the bias.

    Labels of held-out rows, null labels and labels without a document aren't used; a repeated id counts
    as often as its rows meet. At most about ``most`` labelled rows, chosen by a hash of the id, go to
    ``SHARDS`` tasks that each run FTRL over their rows; the model is the mean of theirs, weighted by
    rows. Without labels all weights are 0, so every score is 0.5.
    """
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    share = min(1.0, most / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) < int(share * (1 << 20)))
    # ``known`` has about ``most`` ids and labels at most: a broadcast of a fixed size.
    rows = documents(docs).join(F.broadcast(known), "doc_id").select("doc_id", "text", "label")

    def features(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .ngrams import NGrams

        grams = NGrams()
        for batch in batches:
            pairs = [grams.features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([s.astype("<i4").tobytes() for s, _ in pairs], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in pairs], pa.binary())],
                ["doc_id", "label", "slots", "shares"],
            )

    def train(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = [(np.frombuffer(s.as_buffer(), "<i4"), np.frombuffer(v.as_buffer(), "<f4").astype(float), y.as_py()) for b in batches for y, s, v in zip(b.column(1), b.column(2), b.column(3))]
        model = Leader()
        for epoch in range(epochs):
            for i in np.random.default_rng(epoch).permutation(len(held)):
                model.learn(*held[i])
        if held:
            w = model.weights()
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at], 1.0) * len(held))], ["slot", "total"])

    key = docs.schema["doc_id"].dataType.simpleString()
    sparse = rows.mapInArrow(slim(features), f"doc_id {key}, label int, slots binary, shares binary")
    models = sparse.repartition(SHARDS, F.xxhash64("doc_id")).sortWithinPartitions("doc_id").mapInArrow(slim(train), "slot long, total double")
    sums = models.groupBy("slot").agg(F.sum("total").alias("total")).orderBy("slot").toPandas()  # a row per slot in use at most
    weights = np.zeros(SLOTS + 1)
    there = sums[sums.slot >= 0]
    weights[there.slot] = there.total / max(1.0, sums.total[sums.slot == -1].sum())
    return weights


def scored(docs: DataFrame, weights: np.ndarray, threshold: float = 0.7) -> DataFrame:
    """Per row doc_id, held_out, score (0 to 1) and predicted (1 if score >= ``threshold``).

    A null or empty text has the bias alone; repeated rows score alike. Nothing is shuffled.
    """
    rows = documents(docs)
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .ngrams import NGrams

        grams, w = NGrams(), model.value
        for batch in batches:
            dots = np.array([grams.dot(t.as_py(), w) for t in batch.column(1)]) + w[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(dots, -35, 35))), pa.float64())], ["doc_id", "score"])

    key = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(slim(score), f"doc_id {key}, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, weights: np.ndarray, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(weights)
    text = docs.columns.index("text")

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .ngrams import NGrams

        grams, w = NGrams(), model.value
        least = np.log(threshold / (1 - threshold)) - w[-1]
        for batch in batches:
            yield batch.filter(pa.array([grams.dot(t.as_py() or "", w) >= least for t in batch.column(text)], pa.bool_()))

    return docs.mapInArrow(slim(keep), docs.schema)
