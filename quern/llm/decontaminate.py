"""Benchmark passages in documents: latent semantic retrieval, then subsequence and answer checks.

Texts become numbers of their words once, 32 bits each; their lower 16 bits are the slots of the latent
space. Inverse document frequencies come from all documents. A distributed randomised SVD of the TF-IDF
passages of the whole benchmark gives a latent space, in which overlapping windows of every document are compared by cosine with all benchmark passages in blocks. A candidate is
confirmed by the longest common subsequence of words, which paraphrases mostly keep, and by the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import arrow_type, documents, slim, written
from .words import WORD, word_hashes

SLOTS = 1 << 16
#: Words between the starts of windows, and windows' and benchmark passages' lengths in such steps.
STEP, WINDOW = 8, 4
RANK, EXTRA, POWER = 96, 16, 2
#: Tasks of a pass over the benchmark's passages at most: a pass brings together that many partial products of each block of slots.
FIT_PARTS = 16
#: Passages that a task multiplies at a time.
FIT_BATCH = 1 << 10
#: Benchmark items that a search holds at a time; a larger benchmark is searched in several passes.
MAX_ITEMS = 5_000
#: Columns of the thin matrix that a job multiplies: what a job broadcasts and brings back is 65,536 times as many numbers.
COLUMNS = 28


@dataclass(frozen=True)
class Rules:
    """When a document has an item: share of the item's words in order, alone or with the answer's share."""

    cosine: float = 0.68
    near_verbatim: float = 0.8
    paraphrase: float = 0.6
    answer: float = 0.8


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Per row its key and the numbers of its words, as little-endian 32-bit integers; null is empty."""

    def number(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_numbers(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], [key, "words"])

    rows = documents(rows, key=key)
    return rows.mapInArrow(slim(number), f"{key} {rows.schema[key].dataType.simpleString()}, words binary")


def _numbers(text: str) -> np.ndarray:
    return word_hashes(text).astype("<u4")  # the lower bits


def _slots(words) -> np.ndarray:
    """The slots of numbered words."""
    return (np.frombuffer(words, "<u4") & np.uint32(SLOTS - 1)).astype(np.int64)


def inverse_frequencies(words: DataFrame) -> np.ndarray:
    """1 + log((1 + n) / (1 + documents with the slot)) for each slot, over all rows of ``words``: no word weighs 0."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n, seen = 0, np.zeros(SLOTS, np.int64)
        for batch in batches:
            n += batch.num_rows
            for w in batch.column(0):
                seen[_slots(w.as_buffer())] += 1  # once for each slot, however often it is named
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n))], ["slot", "n"])

    counts = words.select("words").mapInArrow(slim(count), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # a row per slot
    n = int(counts.n[counts.slot == -1].sum())
    df = np.zeros(SLOTS)
    there = counts[counts.slot >= 0]
    df[there.slot] = there.n
    return 1 + np.log((1 + n) / (1 + df))


def _passages(x: np.ndarray) -> list[np.ndarray]:
    """Slots of a text by passages of WINDOW steps; the last one, if short, reaches back."""
    size = STEP * WINDOW
    starts = [*range(0, max(1, len(x) - size + 1), size)]
    if len(x) > size and starts[-1] + size < len(x):
        starts.append(len(x) - size)
    return [x[s : s + size] for s in starts] if len(x) else []


def _passage_places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of ``sizes`` words that lie one after the other: where each of their ``_passages`` starts and how long it is."""
    size, begin = STEP * WINDOW, np.cumsum(sizes) - sizes
    full, of = sizes // size, np.arange(len(sizes))
    owner = np.repeat(of, full)
    start = begin[owner] + size * (np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full))
    back, short = of[(sizes > size) & (sizes % size > 0)], of[(sizes > 0) & (sizes < size)]
    length = np.full(len(owner) + len(back) + len(short), size)
    length[len(owner) + len(back) :] = sizes[short]
    return np.concatenate([start, begin[back] + sizes[back] - size, begin[short]]), length


def latent_space(items: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """(SLOTS, rank) right singular vectors of TF-IDF passages, by power iterations of a random sketch.

    The passages are all those of the whole benchmark, the queries of the search: a window is compared with
    them in the space that they span, and what it has beside them doesn't count. A pass reads them
    in FIT_PARTS tasks at most, multiplies them with a thin matrix of slots, COLUMNS of it at a time, and
    sums the products by blocks of slots in a shuffle; only that thin matrix, whose size doesn't depend
    on the data, is held by the driver, which orthogonalises it in place.
    """
    spark, size = items.sparkSession, STEP * WINDOW
    rows = items.select("words").coalesce(FIT_PARTS)
    width, block, idf32 = rank + EXTRA, 4096, idf.astype(np.float32)
    basis = np.random.default_rng(7).standard_normal((SLOTS, width), dtype=np.float32)

    def product(thin: np.ndarray) -> np.ndarray:
        out = np.zeros_like(thin)
        for c in range(0, width, COLUMNS):
            some_columns(thin[:, c : c + COLUMNS], out[:, c : c + COLUMNS])
        return out

    def some_columns(thin: np.ndarray, result: np.ndarray) -> None:
        n, shared = thin.shape[1], spark.sparkContext.broadcast((np.ascontiguousarray(thin), idf32))

        def multiply(batches: Iterator) -> Iterator:
            import pyarrow as pa

            q, weight = shared.value
            q, square = np.vstack([q * weight[:, None], np.zeros((1, n), np.float32)]), np.append(weight * weight, np.float32(0))  # the last slot is padding
            out = np.zeros((SLOTS, n), np.float32)
            for batch in batches:
                texts = [np.frombuffer(w.as_buffer(), "<u4") for w in batch.column(0)]
                slot = (np.concatenate([*texts, np.zeros(size, "<u4")]) & np.uint32(SLOTS - 1)).astype(np.int32)
                start, length = _passage_places(np.array([len(x) for x in texts], np.int64))
                for at in range(0, len(start), FIT_BATCH):
                    some = slice(at, at + FIT_BATCH)
                    place = slot[start[some, None] + np.arange(size)]
                    place[np.arange(size) >= length[some, None]] = SLOTS
                    # Both factors of a normalised row's outer product.
                    y = q[place.ravel()].reshape(-1, size, n).sum(1) / square[place].sum(1)[:, None]
                    there = np.flatnonzero(place.ravel() < SLOTS)
                    there = there[np.argsort(place.ravel()[there].astype("<u2"), kind="stable")]
                    sorted_slots = place.ravel()[there]
                    first = np.flatnonzero(np.append(True, sorted_slots[1:] != sorted_slots[:-1]))
                    out[sorted_slots[first]] += np.add.reduceat(y[there // size], first)
            out *= weight[:, None]
            for b in range(0, SLOTS, block):
                if out[b : b + block].any():
                    yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([out[b : b + block].tobytes()], pa.binary())], ["block", "part"])

        def add(part):
            import pandas as pd

            return pd.DataFrame({"block": part.block[:1], "part": [sum(np.frombuffer(p, np.float32) for p in part.part).tobytes()]})

        products = rows.mapInArrow(slim(multiply), "block long, part binary").groupBy("block").applyInPandas(add, "block long, part binary").collect()
        shared.destroy()
        for r in products:
            result[r["block"] : r["block"] + block] = np.frombuffer(r["part"], np.float32).reshape(-1, n)

    for _ in range(POWER):
        basis = product(basis)
        _orthogonalise(basis)
    values, vectors = np.linalg.eigh(basis.T @ product(basis))
    return (basis @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


def _orthogonalise(thin: np.ndarray) -> None:
    """Turns a thin matrix into an orthonormal basis of its columns, by its small Gram matrix and in place."""
    for _ in range(2):  # the second time mends what rounding has left
        gram = np.zeros((thin.shape[1],) * 2)
        for at in range(0, len(thin), 4096):
            part = thin[at : at + 4096].astype(np.float64)
            gram += part.T @ part
        values, vectors = np.linalg.eigh(gram)
        scale = np.where(values > values.max(initial=0) * 1e-10, 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
        for at in range(0, len(thin), 4096):
            thin[at : at + 4096] = thin[at : at + 4096] @ (vectors * scale).astype(np.float32)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by the bits of one integer."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b.tolist():
        if m := where.get(y):
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def answer_words(text: str) -> int:
    """How many of an item's last words are its answer: its last sentence, or its last quarter if it has none with words."""
    total = len(WORD.findall(text))
    head = text.rstrip(" .!?\n")
    cut = max(head.rfind(m) for m in (". ", ".\n", "? ", "! ", "\n"))
    return (len(WORD.findall(head[cut + 1 :])) if cut > 0 else 0) or -(-total // 4)


def contaminated(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules(), rank: int = RANK) -> DataFrame:
    """A row for each document and benchmark item found in it: doc_id, item_id, cosine, lcs, answer.

    ``lcs`` and ``answer`` are the shares of the item's and its answer's words that the document has in
    order around the best window. Null texts are empty; empty documents and items match nothing; rows
    that repeat an id are searched each and give one row per item, the best; a null id is an id of its
    own; ids are of any type. An empty table gives no rows. The benchmark, unlike the documents, is held
    by every task, MAX_ITEMS items at a time: a larger one is searched in as many passes as it takes.
    """
    words = written(numbered(docs, "doc_id"))
    items = written(numbered(benchmark, "item_id"))
    idf = inverse_frequencies(words)
    weighted = latent_space(items, idf, rank)
    weighted *= idf[:, None].astype(np.float32)
    texts = documents(benchmark, key="item_id").distinct()
    parts = max(1, -(-texts.count() // MAX_ITEMS))
    hits = None
    for part in range(parts):
        some = texts if parts == 1 else texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        found = _searched(words, some, weighted, rules, rank)
        hits = found if hits is None else hits.unionByName(found)
    best = F.max(F.struct("lcs", "answer", "cosine")).alias("m")
    return hits.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("m.cosine").alias("cosine"), F.col("m.lcs").alias("lcs"), F.col("m.answer").alias("answer"))


def _searched(words: DataFrame, items: DataFrame, weighted: np.ndarray, rules: Rules, rank: int) -> DataFrame:
    """All windows of all documents against some ``items`` (item_id, text), which every task holds."""
    # The query set: the benchmark's texts, which are the stated, bounded side of the search.
    texts = [(r["item_id"], _numbers(r["text"]), answer_words(r["text"])) for r in items.collect()]
    texts = [x for x in texts if len(x[1])]
    targets = [(i, min(n * STEP * WINDOW, max(0, len(x) - STEP * WINDOW)), weighted[p].sum(0)) for i, (_, x, _) in enumerate(texts) for n, p in enumerate(_passages(_slots(x.tobytes())))]
    table = np.array([t / max(np.linalg.norm(t), 1e-9) for _, _, t in targets], np.float32).reshape(-1, rank)
    shared = words.sparkSession.sparkContext.broadcast((weighted, table, np.array([t[:2] for t in targets], np.int64).reshape(-1, 2), texts))
    key, item_key = words.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    key_type, item_type = arrow_type(words, "doc_id"), arrow_type(items, "item_id")

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        weighted, table, places, texts = shared.value
        item_of, offset_of = places[:, 0], places[:, 1]
        counts = [dict(zip(*(v.tolist() for v in np.unique(x, return_counts=True)))) for _, x, _ in texts]
        vectors = np.vstack([weighted, np.zeros((1, rank), np.float32)])  # the last slot is padding

        def windows(parts: list[np.ndarray]) -> Iterator[tuple[int, int, int, float]]:
            """Candidates (part, where the item would begin, item, cosine): the best windows, apart from each other."""
            steps = [-(-len(p) // STEP) + WINDOW - 1 for p in parts]
            owner, first = np.repeat(np.arange(len(parts)), steps), np.cumsum(steps) - steps
            padded = np.full(sum(steps) * STEP, SLOTS, np.int64)
            for p, f in zip(parts, first):
                padded[f * STEP : f * STEP + len(p)] = p & (SLOTS - 1)
            step = vectors[padded].reshape(-1, STEP, rank).sum(1)
            step = np.vstack([step, np.zeros((WINDOW, rank), np.float32)])
            window = sum(step[i : i + len(owner)] for i in range(WINDOW))
            norm = np.linalg.norm(window, axis=1, keepdims=True)
            cosine = (window / np.maximum(norm, 1e-9)) @ table.T
            at, target = np.nonzero(cosine >= rules.cosine)
            score = cosine[at, target]
            order = np.lexsort((-score, item_of[target], owner[at]))
            at, item, offset, score = at[order], item_of[target][order], offset_of[target][order], score[order]
            new = np.ones(len(at), bool)
            new[1:] = (owner[at][1:] != owner[at][:-1]) | (item[1:] != item[:-1])
            tried: dict[tuple[int, int], list[int]] = {}
            for i in range(len(at)):
                part, start = int(owner[at[i]]), int(at[i] - first[owner[at[i]]]) * STEP - int(offset[i])
                seen = tried.setdefault((part, int(item[i])), [])
                if new[i] or all(abs(start - s) > STEP * WINDOW for s in seen):
                    seen.append(start)
                    yield part, start, int(item[i]), float(score[i])

        def found(keys: list, parts: list[np.ndarray]) -> pa.RecordBatch:
            best: dict[tuple, tuple] = {}
            for part, start, item, score in windows(parts):
                item_id, x, n_answer = texts[item]
                slack = STEP + len(x) // 4
                span = parts[part][max(0, start - slack) : max(0, start + max(len(x), STEP * WINDOW) + slack)]
                # The words in common bound their subsequence; most candidates end here.
                count = counts[item]
                if sum(map(count.__getitem__, count.keys() & span.tolist())) < rules.paraphrase * len(x):
                    continue
                lcs = common_subsequence(x, span) / len(x)
                if lcs < rules.paraphrase:
                    continue
                answer = common_subsequence(x[len(x) - n_answer :], span) / n_answer
                if lcs >= rules.near_verbatim or answer >= rules.answer:
                    k = keys[part], item_id
                    best[k] = max(best.get(k, (0.0, 0.0, 0.0)), (lcs, answer, score))
            rows = [(d, i, s, l, a) for (d, i), (l, a, s) in best.items()]
            columns = list(zip(*rows)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [key_type, item_type, pa.float64(), pa.float64(), pa.float64()])], ["doc_id", "item_id", "cosine", "lcs", "answer"])

        keys: list = []
        parts: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for k, w in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(w.as_buffer(), "<u4").astype(np.int64)
                # A long document is searched in stretches that overlap by more than any item needs.
                reach = max((len(t[1]) for t in texts), default=0) * 2 + 4 * STEP * WINDOW
                for at in range(0, max(1, len(x)), 1 << 15):
                    if len(x):
                        keys.append(k)
                        parts.append(x[max(0, at - reach) : at + (1 << 15)])
                        size += len(parts[-1])
                    if size > 1 << 15:
                        yield found(keys, parts)
                        keys, parts, size = [], [], 0
        if keys:
            yield found(keys, parts)

    return words.mapInArrow(slim(search), f"doc_id {key}, item_id {item_key}, cosine double, lcs double, answer double")
