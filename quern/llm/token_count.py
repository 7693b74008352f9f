"""Numbers of tokens by byte-pair merging, without making the tokens.

A text's symbols are linked in a list and its mergeable neighbours wait in a heap by rank; the pair of
lowest rank (leftmost of equals) is merged until none is left. The count is the symbols at the start
less the merges; a symbol outside the vocabulary counts as its UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, functions as F

from .common import documents, pieces

SPACE = "▁"  # what the model writes for a space


class PairRanks:
    """Merge ranks of a sentencepiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(model.get_piece_size())
        plain = [i for i in n if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        # Neighbours that stand inside some piece; between others no merge can ever happen.
        self.inside = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}

    def runs(self, word: str) -> list[str]:
        """``word`` cut where no piece spans the cut."""
        out, at = [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.inside:
                out.append(word[at:i])
                at = i
        return [*out, word[at:]]

    def count(self, run: str) -> int:
        """Tokens of ``run``: its symbols less its merges, and the bytes of symbols that aren't pieces."""
        rank, symbols, n = self.rank, list(run), len(run)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], i, p) for i in range(n - 1) if (p := run[i : i + 2]) in rank]
        heapify(heap)
        merges = 0
        while heap:
            _, i, pair = heappop(heap)
            j = following[i]
            if j >= n or not symbols[i] or len(symbols[i]) + len(symbols[j]) != len(pair) or symbols[i] + symbols[j] != pair:
                continue  # one of the two has been merged with another meanwhile
            symbols[i], symbols[j] = pair, ""
            merges += 1
            after = following[i] = following[j]
            if after < n:
                before[after] = i
                if (p := pair + symbols[after]) in rank:
                    heappush(heap, (rank[p], i, p))
            if (first := before[i]) >= 0 and (p := symbols[first] + pair) in rank:
                heappush(heap, (rank[p], first, p))
        return n - merges + sum(len(s.encode()) - 1 for s in symbols if len(s) == 1 and s not in rank)


class _Runs(dict):
    def __init__(self, ranks: PairRanks, most: int):
        self.ranks, self.most, self.old = ranks, most, {}

    def __missing__(self, run: str) -> int:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        n = self.old.get(run)
        self[run] = n = self.ranks.count(run) if n is None else n
        return n


class _Words(dict):
    """Counts of words that follow a space, which becomes a symbol at their start."""

    def __init__(self, ranks: PairRanks, most: int):
        self.ranks, self.runs, self.most = ranks, _Runs(ranks, most), most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = n = sum(map(self.runs.__getitem__, self.ranks.runs(SPACE + word)))
        return n


class TokenCounter:
    """Counts of whole texts. Words are counted once while they are in the cache of ``most`` entries.

    No piece has a space symbol behind another character, so words between spaces don't touch; a run of
    spaces, where pieces of several do exist, is counted with the word that follows.
    """

    def __init__(self, path: str, most: int = 500_000):
        self.words = _Words(PairRanks(path), most)

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(self._piece(p if not i else p[1:]) for i, p in enumerate(pieces(text)))

    def _piece(self, text: str) -> int:
        words, get = text.replace(SPACE, " ").split(" "), self.words.__getitem__
        if "" not in words:
            return sum(map(get, words))
        total, spaces = 0, 0
        for i, word in enumerate(words):
            if word or i == len(words) - 1:
                total += get(SPACE * spaces + word)
                spaces = 0
            else:
                spaces += 1
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    """The counter that the tasks of one Python worker share."""
    return TokenCounter(path)


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """Per row doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``).

    A null text is an empty one and has no tokens; repeated rows are counted each; an empty table gives
    no rows. Rows keep their partitions: nothing is shuffled.
    """

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        of = counter(model).count
        for batch in batches:
            n = pa.array([of(t.as_py()) for t in batch.column(1)], pa.int64())
            size = pc.cast(pc.binary_length(batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = documents(docs)
    return rows.mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
