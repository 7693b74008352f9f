"""Hashed word n-grams of a text, as the sparse inputs of a linear model."""

from __future__ import annotations

import re
import zlib

import numpy as np

#: Features live in this many slots, so a model is a vector of this length whatever the corpus.
SLOTS = 1 << 18
_LETTERS = re.compile(r"[^\W\d_]+")
_SEED = [np.uint64(x) for x in (0x8D5F, 0x1B37, 0xC2A1, 0x6E45, 0x93D7)]


class _Tokens(dict):
    """For each token between white space its word (lower half) and its surface (upper half).

    The surface keeps case and punctuation and forgets the letters, so n-grams of surfaces carry over to
    words never seen: ``Word,`` is ``Aa,`` and ``WORD!!`` is ``A!!``.
    """

    def __init__(self, most: int):
        self.most = most

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        surface = _LETTERS.sub(lambda m: "A" if len(x := m[0]) > 1 and x.isupper() else "Aa" if x[0].isupper() else "a", token)
        self[token] = n = zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) | zlib.crc32(surface.encode("utf-8", "surrogatepass")) << 32
        return n


class NGrams:
    """Slots of a text's n-grams by kind: words, word pairs, surfaces, surface pairs and triples.

    A pair of surfaces also says whether its two words are the same.
    """

    def __init__(self) -> None:
        self.tokens = _Tokens(250_000)

    def slots(self, text: str) -> list[np.ndarray]:
        x = np.fromiter(map(self.tokens.__getitem__, text.split()), np.uint64)
        word, surface = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
        same = (word[1:] == word[:-1]).astype(np.uint64)
        pair = surface[1:] * np.uint64(3) + surface[:-1] * np.uint64(5) + same
        kinds = [word, word[1:] * np.uint64(3) + word[:-1], surface, pair, pair[1:] * np.uint64(7) + surface[:-2]]
        return [((k + s) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int64) for k, s in zip(kinds, _SEED) if len(k)]

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct slots and their values: the share of each n-gram among those of its kind."""
        kinds = self.slots(text)
        if not kinds:
            return np.zeros(0, np.int64), np.zeros(0)
        slot, at = np.unique(np.concatenate(kinds), return_inverse=True)
        return slot, np.bincount(at, np.concatenate([np.full(len(k), 1 / len(k)) for k in kinds]))

    def dot(self, text: str, weights: np.ndarray) -> float:
        """Sum over the features of value times weight."""
        return float(sum(weights[k].mean() for k in self.slots(text)))
