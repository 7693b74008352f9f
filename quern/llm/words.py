"""Words as 64-bit numbers, and runs of words as one."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from .common import pieces
from .darts import U, mix

WORD = re.compile(r"\w+")
_GOLDEN = U(0x9E3779B97F4A7C15)
#: Characters whose words are numbered at a time.
_STRETCH = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """An odd number for each character that words are made of, 0 for every other one."""
    inside = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool)
    inside[ord("_")] = True
    return np.where(inside, mix(np.arange(1, 0x110001, dtype=U) * _GOLDEN) | U(1), U(0))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 1 to ``n`` of an odd number, and those of its inverse, modulo 2^64."""
    return np.cumprod(np.full(n, _GOLDEN)), np.cumprod(np.full(n, U(pow(int(_GOLDEN), -1, 1 << 64))))


def _numbered(text: str) -> np.ndarray:
    value = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    inside = np.concatenate([[False], value != 0])
    start = np.flatnonzero(inside[1:] > inside[:-1])
    if not len(start):
        return np.zeros(0, U)
    power, inverse = _powers(max(1 << 16, 1 << (len(value) - 1).bit_length()))
    # A word is the polynomial of its characters, wherever in the text it begins.
    value *= power[: len(value)]
    return mix(np.add.reduceat(value, start) * inverse[start])


def word_hashes(text: str) -> np.ndarray:
    """The words of ``text`` (runs that WORD finds, case folded) as 64-bit numbers, in order."""
    if len(text) <= _STRETCH:
        return _numbered(text)
    return np.concatenate([_numbered(p) for p in pieces(text, _STRETCH)])


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """A number for each run of ``width`` words; fewer words are one run; none give none."""
    width = min(width, len(words))
    if not width:
        return words
    n = len(words) - width + 1
    out = np.zeros(n, U)
    for i in range(width):
        out = (out ^ (out >> U(29))) * U(0xD6E8FEB86659FD93) + words[i : i + n] + _GOLDEN
    return out
