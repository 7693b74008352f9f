"""Names of a block's suffixes: numbers that are equal where long enough prefixes are.

A block is the UTF-8 bytes of consecutive documents. Only suffixes at positions of a difference cover are
named at first: whatever two positions, some common shift below the cover's period puts both on the
cover, so a string of ``length`` bytes that repeats also repeats a cover string of length - period + 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Perfect difference sets, every non-zero residue once as a difference of two members.
COVERS = {
    7: (1, 2, 4),
    13: (0, 1, 3, 9),
    21: (3, 6, 7, 12, 14),
    31: (1, 5, 11, 24, 25, 27),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
}
_BASE, _SEGMENT = 0x9E3779B97F4A7C15, 1 << 19
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def cover(length: int) -> tuple[int, tuple[int, ...]]:
    """The largest period below about 0.6 of ``length``, and its residues."""
    period = max((v for v in COVERS if v <= max(7, 0.6 * length)))
    if length < period:
        raise ValueError(f"strings of {length} bytes are too short for a cover of period {period}")
    return period, COVERS[period]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _powers:
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers[n] = both[0], both[1]
    return _powers[n]


def names(data: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first position, names of the strings of ``length`` bytes from there on), stretch by stretch."""
    power, inverse = _tables(_SEGMENT + 1024)
    for at in range(0, len(data) - length + 1, _SEGMENT):
        part = data[at : at + _SEGMENT + length - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * power[: len(part)], out=sums[1:])
        n = len(part) - length + 1
        x = (sums[length:] - sums[:n]) * inverse[:n]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        yield at, x ^ (x >> np.uint64(29))


class Block:
    """Documents' bytes in order, and where a string of ``length`` bytes may start without leaving its document."""

    def __init__(self, texts: list[bytes], length: int):
        self.length, self.period = length, cover(length)[0]
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts])
        self.starts = self.ends - [len(t) for t in texts]
        self.whole = self._room(length)

    def _room(self, length: int) -> np.ndarray:
        """Whether ``length`` bytes fit from each position on."""
        fits = np.ones(len(self.data), bool)
        for s, e in zip(self.starts.tolist(), self.ends.tolist()):
            fits[max(s, e - length + 1) : e] = False
        return fits

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions on the cover and the names of their strings."""
        period, residues = cover(self.length)
        short = self.length - period + 1
        on, fits = np.zeros(period, bool), self._room(short)
        on[list(residues)] = True
        where, what = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for at, x in names(self.data, short):
            here = np.flatnonzero(np.resize(np.roll(on, -(at % period)), len(x)) & fits[at : at + len(x)])
            where.append(here + at)
            what.append(x[here])
        return np.concatenate(where), np.concatenate(what)

    def suffixes(self, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions that can tie for ``length`` bytes, as a ``tied`` cover position lies within reach, and their names."""
        reach = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(reach, np.maximum(tied - self.period + 1, 0), 1)
        np.add.at(reach, tied + 1, -1)
        can = (np.cumsum(reach[:-1]) > 0) & self.whole
        where, what = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for at, x in names(self.data, self.length):
            here = np.flatnonzero(can[at : at + len(x)])
            where.append(here + at)
            what.append(x[here])
        return np.concatenate(where), np.concatenate(what)

    def covered(self, repeats: np.ndarray) -> np.ndarray:
        """Whether a byte lies in a string that starts at one of ``repeats``."""
        change = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(change, repeats, 1)
        np.add.at(change, repeats + self.length, -1)
        return np.cumsum(change[:-1]) > 0


def distinct(what: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct names, for each place its name's rank, and whether an earlier place has the same name."""
    order = np.argsort(what, kind="stable")
    ranked = what[order]
    new = np.ones(len(what), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    rank, again = np.empty(len(what), np.int64), np.empty(len(what), bool)
    rank[order] = np.cumsum(new) - 1
    again[order] = ~new
    return ranked[new], rank, again
