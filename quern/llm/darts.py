"""DartMinHash: sketches of weighted sets by darts that land in elements' regions.

An element of weight w owns w unit cells. Each cell is hit by darts at ranks that follow a Poisson
process, drawn from hashes of the cell, so equal cells of any two sets are hit alike. A dart belongs to
one of ``k`` coordinates and a coordinate keeps its earliest dart. Two sketches agree at a coordinate with
the weighted Jaccard similarity of the sets as probability. Ranks are drawn in doubling levels and only
until every coordinate has a dart, so a set costs about k log k darts besides its cells.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
_GOLDEN = U(0x9E3779B97F4A7C15)
#: Expected darts of a cell in level 0; level 1 has as many, each further level twice those before it.
FIRST = 2.0**-6


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=64)
def _poisson(mean: float) -> np.ndarray:
    """P(count <= n) for n = 0, 1, ... until it is 1."""
    n = np.arange(int(mean + 12 * mean**0.5 + 20))
    logs = n * np.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(n[1:]))])
    return np.minimum(np.cumsum(np.exp(logs)), 1.0)


def cells(shingles: np.ndarray) -> np.ndarray:
    """Sorted unit cells of a multiset of 64-bit elements: the j-th occurrence of an element is its j-th cell."""
    x = np.sort(shingles)
    if not len(x):
        return x
    new = np.concatenate([[True], x[1:] != x[:-1]])
    first = np.flatnonzero(new)
    nth = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
    return np.sort(mix(x + nth.astype(U) * _GOLDEN))


def weighted_cells(elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of 64-bit elements with real weights, whose each is (a place in ``elements``), and the share of each that is owned.

    The last cell of a weight that isn't whole is owned in part; a weight of 0 owns nothing.
    """
    count = np.ceil(weights).astype(np.int64)
    of = np.repeat(np.arange(len(elements)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return mix(elements[of] + nth.astype(U) * _GOLDEN), of, np.minimum(weights[of] - nth, 1.0)


def sketches(cell: np.ndarray, owner: np.ndarray, n: int, k: int, share: np.ndarray | None = None) -> np.ndarray:
    """(n, k) earliest darts. ``cell``: cells of ``n`` sets one after the other; ``owner``: whose each is.

    ``share`` is the part of each cell that its set owns (all of it by default): a dart beyond it misses. A
    set without cells, or with shares of 0 alone, gets zeros.
    """
    if share is not None:
        cell, owner, share = cell[share > 0], owner[share > 0], share[share > 0]
    out = np.zeros(n * k, U)
    empty = np.ones(n * k, bool)
    left = np.zeros(n, np.int64)
    left[np.unique(owner)] = k
    level = 0
    while len(cell):
        mean = FIRST * 2.0 ** max(0, level - 1)
        seed = mix(np.array([level + 1], U) * _GOLDEN)[0]
        base = mix(cell ^ seed)
        count = np.searchsorted(_poisson(mean), (base >> U(11)).astype(np.float64) * 2.0**-53, side="right")
        hit = np.flatnonzero(count)
        times = count[hit]
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        dart = mix(np.repeat(base[hit], times) + (nth + 1).astype(U) * _GOLDEN)
        place = np.repeat(owner[hit], times) * k + ((dart >> U(32)) * U(k) >> U(32)).astype(np.int64)
        if share is not None:
            # Where in its cell a dart lands, by bits that its coordinate doesn't use.
            inside = (dart & U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < np.repeat(share[hit], times)
            dart, place = dart[inside], place[inside]
        fresh = empty[place]
        dart, place = dart[fresh], place[fresh]
        order = np.lexsort((mix(dart), place))
        dart, place = dart[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
        out[place[first]] = dart[first]
        empty[place[first]] = False
        left -= np.bincount(place[first] // k, minlength=n)
        stay = left[owner] > 0
        if not stay.all():
            cell, owner = cell[stay], owner[stay]
            share = share if share is None else share[stay]
        level += 1
    return out.reshape(n, k)


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """Keys of a sketch's bands of ``rows`` coordinates each; the band's number is part of its key."""
    n, k = sketch.shape
    grid = sketch.reshape(n, k // rows, rows)
    key = np.broadcast_to(mix(np.arange(1, k // rows + 1, dtype=U) * _GOLDEN), (n, k // rows)).copy()
    for r in range(rows):
        key = mix(key * U(31) + grid[:, :, r])
    return key.view(np.int64)
