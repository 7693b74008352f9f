"""Word-aligned packing of token ids: Simple-8b words in blocks that decode independently.

A word's top 4 bits select how many ids of how many bits its low 60 bits hold, the first id lowest.
Selector 0 is an escape: the low bits index the table of ids that need more than 60 bits. A block holds
``BLOCK`` ids (the last one fewer), never shares a word with another and starts at a recorded word, so
all blocks are packed or unpacked in step, or one alone.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 256
MAGIC = b"QS8B"
_HEAD = struct.Struct("<4sHHQIIQ")
# Fixed values of the coding: ids to a word by selector 1 to 14; the widths follow.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = 60 // COUNTS
_ESCAPE = len(COUNTS)
_LIMITS = np.uint64(1) << WIDTHS.astype(np.uint64)
_FITS = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)


def pack(ids: np.ndarray) -> bytes:
    """``ids``, non-negative integers below 2**64, as one payload; none give a payload of no words."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    ends = np.full(blocks, BLOCK)
    if blocks:
        ends[-1] = n - BLOCK * (blocks - 1)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = ids
    grid = np.zeros((blocks, BLOCK + 64), np.uint64)
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    # The selector from which on an id fits, and its maxima over runs of 1, 2, 4, ... ids.
    fits = _FITS[grid] if n and int(ids.max()) < len(_FITS) else np.searchsorted(_LIMITS, grid.ravel(), side="right").astype(np.uint8).reshape(grid.shape)
    runs = [fits]
    for h in (1, 2, 4, 8, 16):
        runs.append(np.maximum(runs[-1][:, :-h], runs[-1][:, h:]))
    choice = np.full((blocks, BLOCK), _ESCAPE, np.uint8)
    for s in range(_ESCAPE - 1, -1, -1):
        k = int(COUNTS[s]).bit_length() - 1
        shift = COUNTS[s] - (1 << k)
        np.copyto(choice, np.uint8(s), where=np.maximum(runs[k][:, :BLOCK], runs[k][:, shift : shift + BLOCK]) <= s)
    counts = np.append(COUNTS, 1)
    rows, at, steps = np.arange(blocks), np.zeros(blocks, np.int64), []
    while len(rows):
        picked = choice[rows, at]
        steps.append((rows, at, picked))
        at = at + counts[picked]
        go_on = at < ends[rows]
        rows, at = rows[go_on], at[go_on]
    row = np.concatenate([x[0] for x in steps]) if steps else np.zeros(0, np.int64)
    start = np.concatenate([x[1] for x in steps]) if steps else np.zeros(0, np.int64)
    picked = np.concatenate([x[2] for x in steps]) if steps else np.zeros(0, np.uint8)
    order = np.argsort(row, kind="stable")
    row, start, picked = row[order], start[order], picked[order]
    words = np.zeros(len(row), np.uint64)
    for s in np.unique(picked):
        here = np.flatnonzero(picked == s)
        if s == _ESCAPE:
            escapes = grid[row[here], start[here]]
            words[here] = np.arange(len(here), dtype=np.uint64)
            continue
        values = grid[row[here][:, None], start[here][:, None] + np.arange(COUNTS[s])]
        values <<= (WIDTHS[s] * np.arange(COUNTS[s])).astype(np.uint64)
        words[here] = np.bitwise_or.reduce(values, axis=1) | np.uint64((int(s) + 1) << 60)
    if not (picked == _ESCAPE).any():
        escapes = np.zeros(0, np.uint64)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=blocks))]).astype("<u4")
    head = _HEAD.pack(MAGIC, 1, BLOCK, n, len(words), len(escapes), 0)
    return b"".join((head, offsets.tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()))


def unpack(payload: bytes, first_block: int = 0, n_blocks: int | None = None) -> np.ndarray:
    """The ids of a payload, or of ``n_blocks`` blocks from ``first_block`` on; the rest isn't touched."""
    magic, version, block, n, n_words, n_escapes, _ = _HEAD.unpack_from(payload)
    if magic != MAGIC or version != 1:
        raise ValueError("not a Simple-8b payload of version 1")
    blocks = -(-n // block)
    last = blocks if n_blocks is None else min(blocks, first_block + n_blocks)
    offsets = np.frombuffer(payload, "<u4", blocks + 1, _HEAD.size).astype(np.int64)
    base = _HEAD.size + 4 * (blocks + 1)
    words = np.frombuffer(payload, "<u8", n_words, base)[offsets[first_block] : offsets[last]]
    escapes = np.frombuffer(payload, "<u8", n_escapes, base + 8 * n_words)
    size = max(0, min(n, last * block) - first_block * block)
    if not size:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.concatenate([[1], COUNTS])[selector]
    starts = offsets[first_block:last] - offsets[first_block]
    before = np.cumsum(counts) - counts
    lengths = np.diff(np.append(starts, len(words)))
    begin = np.arange(last - first_block) * block
    place = before - np.repeat(before[starts] - begin, lengths)
    limit = np.repeat(np.minimum(begin + block, size), lengths)
    out = np.zeros(size, np.uint64)
    for s in np.unique(selector):
        here = np.flatnonzero(selector == s)
        if s == 0:
            out[place[here]] = escapes[(words[here] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        c, w = COUNTS[s - 1], WIDTHS[s - 1]
        values = (words[here][:, None] >> (w * np.arange(c)).astype(np.uint64)) & np.uint64((1 << int(w)) - 1)
        to = place[here][:, None] + np.arange(c)
        inside = to < limit[here][:, None]
        out[to[inside]] = values[inside]
    return out
