"""Bounded common prefixes of one block of bytes by breadth-first backward extension on its Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


def _eights(block: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number; zeros follow the end."""
    wide = np.concatenate([block, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(wide, 8)[: len(block)].copy().view(">u8").ravel().astype(np.uint64)


def suffix_order(block: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by their next ``depth`` bytes at least (prefix doubling from eight bytes on; only ties go on)."""
    n = len(block)
    keys = _eights(block)
    order = np.argsort(keys, kind="stable")
    new = np.append(True, keys[order][1:] != keys[order][:-1])
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[n] = -1
    h = 8
    while h < depth:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        at = order[tied]
        key = (rank[at] << np.int64(32)) | (rank[np.minimum(at + h, n)] + 1)
        by = np.argsort(key, kind="stable")
        order[tied], key = at[by], key[by]
        fresh = np.append(True, key[1:] != key[:-1])
        new[tied] |= fresh
        rank[order[tied]] = np.maximum.accumulate(np.where(fresh, tied, 0))
        h *= 2
    return order


def long_prefix_classes(block: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and, for each entry, whether it shares ``least`` bytes or more with the entry before.

    Common-prefix values are found in increasing order: each interval of suffixes that begin with one string is
    extended backward by every byte that precedes it; where the extended interval's right border has no value yet, the
    present length is its value and the interval goes to the next round, else it is dropped. Rounds end at ``least``;
    borders without a value then have a longer common prefix. The first eight rounds are read off the next eight bytes.
    The block's last byte must be 0 and the only one (UTF-8 text leaves room: callers shift its bytes up).
    """
    n = len(block)
    order = suffix_order(block, least)
    before = block[order - 1]  # of the first position: the closing 0
    by = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)  # last-to-first mapping
    step[by] = np.arange(n)
    keys = _eights(block)[order]
    known = np.append(np.append(True, keys[1:] != keys[:-1]), True)  # borders whose value is set: below eight
    first = np.flatnonzero(known[:-1])
    size = np.diff(np.append(first, n))
    for _ in range(8, least):
        if not len(first):
            break
        total = int(size.sum())
        at = np.repeat(first - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(total)
        owner = np.repeat(np.arange(len(first)), size)
        to = step[at]
        by = np.argsort(to)
        to, owner = to[by], owner[by]
        byte = before[at[by]]
        cut = np.flatnonzero(np.append(True, (to[1:] != to[:-1] + 1) | (owner[1:] != owner[:-1]) | (byte[1:] != byte[:-1])))
        lo = to[cut]
        wide = np.diff(np.append(cut, total))
        open_ = ~known[lo + wide]
        first, size = lo[open_], wide[open_]
        known[first + size] = True
    return order, ~known[:-1]


def repeated_starts(block: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """Which of the marked starts (boolean by position) have the same next ``least`` bytes as another marked start."""
    if len(block) < least:
        return np.zeros(len(block), bool)
    order, same = long_prefix_classes(block, least)
    group = np.cumsum(~same) - 1
    marked = starts[order]
    many = np.bincount(group, weights=marked) >= 2
    out = np.zeros(len(block), bool)
    out[order] = marked & many[group]
    return out
