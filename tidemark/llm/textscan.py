"""Vectorised scanning of Arrow text columns: words, word hashes and rolling hashes of word or byte runs.

Words are the maximal runs of bytes other than space and 0x09-0x0D, as in ``[^\\x20\\x09-\\x0D]+``.
All hashes are polynomial hashes modulo 2**64 passed through a mixing step; they only propose candidates
or name strings together with a second hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of text that one numpy step takes; a longer document is one step of its own.
STEP = 1 << 18
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of base and of its inverse, modulo 2**64."""
    size = 1 << max(20, int(n).bit_length())
    up, down = _powers(base, size)
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolling(values: np.ndarray, k: int, base: int = BASES[0]) -> np.ndarray:
    """Hash of each run of k consecutive values (uint64), by its start."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(values))
    total = np.cumsum(values * up, dtype=np.uint64)
    runs = total[k - 1 :].copy()
    runs[1:] -= total[: n - 1]
    return mix(runs * down[:n])


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[0], out=out[1:], dtype=np.uint64)
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for arrays of bounds, from prefix_sums."""
    return mix((sums[end] - sums[start]) * powers(base, len(sums))[1][start] + (end - start).astype(np.uint64))


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w consecutive values, by its start."""
    n = len(values)
    if n < w:
        return np.zeros(0, values.dtype)
    if w == 1:
        return values
    pad = -n % w
    full = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def minimizers(hashes: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of w consecutive hashes the position of its minimum, as runs: the distinct positions in
    order, and the first window of each (the runs are contiguous). The order is by the upper 32 bits, ties go to
    the left, so equal windows choose alike."""
    ranked = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    chosen = sliding_min(ranked, w) & np.uint64(0xFFFFFFFF)
    if not len(chosen):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
    return chosen[first].astype(np.int64), first


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def steps(column: pa.Array, limit: int = STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of about limit bytes: first row, row after the last, their bytes, offsets into these."""
    data, offsets = texts(column)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


class Words:
    """The words of some rows: row, start and end byte, in order; ``first[r]`` is row r's first word. ``flags`` are the
    bytes that words consist of, if not all but spaces."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, flags: np.ndarray | None = None):
        n = len(data)
        solid = np.zeros(n + 2, bool)
        solid[1:-1] = ~SPACE[data] if flags is None else flags
        begins, ends = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        begins[inner] = solid[inner + 1]
        ends[inner - 1] = solid[inner]
        self.data, self.offsets = data, offsets
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, data: np.ndarray | None = None, base: int = BASES[0]) -> np.ndarray:
        data = self.data if data is None else data
        return span_hash(prefix_sums(data.astype(np.uint64) + np.uint64(1), base), self.start, self.end, base)
