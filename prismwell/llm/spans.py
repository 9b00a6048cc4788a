"""Vectorised hashing of words, bytes and windows for whole batches of texts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time; arrays take some 60 bytes for each.
BATCH_BYTES = 1 << 20
# fixed values: ASCII white space as the contracts name it, and odd multipliers
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[str, np.ndarray] = {}


def give_back() -> None:
    """Return freed memory to the system, for the end of a task: a Python worker lives on, and several wait at a time."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS["up"]) < n + 1:
        size = max(n + 1, BATCH_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"][: n + 1], _POWERS["down"][: n + 1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of polynomial hashes, in place."""
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of values times powers, by which any range is hashed."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[: len(values)], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges from start to end, equal for equal values wherever they lie."""
    _, down = powers(len(sums))
    return mixed((sums[end] - sums[start]) * down[start])


def rolling_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k values that follow one another; empty if there are fewer."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(values)
    _, down = powers(len(sums))
    return mixed((sums[k:] - sums[:-k]) * down[:n])


def batches_of(texts: list[bytes], limit: int = BATCH_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts): runs of texts of some ``limit`` bytes together."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def words_of(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(joined bytes, starts, ends, index of the text) of every word of the texts."""
    buf = b"\n".join(texts)
    space = np.ones(len(buf) + 2, bool)
    space[1:-1] = SPACE[np.frombuffer(buf, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[0::2], edges[1::2]
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return buf, starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(buf: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each word."""
    return range_hashes(prefix_sums(np.frombuffer(buf, np.uint8).astype(np.uint16) + 1), starts, ends)


def leftmost_minima(values: np.ndarray, window: int) -> np.ndarray:
    """For each start, where the least of the ``window`` values from there is, the leftmost of equals."""
    n = len(values) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, width = values, np.arange(len(values), dtype=np.int32), 1
    while width < window:
        step = min(width, window - width)
        later = best[step:] < best[:-step]
        at = np.where(later, at[step:], at[:-step])
        best = np.where(later, best[step:], best[:-step])
        width += step
    return at


def as_long(h: np.ndarray) -> np.ndarray:
    """Unsigned hashes as signed longs."""
    return h.view(np.int64)
