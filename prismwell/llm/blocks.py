"""Cutting texts into blocks by their own content, so that equal passages give equal blocks.

A window is ``window`` values that follow one another (bytes or words). It is led by the least hash
of the shorter grams that it holds, the leftmost of equals: its anchor, the same wherever the window
occurs. Windows that start one after the other and share an anchor form a block. Equal windows thus
lie in blocks with equal anchor grams, at equal distances from them.

Where a text repeats itself, as a line said over and over does, equal blocks follow one another so
closely that the windows of one touch those of the next. At equal steps they are folded into one row,
which has the first start, the step and how often the block occurs.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .spans import leftmost_minima, rolling_hashes


def window_blocks(values: np.ndarray, text: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, anchor's place, anchor's hash) of each block.

    ``text`` tells which text each value belongs to; no window reaches over two.
    """
    n = len(values) - window + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, empty.astype(np.uint64)
    grams = rolling_hashes(values, gram)
    starts = np.flatnonzero(text[:n] == text[window - 1 :])
    anchors = leftmost_minima(grams, window - gram + 1)[starts]
    if not len(starts):
        return empty, empty, empty, empty.astype(np.uint64)
    edge = np.flatnonzero((np.diff(anchors) != 0) | (np.diff(starts) != 1)) + 1
    first = np.concatenate([[0], edge])
    count = np.diff(np.concatenate([first, [len(starts)]]))
    return starts[first], count, anchors[first], grams[anchors[first]]


def folded(text: np.ndarray, first: np.ndarray, count: np.ndarray, digest: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the first, step, times): equal blocks of one text at equal steps, whose windows touch, as one.

    ``digest`` has a row of longs for each block.
    """
    order = np.lexsort((first, digest[:, 1], digest[:, 0], text))
    t, d, gap = text[order], digest[order], np.diff(first[order], prepend=0)
    apart = np.ones(len(order), bool)
    apart[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1]).any(axis=1) | (gap[1:] > count[order][1:] + window - 1)
    other = np.zeros(len(order), bool)
    other[1:] = ~apart[1:] & ~apart[:-1] & (gap[1:] != gap[:-1])
    lead = np.flatnonzero(apart | other)
    times = np.diff(np.append(lead, len(order)))
    step = np.where(times > 1, gap[np.minimum(lead + 1, len(order) - 1)], 0)
    return order[lead], step, times


def digests(parts: list[bytes]) -> np.ndarray:
    """The 128-bit digest of each, as a row of two longs."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), "<i8").reshape(-1, 2)
