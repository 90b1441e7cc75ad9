"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai common prefixes, binary search."""

from __future__ import annotations

import numpy as np

#: Positions that one lane of the prefix computation walks through.
LANE = 128


def suffix_array(first: np.ndarray, depth: int, positions: np.ndarray | None = None) -> np.ndarray:
    """Sorted order of the suffixes at ``positions`` (default all).

    ``first[p]`` is a number that orders the first ``depth`` symbols at ``p``; 0 marks positions whose
    order is of no interest (and beyond which suffixes are not told apart). Each round doubles the sorted
    depth, and touches only the groups that are still tied.
    """
    n = len(first)
    if positions is None:
        positions = np.arange(n, dtype=np.int64)
    order = np.argsort(first[positions], kind="stable")
    sa = positions[order]
    if not len(sa):
        return sa
    keys = first[sa]
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    rank = np.zeros(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(len(sa)), 0)) + 1
    tied = np.flatnonzero(~(new & np.concatenate((new[1:], [True]))))
    h = depth
    while len(tied):
        p = sa[tied]
        ahead = p + h
        follow = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], 0)
        key = (rank[p].astype(np.uint64) << np.uint64(32)) | follow.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        p, key, follow = p[order], key[order], follow[order]
        sa[tied] = p
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[p] = np.maximum.accumulate(np.where(new, tied, 0)) + 1
        tied = tied[~(new & np.concatenate((new[1:], [True]))) & (follow != 0)]
        h *= 2
    return sa


def packed_words(data: np.ndarray, pad: int) -> np.ndarray:
    """For each byte position the eight bytes from there, big-endian, and ``pad`` more positions of zeros."""
    padded = np.concatenate((data, np.zeros(pad + 8, np.uint8)))
    words = padded[: len(data) + pad].astype(np.uint64)
    for i in range(1, 8):
        words <<= np.uint64(8)
        words |= padded[i : len(data) + pad + i]
    return words


def common_prefixes(words: np.ndarray, n: int, sa: np.ndarray, cap: int) -> np.ndarray:
    """Bytes, up to ``cap``, that each suffix of ``sa`` shares with the one before it.

    Kasai's rule: the suffix one position later shares at least one byte less with its own predecessor.
    The text is cut into lanes that walk in step, so that each step is one array operation. ``words`` is
    ``packed_words`` with a pad of ``cap``.
    """
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    shared = np.zeros(n, np.int32)
    starts = np.arange(0, n, LANE)
    h = np.zeros(len(starts), np.int64)
    for step in range(min(LANE, n)):
        i = starts + step
        if i[-1] >= n:
            starts, h, i = starts[:-1], h[:-1], i[:-1]
        j = before[i]
        h = np.where(j < 0, 0, np.maximum(h - 1, 0))
        live = np.flatnonzero((j >= 0) & (h < cap))
        while len(live):
            differ = words[i[live] + h[live]] ^ words[j[live] + h[live]]
            same = differ == 0
            h[live[same]] += 8
            rest = differ[~same]
            h[live[~same]] += sum((rest < np.uint64(1 << (8 * k))).astype(np.int64) for k in range(1, 8))
            live = live[same]
            live = live[h[live] < cap]
        h = np.minimum(h, np.minimum(cap, n - np.maximum(i, j)))
        shared[i] = h
    return shared[sa]


def narrow(symbols: np.ndarray, sa: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Narrow intervals of ``sa`` that agree on ``depth`` symbols to those with ``wanted`` next.

    Both ends are found by binary search, for all intervals at once. ``symbols`` must be padded so that
    every position plus ``depth`` exists.
    """
    def bound(right: bool) -> np.ndarray:
        a, b = low.copy(), high.copy()
        while True:
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                return a
            middle = (a[open_] + b[open_]) >> 1
            value = symbols[sa[middle] + depth]
            up = value <= wanted[open_] if right else value < wanted[open_]
            a[open_[up]] = middle[up] + 1
            b[open_[~up]] = middle[~up]

    return bound(False), bound(True)
