"""Words of byte arrays in numpy: bounds and hashes for many texts at once."""

from __future__ import annotations

import numpy as np

# An odd multiplier and its inverse modulo 2**64, and the mixer of splitmix64.
PRIME = 0x9E3779B97F4A7C15
INVERSE = pow(PRIME, -1, 1 << 64)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def byte_table() -> np.ndarray:
    """A-Z folded to lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def _word_bytes() -> np.ndarray:
    """Bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; of UTF-8, all bytes above ASCII belong."""
    inside = np.ones(256, bool)
    inside[0x00:0x30] = inside[0x3A:0x61] = inside[0x7B:0x80] = False
    return inside


def word_bounds(data: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word; words end at document starts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _word_bytes()[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[doc_starts] = True
    cut[0] = cut[-1] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    return np.flatnonzero(inside & (~before | cut[:-1])), np.flatnonzero(inside & (~after | cut[1:])) + 1


def runs_of(own: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each run of true values; runs end at document starts."""
    if not len(own):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(own) + 1, bool)
    cut[doc_starts] = True
    begin = np.flatnonzero(own & (cut[:-1] | ~np.concatenate(([False], own[:-1]))))
    return begin, np.flatnonzero(own & (cut[1:] | ~np.concatenate((own[1:], [False])))) + 1


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(MIX[0])
    values = (values ^ (values >> np.uint64(27))) * np.uint64(MIX[1])
    return values ^ (values >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal ranges have equal hashes wherever they stand."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(PRIME, len(data)), out=sums[1:])
    value = (sums[end] - sums[begin]) * powers(INVERSE, len(data) + 1)[begin]
    return mixed(value ^ (np.asarray(end - begin).astype(np.uint64) << np.uint64(48)))


word_hashes = span_hashes
