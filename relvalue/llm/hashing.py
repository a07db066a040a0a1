"""Hashes of words and of runs of words, many at a time."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values; seeds give unrelated orders."""
    x = x + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def runs(words: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of ``length`` words, from the words' hashes."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(length):
        total = total * _STEP + words[j : n + j]
    return mix(total, seed)


def chunks_by(group: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of each run of equal values in a sorted array."""
    if not len(group):
        return []
    cuts = np.flatnonzero(group[1:] != group[:-1]) + 1
    starts, ends = np.r_[0, cuts], np.r_[cuts, len(group)]
    return list(zip(group[starts].tolist(), starts.tolist(), ends.tolist()))
