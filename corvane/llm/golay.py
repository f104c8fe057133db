"""The binary Golay code of length 23: 4096 codewords, and every word lies within three bits of exactly one."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, CHECKS = 23, 11
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR = 0b110001110101


def remainder(word: int) -> int:
    """The word's syndrome: its remainder by the generator, 0 for codewords."""
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the high and the low bits; for each syndrome the errors of up to four bits that lead to it, -1: no more."""
    high = np.array([remainder(x << 12) for x in range(1 << 11)], dtype=np.int64)
    low = np.array([remainder(x) for x in range(1 << 12)], dtype=np.int64)
    errors = np.full((1 << CHECKS, 6), -1, dtype=np.int64)
    found = np.zeros(1 << CHECKS, dtype=np.int64)
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            e = sum(1 << b for b in bits)
            s = high[e >> 12] ^ low[e & 4095]
            errors[s, found[s]] = e
            found[s] += 1
    return high, low, errors


def near_codewords(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word the indices of all codewords within four bits of it: one or six, -1 fills up.

    Words that differ in one bit have an index in common: the codeword within three bits of one is within four
    bits of the other.
    """
    high, low, errors = _tables()
    words = words.astype(np.int64)
    e = errors[high[words >> 12] ^ low[words & 4095]]
    return np.where(e < 0, -1, (words[:, None] ^ e) >> CHECKS)
