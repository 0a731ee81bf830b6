"""Keys of 23-bit words by the perfect binary Golay code.

Each word lies within three bits of exactly one codeword, whose 12 information bits are its index.
The keys of a word are the indexes of the word itself and of its 23 neighbours at one bit: one key if
the word is within two bits of its codeword, else six. Two words at two bits or fewer have a word in
between that is within one bit of both, so they share a key.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH, CHECKS = 23, 11
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << bit - CHECKS
    return word


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The remainder of each 12-bit head, and the error pattern of each remainder."""
    heads = np.array([_remainder(h << CHECKS) for h in range(1 << LENGTH - CHECKS)], np.int64)
    errors = np.full(1 << CHECKS, -1, np.int64)
    for n in range(4):
        for places in combinations(range(LENGTH), n):
            pattern = sum(1 << p for p in places)
            errors[_remainder(pattern)] = pattern
    assert (errors >= 0).all()  # the code is perfect
    return heads, errors


def index(words: np.ndarray) -> np.ndarray:
    """Index of the nearest codeword of each word (int64, 23 bits used)."""
    heads, errors = _tables()
    remainder = heads[words >> CHECKS] ^ words & (1 << CHECKS) - 1
    return (words ^ errors[remainder]) >> CHECKS


def ball_indexes(words: np.ndarray, width: int = LENGTH) -> np.ndarray:
    """(len(words), width + 1): the indexes of each word and of its neighbours in the lowest bits."""
    flips = np.array([0, *(1 << b for b in range(width))], np.int64)
    return index(words[:, None] ^ flips[None, :])
