"""The binary Golay code [23, 12, 7], as array operations.

It is perfect: every 23-bit word lies within 3 bits of exactly one codeword. A word at
distance 3 from its codeword has five others at distance 4, which its one-bit neighbours
decode to. Two words that differ in at most 2 bits therefore share one of the codewords that they
and their one-bit neighbours decode to (one, or six); two that differ in 1 bit even
share the codeword of either with those of the other.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

BITS, CHECKS = 23, 11
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the generator polynomial
GENERATOR = 0b101011100011
#: Words whose codewords are computed at once.
AT_ONCE = 1 << 16


def _remainder(words: np.ndarray) -> np.ndarray:
    rest = words.copy()
    for bit in range(BITS - 1, CHECKS - 1, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - CHECKS))
    return rest


@cache
def nearest_table() -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word, from the rule: correct the error its remainder stands for."""
    errors = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(BITS), n)], np.int64)
    by_remainder = np.zeros(1 << CHECKS, np.int64)
    by_remainder[_remainder(errors)] = errors
    out = np.empty(1 << BITS, np.int16)
    for at in range(0, len(out), AT_ONCE):  # all words at once would take some 200 MB of each Python worker for a moment
        words = np.arange(at, at + AT_ONCE, dtype=np.int64)
        out[at : at + AT_ONCE] = (words ^ by_remainder[_remainder(words)]) >> CHECKS
    return out


def nearest(words: np.ndarray) -> np.ndarray:
    """The one codeword within 3 bits of each word."""
    return nearest_table()[words].astype(np.int64)


def nearby(words: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Codewords of each word and its neighbours in the lower ``bits`` bits: rows of up to 6, padded with the first."""
    table = nearest_table()
    own = table[words].astype(np.int64)
    around = np.stack([table[words ^ (1 << b)] for b in range(bits)], 1).astype(np.int64)
    around.sort(1)
    fresh = np.ones(around.shape, bool)
    fresh[:, 1:] = around[:, 1:] != around[:, :-1]
    fresh &= around != own[:, None]
    out = np.repeat(own[:, None], 6, 1)
    row, column = np.nonzero(fresh)
    place = np.cumsum(fresh, 1)[row, column]
    out[row, place] = around[row, column]
    return out
