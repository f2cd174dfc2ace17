"""Binary Golay code (23, 12, 7): nearest and nearby codewords of 23-bit words, vectorised.

The code is perfect: every word lies within distance 3 of exactly one codeword. A word at
distance 3 has, besides, exactly five codewords at distance 4. Words that differ in at most two
bits always have a codeword in common among these, which makes the codeword numbers usable as
hash keys that tolerate bit errors.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed value: generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
LENGTH, DIMENSION, PARITY = 23, 12, 11
#: Most keys that one word has: its own codeword and five at distance 4.
MOST_KEYS = 6


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, PARITY - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - PARITY)
    return word


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the upper 12 bits; by syndrome the error of least weight, and the five of weight 4 (0: none)."""
    high = np.array([_remainder(h << PARITY) for h in range(1 << DIMENSION)], dtype=np.uint32)
    of = lambda w: int(high[w >> PARITY]) ^ w & (1 << PARITY) - 1
    leader = np.zeros(1 << PARITY, dtype=np.uint32)
    other = np.zeros((1 << PARITY, MOST_KEYS - 1), dtype=np.uint32)
    weight3 = np.zeros(1 << PARITY, dtype=bool)
    seen = np.zeros(1 << PARITY, dtype=np.int64)
    for weight in range(1, 5):
        for places in combinations(range(LENGTH), weight):
            e = sum(1 << p for p in places)
            s = of(e)
            if weight < 4:
                leader[s] = e
                weight3[s] = weight == 3
            elif weight3[s]:
                other[s, seen[s]] = e
                seen[s] += 1
    return high, leader, other


def syndrome(words: np.ndarray) -> np.ndarray:
    high, _, _ = _tables()
    w = words.astype(np.uint32)
    return high[w >> PARITY] ^ (w & np.uint32((1 << PARITY) - 1))


def nearest(words: np.ndarray) -> np.ndarray:
    """Number (0..4095) of the one codeword within distance 3 of each word."""
    _, leader, _ = _tables()
    w = words.astype(np.uint32)
    return (w ^ leader[syndrome(w)]) >> PARITY


def nearby(words: np.ndarray) -> np.ndarray:
    """Array (n, 6) of codeword numbers: the nearest, then those at distance 4; -1 where there is none."""
    _, leader, other = _tables()
    w = words.astype(np.uint32)
    s = syndrome(w)
    out = np.full((len(w), MOST_KEYS), -1, dtype=np.int32)
    out[:, 0] = (w ^ leader[s]) >> PARITY
    more = other[s]
    out[:, 1:] = np.where(more > 0, ((w[:, None] ^ more) >> PARITY).astype(np.int32), -1)
    return out
