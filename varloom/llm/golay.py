"""The binary Golay code of length 23, as tables made from its generator polynomial.

Each 23-bit word lies within three flips of exactly one of the 4,096 codewords; that
codeword's 12 message bits are the word's index. Two words one flip apart need not share
an index, but the index of one is always among the indices of the other's 24 nearest
words (itself and its neighbours), of which at most six differ.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
GENERATOR = 0b101011100011
BITS, CHECK = 23, 11


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits, and the flips that each syndrome stands for."""
    single = np.zeros(BITS, np.int32)
    for i in range(BITS):
        r = 1 << i
        for k in range(BITS - 1, CHECK - 1, -1):
            if r >> k & 1:
                r ^= GENERATOR << (k - CHECK)
        single[i] = r
    spread = lambda bits: np.array(
        [np.bitwise_xor.reduce([single[i] for i in bits if v >> (i - bits[0]) & 1] or [0]) for v in range(1 << len(bits))],
        np.int32,
    )
    flips = np.zeros(1 << CHECK, np.int32)
    for k in (1, 2, 3):
        for at in combinations(range(BITS), k):
            flips[np.bitwise_xor.reduce(single[list(at)])] = sum(1 << i for i in at)
    return spread(range(12)), spread(range(12, BITS)), flips


def index(words: np.ndarray) -> np.ndarray:
    """12-bit indices of 23-bit words."""
    low, high, flips = _tables()
    words = words.astype(np.int32)
    return (words ^ flips[low[words & 0xFFF] ^ high[words >> 12]]) >> CHECK


def near_indices(words: np.ndarray) -> np.ndarray:
    """(n, 24) sorted indices of each word and its 23 neighbours; repeats after the first are -1."""
    masks = np.array([0] + [1 << i for i in range(BITS)], np.int32)
    found = np.sort(index(words.astype(np.int32)[:, None] ^ masks[None, :]), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found
