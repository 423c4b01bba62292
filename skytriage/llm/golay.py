"""Keys from the perfect binary Golay code of length 23.

Every 23-bit word lies within three flips of exactly one codeword. Two words one flip apart
share a key when one side takes the index of its own codeword and the other side also takes
those of the codewords four flips away (``near_keys``):

* decoded to the same codeword: shared;
* otherwise the flip leads from three flips around one codeword to three around another, so
  the first codeword is exactly four flips from the second word. Only words three flips from
  their own codeword have codewords at four flips, and each has five.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed value: generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
LENGTH = 23
CHECK_BITS = 11


def _remainder(words: np.ndarray) -> np.ndarray:
    """Remainders of polynomials with 0/1 coefficients (as bits) by the generator."""
    left = words.copy()
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        left ^= np.where(left >> bit & 1, GENERATOR << (bit - CHECK_BITS), 0)
    return left


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per remainder: the flips to the own codeword, their number, and five flips of four (or zeros)."""
    single = _remainder(np.left_shift(1, np.arange(LENGTH)))
    own, weight = np.zeros(1 << CHECK_BITS, dtype=np.int64), np.zeros(1 << CHECK_BITS, dtype=np.int64)
    far: dict[int, list[int]] = {}
    for flips in range(1, 5):
        for places in combinations(range(LENGTH), flips):
            at, mask = 0, 0
            for p in places:
                at, mask = at ^ int(single[p]), mask | 1 << p
            if flips < 4:
                own[at], weight[at] = mask, flips
            elif weight[at] == 3:
                far.setdefault(at, []).append(mask)
    others = np.zeros((1 << CHECK_BITS, 5), dtype=np.int64)
    for at, masks in far.items():
        others[at] = masks
    return own, weight, others


def own_key(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword of each word."""
    return (words ^ tables()[0][_remainder(words)]) >> CHECK_BITS


def near_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Six indices per word and which of them count: the own one, then the five at four flips if there are any."""
    own, weight, others = tables()
    rest = _remainder(words)
    flips = np.concatenate([own[rest][:, None], others[rest]], axis=1)
    real = np.concatenate([np.ones((len(words), 1), dtype=bool), np.repeat((weight[rest] == 3)[:, None], 5, axis=1)], axis=1)
    return (words[:, None] ^ flips) >> CHECK_BITS, real
