"""The perfect binary Golay code of 23 bits as a hash that tolerates two flipped bits.

Every 23-bit word lies within three bits of exactly one of the 4,096 codewords.
A word's keys are the codewords that itself and its one-bit neighbours decode
to. Two words that differ in two bits have a word halfway between them; both
hold its codeword, so words within two bits always share a key.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Fixed value: a generator polynomial of the code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
BITS, CHECK_BITS = 23, 11


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 12 upper bits, and the error pattern of each remainder."""
    remainders = np.zeros(1 << (BITS - CHECK_BITS), np.uint32)
    for upper in range(len(remainders)):
        rest = upper << CHECK_BITS
        for at in range(BITS - 1, CHECK_BITS - 1, -1):
            if rest >> at & 1:
                rest ^= GENERATOR << (at - CHECK_BITS)
        remainders[upper] = rest
    errors = np.zeros(1 << CHECK_BITS, np.uint32)
    for weight in range(1, 4):
        for places in combinations(range(BITS), weight):
            pattern = sum(1 << p for p in places)
            errors[remainders[pattern >> CHECK_BITS] ^ (pattern & 0x7FF)] = pattern
    return remainders, errors


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The message (12 bits) of the one codeword within three bits of each word."""
    remainders, errors = _tables()
    syndrome = remainders[words >> CHECK_BITS] ^ (words & np.uint32(0x7FF))
    return (words ^ errors[syndrome]) >> CHECK_BITS


def fuzzy_keys(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the distinct codewords of each word of ``width`` bits and of its neighbours in those bits."""
    flips = np.concatenate([[0], 1 << np.arange(width)]).astype(np.uint32)
    found = np.sort(codeword_index(words.astype(np.uint32)[:, None] ^ flips), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    return np.nonzero(new)[0], found[new]
