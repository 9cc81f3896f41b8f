"""The perfect binary Golay code [23, 12, 7] as a fuzzy hash of 23-bit words.

Any 23-bit word lies within 3 bits of exactly one codeword. A word within 2 bits of its codeword
gets that one key; a word 3 bits away also gets the five codewords 4 bits away (six keys). Two
words at most 2 bits apart have a word z at most 1 bit from either, whose codeword is a key of both.
"""

from __future__ import annotations

import itertools

import numpy as np

#: Fixed value: generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
KEYS = 6


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the three bytes of a word, and per syndrome the distances to nearby codewords (0: none)."""
    single = [_remainder(1 << i) for i in range(23)]
    of_byte = np.zeros((3, 256), np.uint16)
    for part, value in itertools.product(range(3), range(256)):
        for bit in range(8):
            if value >> bit & 1 and 8 * part + bit < 23:
                of_byte[part, value] ^= single[8 * part + bit]
    near: list[list[int]] = [[] for _ in range(2048)]
    nearest = [0] * 2048
    for weight in range(5):
        for bits in itertools.combinations(range(23), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= single[b]
            if weight < 4:
                nearest[syndrome] = weight
            if weight < 4 or nearest[syndrome] == 3:
                near[syndrome].append(sum(1 << b for b in bits))
    patterns = np.full((2048, KEYS), -1, np.int32)
    for syndrome, found in enumerate(near):
        patterns[syndrome, : len(found)] = found
    return of_byte, patterns


_BYTES, _PATTERNS = _tables()


def keys(words: np.ndarray) -> np.ndarray:
    """For each word (below 2^23) a row of six codeword indices of 12 bits, -1 where there are fewer; the nearest first."""
    words = words.astype(np.int64)
    syndrome = _BYTES[0][words & 255] ^ _BYTES[1][words >> 8 & 255] ^ _BYTES[2][words >> 16]
    patterns = _PATTERNS[syndrome].astype(np.int64)
    return np.where(patterns < 0, -1, (words[:, None] ^ patterns) >> 11)
