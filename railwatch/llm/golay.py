"""The perfect binary Golay code of 23 bits as a fuzzy hash.

A word decodes to the one codeword within three bits of it. The codewords that
a word and its 23 neighbours at one bit decode to are its keys: one where the
word lies within two bits of its codeword, six otherwise. Two words within two
bits have a word between them that is a neighbour of both, so they share a key.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

BITS = 23
# Generator polynomial of the cyclic code (fixed value).
GENERATOR = 0b110001110101
_CHECK_BITS = 11


def _remainder(word: int) -> int:
    for bit in range(BITS - 1, _CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - _CHECK_BITS)
    return word


# Syndromes are linear, so those of single bits give all others.
_BIT_SYNDROMES = np.array([_remainder(1 << i) for i in range(BITS)], np.int64)


def _syndromes(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.int64)
    for i, syndrome in enumerate(_BIT_SYNDROMES):
        out ^= (words >> i & 1) * syndrome
    return out


def _error_patterns() -> np.ndarray:
    """The lightest error of every syndrome."""
    table = np.zeros(1 << _CHECK_BITS, np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(BITS), weight):
            table[np.bitwise_xor.reduce(_BIT_SYNDROMES[list(bits)])] = sum(1 << b for b in bits)
    return table


_ERRORS = _error_patterns()
MAX_KEYS = 6


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Up to six 12-bit codeword indices of each word: values, and which of them are set."""
    words = words.astype(np.int64)
    syndromes = _syndromes(words)
    found = np.empty((len(words), BITS + 1), np.int64)
    found[:, BITS] = (words ^ _ERRORS[syndromes]) >> _CHECK_BITS
    for i in range(BITS):
        found[:, i] = (words ^ (1 << i) ^ _ERRORS[syndromes ^ _BIT_SYNDROMES[i]]) >> _CHECK_BITS
    found.sort(axis=1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    rank = np.cumsum(first, axis=1) - 1
    values = np.zeros((len(words), MAX_KEYS), np.int64)
    rows = np.nonzero(first)[0]
    values[rows, rank[first]] = found[first]
    return values, np.arange(MAX_KEYS) <= rank[:, -1:]
