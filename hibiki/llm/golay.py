"""The binary Golay code of length 23: fuzzy keys for 23-bit words.

Every word lies within three bits of exactly one of the 4096 codewords. The keys of a word are
the codewords next to it and to the 23 words one bit away: one key, or six. Two words that differ
in at most two bits have a word between them that is at most one bit from either, so they share
the key of that word.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

BITS = 23
_GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def _remainder(word: int) -> int:
    for shift in range(BITS - 1, 10, -1):
        if word >> shift & 1:
            word ^= _GENERATOR << (shift - 11)
    return word


class Golay:
    def __init__(self):
        flips = np.array([0] + [1 << i for i in range(BITS)], np.uint32)
        self._syndromes = np.array([_remainder(int(f)) for f in flips], np.uint16)
        self._low = self._table(0, 12)
        self._high = self._table(12, 11)
        leaders = np.zeros(2048, np.uint32)  # the error of at most three bits behind a syndrome
        for weight in (1, 2, 3):
            for bits in combinations(range(BITS), weight):
                error = sum(1 << b for b in bits)
                leaders[_remainder(error)] = error
        # Only the upper twelve bits of a codeword are its index; the rest follows from them.
        self._flips, self._leaders = flips >> 11, leaders >> 11

    def _table(self, first: int, bits: int) -> np.ndarray:
        table = np.zeros(1 << bits, np.uint16)
        for i in range(bits):
            table[1 << i:2 << i] = table[:1 << i] ^ self._syndromes[first + i + 1]
        return table

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codeword indices near each word: an array of 24 columns, and which of them to use."""
        syndromes = self._low[words & 0xFFF] ^ self._high[words >> 12]
        near = (words >> 11)[:, None] ^ self._flips ^ self._leaders[syndromes[:, None] ^ self._syndromes]
        near = np.sort(near.astype(np.uint16), axis=1)
        first = np.ones(near.shape, bool)
        first[:, 1:] = near[:, 1:] != near[:, :-1]
        return near, first
