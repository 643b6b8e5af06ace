"""Wavelet matrix: rank of any symbol before any place of a byte sequence, and bisection on ranks.

Each level holds one bit of every symbol, the most significant first, and passes the
symbols on with those of bit 0 before those of bit 1. A directory of popcounts gives
the ones before each word of 64 bits, so a rank costs two lookups a level. All queries
take arrays of places.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Symbols below ``1 << bits``."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.size = bits, len(symbols)
        self.words, self.ones, self.zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> np.uint8(level)) & np.uint8(1)
            packed = np.zeros((len(symbols) // 64 + 1) * 8, np.uint8)
            row = np.packbits(bit, bitorder="little")
            packed[:len(row)] = row
            words = packed.view("<u8")
            directory = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=directory[1:])
            side = bit.view(bool)
            self.words.append(words)
            self.ones.append(directory)
            self.zeros.append(len(symbols) - int(directory[-1]))
            symbols = np.concatenate([symbols[~side], symbols[side]])

    def _ones_before(self, level: int, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[level][word] + np.bitwise_count(self.words[level][word] & below)

    def rank(self, symbol: int, place: np.ndarray) -> np.ndarray:
        """How many of the symbols before each place are ``symbol``."""
        both = np.append(np.asarray(place, np.int64), 0)
        for level in range(self.bits):
            ones = self._ones_before(level, both)
            both = ones + self.zeros[level] if symbol >> (self.bits - 1 - level) & 1 else both - ones
        return both[:-1] - both[-1]

    def count(self, symbols: tuple[int, ...], place: np.ndarray) -> np.ndarray:
        """How many of the symbols before each place are one of ``symbols``."""
        return sum((self.rank(s, place) for s in symbols), np.zeros(len(place), np.int64))

    def after(self, symbols: tuple[int, ...], wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least place from ``low`` to ``high`` that ``wanted`` of ``symbols`` from ``low`` on precede.

        There must be that many before ``high``. Bisection on the ranks.
        """
        low, high = low.astype(np.int64), high.astype(np.int64)
        goal = wanted + self.count(symbols, low)
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) >> 1
            enough = self.count(symbols, middle) >= goal[open_]
            high[open_[enough]] = middle[enough]
            low[open_[~enough]] = middle[~enough] + 1
        return low
