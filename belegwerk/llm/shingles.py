"""Distinct word shingles of whole texts as 52-bit hashes."""

from __future__ import annotations

import numpy as np

from belegwerk.llm.arrow_text import LOWER, words
from belegwerk.llm.hashing import RunHash, mix

BITS = 52
ROWS = 1 << (64 - BITS)  # texts that one call can tell apart
_ODD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(body: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice, and ``n + 1`` bounds.

    Words are runs of bytes that are no ASCII blank, with A-Z lower-cased. A text
    with fewer words than ``size`` has its whole sequence as one shingle, one
    without words has none.
    """
    n = len(at) - 1
    starts, ends, row = words(body, at)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    word = RunHash(LOWER[body]).of(starts, ends)
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    place = np.arange(len(row)) - first[row]  # of the word in its text
    begins = np.flatnonzero((place + size <= count[row]) | ((place == 0) & (count[row] < size)))
    owner, left = row[begins], np.minimum(count[row[begins]], size)
    total = left.astype(np.uint64) * _ODD[63]
    for k in range(size):
        inside = np.flatnonzero(left > k)
        total[inside] += mix(word[begins[inside] + k] + np.uint64(k)) * _ODD[k]
    # Text and hash in one number: one plain sort, no index array.
    code = (owner.astype(np.uint64) << np.uint64(BITS)) | (mix(total) >> np.uint64(64 - BITS))
    code.sort()
    new = np.ones(len(code), bool)
    new[1:] = code[1:] != code[:-1]
    code = code[new]
    bounds = np.searchsorted(code, np.arange(n + 1, dtype=np.uint64) << np.uint64(BITS)) if n < ROWS else np.append(
        np.searchsorted(code, np.arange(n, dtype=np.uint64) << np.uint64(BITS)), len(code)
    )
    return code & np.uint64((1 << BITS) - 1), bounds
