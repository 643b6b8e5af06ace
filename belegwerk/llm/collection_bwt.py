"""Burrows-Wheeler order of many short strings, built one column at a time.

Round ``j`` inserts, for every string, its suffix of length ``j``: one symbol in
front of the suffix inserted before. The order of all suffixes that have a symbol in
front, sorted stably by that symbol, is the order of the suffixes one longer, so the
transform of one round gives the order of the next; strings are never compared.
"""

from __future__ import annotations

import numpy as np


def columns(texts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Symbols of each string by distance from its end, from 1 up; 0 is before the string.

    Symbols are numbered from 1 in their order.
    """
    size = np.diff(at)
    used = np.bincount(texts, minlength=256) > 0
    kind = np.uint8 if used.sum() < 256 else np.uint16
    code = np.cumsum(used).astype(kind)
    out = np.zeros((len(size), int(size.max(initial=0)) + 2), kind)
    for back in range(1, out.shape[1] - 1):
        own = np.flatnonzero(size >= back)
        out[own, back] = code[texts[at[own + 1] - back]]
    return out


def suffix_order(texts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """String and length of every suffix of one symbol or more, in lexical order.

    Equal suffixes follow each other in the order of their strings.
    """
    size = np.diff(at)
    symbols = columns(texts, at)
    width = symbols.shape[1]
    flat = symbols.ravel()
    n = len(size)
    # A suffix is string * width + length; the empty ones come first in every round.
    empty = np.arange(n, dtype=np.int32 if n * width < 1 << 31 else np.int64) * width
    order = empty
    for _ in range(int(size.max(initial=0))):
        front = flat[order + 1]  # the transform: the symbol in front of each suffix
        place = np.argsort(front, kind="stable")[len(front) - np.count_nonzero(front):]  # whole strings have none
        order = np.concatenate([empty, order[place] + 1])
    order = order[n:]
    return order // width, order % width


def common_prefix_groups(
    texts: np.ndarray, at: np.ndarray, owner: np.ndarray, length: np.ndarray, depth: int
) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of at least ``depth`` symbols, and where a new common prefix begins.

    Neighbours in order whose common prefix has ``depth`` symbols are one group.
    """
    long = np.flatnonzero(length >= depth)
    start = at[owner[long] + 1] - length[long]
    new = np.ones(len(long), bool)
    for lot in range(1, len(long), 1 << 18):
        a, b = start[lot - 1:lot - 1 + (1 << 18)], start[lot:lot + (1 << 18)]
        a = a[:len(b)]
        same = np.ones(len(b), bool)
        for k in range(depth):
            live = np.flatnonzero(same)
            same[live] = texts[a[live] + k] == texts[b[live] + k]
        new[lot:lot + (1 << 18)] = ~same
    return long, new
