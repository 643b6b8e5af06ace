"""Content-defined anchors: where equal strings of a fixed length must meet.

Every window of ``WIDTH`` bytes has an anchor, the run of ``GRAM`` bytes in it with
the least hash (the leftmost of equal ones). Equal windows have equal anchors, and
neighbouring windows mostly share theirs, so a text falls into fragments: stretches
of windows with one anchor.
"""

from __future__ import annotations

import numpy as np

from belegwerk.llm.hashing import RunHash, mix

WIDTH, GRAM = 50, 16
REACH = WIDTH - GRAM + 1  # places of a run in a window
PLACE_BITS = 24  # a slice holds at most 2**24 bytes


def sliding_least(values: np.ndarray, reach: int) -> np.ndarray:
    """Least value of every ``reach`` neighbours, from running minima of blocks."""
    n = len(values) - reach + 1
    padded = np.full(-(-len(values) // reach) * reach, np.iinfo(values.dtype).max, values.dtype)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, reach)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[reach - 1:reach - 1 + n])


def fragments(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, end of windows, anchor hash and row of each fragment of a slice."""
    none = np.zeros(0, np.int64)
    if len(body) < WIDTH:
        return none, none, none.astype(np.uint64), none
    if len(body) >= 1 << PLACE_BITS:
        raise ValueError("a slice is too long")
    place = np.arange(len(body) - GRAM + 1)
    code = RunHash(body).every(GRAM)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_least((code & ~mask) | place.astype(np.uint64), REACH)
    spot = (least & mask).astype(np.int64)
    usable = np.zeros(len(spot) + 1, np.int64)  # windows within one text
    size = np.diff(at)
    own = np.flatnonzero(size >= WIDTH)
    np.add.at(usable, at[own], 1)
    np.add.at(usable, at[own + 1] - WIDTH + 1, -1)
    inside = np.cumsum(usable[:-1]) > 0
    new = np.ones(len(spot), bool)
    new[1:] = (spot[1:] != spot[:-1]) | ~inside[:-1]
    new[at[own]] = True
    first = np.flatnonzero(new & inside)
    stop = np.ones(len(spot) + 1, bool)
    stop[:-1] = new | ~inside
    ends = np.flatnonzero(stop)
    end = ends[np.searchsorted(ends, first, "right")]
    # Anchors are least values: mixed again, they spread evenly over all numbers.
    return first, end, mix(code[spot[first]] + np.uint64(1)), np.searchsorted(at, first, "right") - 1
