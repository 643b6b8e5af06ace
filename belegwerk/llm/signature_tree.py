"""Signature trees: sets under OR-combined bitmaps and size ranges, joined in pairs.

A set's bitmap has one bit for each hash bucket that holds an element. Of two sets
the overlap is at most the elements of one minus its bits that the other lacks. A
node holds the OR of its sets' bitmaps, their size range and the most elements that
share a bit; two nodes' sets overlap by at most the common bits plus those, so node
pairs that cannot hold a link are pruned together.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

FAN = 16  # sets of a leaf, children of a node
PAIRS = 1 << 17  # set pairs looked at together


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of sets of these sizes that link."""
    return -(-percent * (a + b) // (100 + percent))


def bitmap_bits(n: int) -> int:
    """Bits of the bitmap of a set of ``n``: a power of two of at least 3/4 of ``n``."""
    return max(64, 1 << (max(1, (3 * n + 3) // 4) - 1).bit_length())


def bitmap(codes: np.ndarray) -> bytes:
    bits = np.zeros(bitmap_bits(len(codes)), bool)
    bits[(codes & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def fold(maps: np.ndarray) -> np.ndarray:
    """Bitmaps of half the length: bucket ``k`` and ``k + half`` become one."""
    half = maps.shape[1] // 2
    return maps[:, :half] | maps[:, half:]


class Signatures:
    """Bitmaps of many sets, kept as one matrix for each length and its foldings."""

    def __init__(self, sizes: np.ndarray, blobs: list[bytes]):
        self.sizes = sizes.astype(np.int64)
        self.words = np.fromiter((len(b) // 8 for b in blobs), np.int64, len(blobs))
        self.place = np.zeros(len(blobs), np.int64)
        self.maps: dict[tuple[int, int], np.ndarray] = {}
        for length in np.unique(self.words).tolist():
            own = np.flatnonzero(self.words == length)
            self.place[own] = np.arange(len(own))
            maps = np.frombuffer(b"".join(blobs[k] for k in own), np.uint64).reshape(len(own), length)
            self.maps[length, length] = maps
        self.extra = self.sizes.copy()  # elements beyond one for each bit
        for (length, _), maps in list(self.maps.items()):
            own = np.flatnonzero(self.words == length)
            self.extra[own] -= np.bitwise_count(maps).sum(1, dtype=np.int64)

    def matrix(self, length: int, to: int) -> np.ndarray:
        """All bitmaps of ``length`` words, folded to ``to`` words."""
        if (length, to) not in self.maps:
            self.maps[length, to] = fold(self.matrix(length, 2 * to)) if to * 2 <= length else self.maps[length, length]
        return self.maps[length, to]

    def rows(self, index: np.ndarray, to: int) -> np.ndarray:
        out = np.empty((len(index), to), np.uint64)
        for length in np.unique(self.words[index]).tolist():
            own = np.flatnonzero(self.words[index] == length)
            out[own] = self.matrix(length, to)[self.place[index[own]]]
        return out

    def may_link(self, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of sets the bitmaps and sizes cannot rule out."""
        a, b = self.sizes[x], self.sizes[y]
        out = np.minimum(a, b) >= needed(a, b, percent)
        least = np.minimum(self.words[x], self.words[y])
        for to in np.unique(least[out]).tolist():
            own = np.flatnonzero(out & (least == to))
            for lot in range(0, len(own), max(1, (1 << 20) // to)):
                k = own[lot:lot + max(1, (1 << 20) // to)]
                left, right = self.rows(x[k], to), self.rows(y[k], to)
                only_left = np.bitwise_count(left & ~right).sum(1, dtype=np.int64)
                only_right = np.bitwise_count(right & ~left).sum(1, dtype=np.int64)
                most = np.minimum(a[k] - only_left, b[k] - only_right)
                out[k] = most >= needed(a[k], b[k], percent)
        return out


class Tree:
    """Levels of nodes over a group's sets in order; level 0 holds the leaves."""

    def __init__(self, signatures: Signatures, members: np.ndarray):
        s = signatures
        to = int(s.words[members].min())
        maps, low, high = s.rows(members, to), s.sizes[members], s.sizes[members]
        # Folding makes more elements share a bit.
        extra = s.sizes[members] - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = []
        while True:
            at = np.arange(0, len(maps), FAN)
            maps = np.bitwise_or.reduceat(maps, at, 0)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            extra = np.maximum.reduceat(extra, at)
            self.levels.append((maps, low, high, extra))
            if len(maps) == 1:
                break

    def pairs(self, level: int, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """Which node pairs may hold a link."""
        maps, low, high, extra = self.levels[level]
        out = np.zeros(len(x), bool)
        lot_size = max(1, (1 << 20) // maps.shape[1])
        for lot in range(0, len(x), lot_size):
            a, b = x[lot:lot + lot_size], y[lot:lot + lot_size]
            common = np.bitwise_count(maps[a] & maps[b]).sum(1, dtype=np.int64)
            most = np.minimum(common + np.minimum(extra[a], extra[b]), np.minimum(high[a], high[b]))
            # The smallest sets of two nodes that can link at all need the least overlap.
            small_a = np.maximum(low[a], -(-percent * low[b] // 100))
            small_b = np.maximum(low[b], -(-percent * low[a] // 100))
            reach = (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
            out[lot:lot + lot_size] = reach & (most >= needed(small_a, small_b, percent))
        return out


def expand(x: np.ndarray, y: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """All child pairs of node pairs; children of a node with itself once."""
    k = np.arange(FAN)
    a = (x[:, None, None] * FAN + k[:, None]) + np.zeros(FAN, np.int64)
    b = (y[:, None, None] * FAN + k[None, :]) + np.zeros((FAN, 1), np.int64)
    a, b = a.ravel(), b.ravel()
    keep = (a < count) & (b < count) & (a <= b)
    return a[keep], b[keep]


def join_group(
    signatures: Signatures, members: np.ndarray, percent: int,
    classes: Callable[[np.ndarray], np.ndarray],
    test: Callable[[np.ndarray, np.ndarray], None],
) -> None:
    """Offer every pair of a group that may link and is not in one class yet.

    ``classes`` gives the present class of each set, ``test`` looks at pairs and
    merges classes. Pivots first: in a group of near copies they leave one class,
    and pairs of nodes within one class are passed over.
    """
    order = members[np.lexsort((members, signatures.sizes[members]))]

    def offer(x: np.ndarray, y: np.ndarray) -> None:
        apart = classes(x) != classes(y)
        x, y = x[apart], y[apart]
        if len(x):
            may = signatures.may_link(x, y, percent)
            test(x[may], y[may])

    if len(order) > FAN:
        for turn in range(8):
            labels = classes(order)
            if (labels == labels[0]).all():
                return
            pivot = order[len(order) * (2 * turn + 1) // 16]
            offer(np.full(len(order), pivot), order)
    tree = Tree(signatures, order)
    stack = [(len(tree.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, x, y = stack.pop()
        labels = classes(order)
        lo = np.minimum.reduceat(labels, np.arange(0, len(order), FAN ** (level + 1)))
        hi = np.maximum.reduceat(labels, np.arange(0, len(order), FAN ** (level + 1)))
        open_ = ~((lo[x] == hi[x]) & (lo[y] == hi[y]) & (lo[x] == lo[y]))
        x, y = x[open_], y[open_]
        keep = tree.pairs(level, x, y, percent)
        x, y = x[keep], y[keep]
        for lot in range(0, len(x), PAIRS // FAN ** 2):
            count = len(tree.levels[level - 1][1]) if level else len(order)
            a, b = expand(x[lot:lot + PAIRS // FAN ** 2], y[lot:lot + PAIRS // FAN ** 2], count)
            if level:
                stack.append((level - 1, a, b))
            else:
                offer(order[a[a < b]], order[b[a < b]])
