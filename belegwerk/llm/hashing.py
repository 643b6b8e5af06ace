"""64-bit hashes of many byte runs of one buffer at once."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd: invertible modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
_SYMBOL = np.random.default_rng(20_24).integers(1 << 62, size=256, dtype=np.uint64) * 2 + 1


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0`` to ``base ** n`` modulo 2**64; kept for the next call."""
    if len(_POWERS.get(base, ())) <= n:
        out = np.full(n + 1 + n // 4, base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n + 1]


class RunHash:
    """Hash of any run ``body[start:end]`` from prefix sums of one polynomial.

    ``body`` holds bytes or code points.
    """

    def __init__(self, body: np.ndarray):
        self.sums = np.zeros(len(body) + 1, np.uint64)
        symbols = _SYMBOL[body] if body.dtype == np.uint8 else mix(body + np.uint64(BASE))
        np.cumsum(symbols * powers(BASE, len(body))[:len(body)], out=self.sums[1:])
        self.shift = powers(INVERSE, len(body))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.shift[starts]
        return mix(raw + np.asarray(ends - starts, np.uint64) * np.uint64(BASE))

    def every(self, size: int) -> np.ndarray:
        """Hash of each run of ``size`` neighbours, in order."""
        raw = self.sums[size:] - self.sums[:-size]
        raw *= self.shift[:len(raw)]
        raw += np.uint64(size * BASE & (1 << 64) - 1)
        return mix(raw)
