"""Gear hashing of code points, vectorised, shared by the chunkers.

The gear hash of position i is the sum over the last WINDOW code points of
gear(c) << age, modulo 2**64: it depends on those code points only, so equal
stretches hash equally wherever they stand.
"""

from __future__ import annotations

import numpy as np

WINDOW = 16
_MULT = 0x9E3779B97F4A7C15
#: Base of the digests: odd, so it has an inverse modulo 2**64.
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


def code_points(text: str) -> np.ndarray:
    """The text's code points; lone surrogates, which no file format should hold, pass unharmed."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gear(codes: np.ndarray) -> np.ndarray:
    """A fixed pseudo-random 64-bit number for each code point."""
    with np.errstate(over="ignore"):
        x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(_MULT)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x


def rolling(gears: np.ndarray) -> np.ndarray:
    """The gear hash at each position, by doubling the window: 4 passes for 16 code points."""
    h = gears.copy()
    with np.errstate(over="ignore"):
        step = 1
        while step < WINDOW:
            moved = np.zeros_like(h)
            moved[step:] = h[:-step] << np.uint64(step)
            h = h + moved
            step *= 2
    return h


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over values[i : i + width], for each i with the whole window inside."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def landmarks(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the least hash of some window of ``width`` positions.

    Any ``width`` consecutive positions contain a landmark, and whether a
    position is one depends on the width - 1 positions to either side only.
    Shorter inputs have none.
    """
    n = len(hashes)
    if n < width:
        return np.zeros(0, dtype=np.int64)
    least = sliding(hashes, width, np.minimum)
    pad = np.zeros(width - 1, dtype=hashes.dtype)
    best = sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    return np.flatnonzero(hashes == best)


class Digests:
    """Digests of any stretch of one sequence in constant time each."""

    def __init__(self, gears: np.ndarray, which: int = 0):
        n = len(gears)
        with np.errstate(over="ignore"):
            self.inverse = _powers(INVERSES[which], n + 1)
            self.sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(gears * _powers(BASES[which], n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * np.uint64(_MULT)
            x ^= x >> np.uint64(31)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(29)
        return x.view(np.int64)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        grown = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        grown[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(grown, dtype=np.uint64)
        if len(have) <= 1 << 22:
            _POWERS[base] = have
    return have[:n]
