"""Vectorised hashing of words, word windows and byte windows over many texts at once (numpy, 64 bits).

A byte is first replaced by a random 64-bit number, so a polynomial in an odd base modulo 2**64 keeps close to 64 bits.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
SEED = 20_240_607
_rng = np.random.default_rng(SEED)
BYTE = _rng.integers(0, 2**64, 256, dtype=U)
BASE, WORD_BASE = U(0x9E3779B97F4A7C15 | 1), U(0xD1342543DE82EF95 | 1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
STRETCH = 1 << 18
"""Bytes that are hashed at a time."""
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def inverse(base: np.uint64) -> np.uint64:
    return U(pow(int(base), -1, 2**64))


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1024)
        steps = np.full(size, base, U)
        steps[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts: byte ranges ``start``, ``end``; ``doc`` of each; ``first`` word and ``count`` of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        inside = ~SPACE[data]
        before = np.r_[False, inside[:-1]] if len(inside) else inside
        heads = offsets[:-1][offsets[:-1] < len(data)]
        before[heads] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.r_[inside[1:], False] if len(inside) else inside
        tails = offsets[1:][offsets[1:] > 0] - 1
        after[tails] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        edges = np.searchsorted(self.start, offsets)
        self.first, self.count = edges[:-1], np.diff(edges)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)
        self.place = np.arange(len(self.start)) - np.repeat(self.first, self.count)


def word_hashes(data: np.ndarray, w: Words) -> np.ndarray:
    n = len(w.start)
    out = np.empty(n, U)
    lens = w.end - w.start
    upto = np.cumsum(lens)
    lo = 0
    while lo < n:  # some words at a time: work arrays take many times the bytes they are about
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + STRETCH, "right")))
        some = lens[lo:hi]
        ends = np.cumsum(some)
        local = np.arange(int(ends[-1])) - np.repeat(ends - some, some)
        at = local + np.repeat(w.start[lo:hi], some)
        out[lo:hi] = np.add.reduceat(BYTE[data[at]] * powers(BASE, int(some.max()))[local], ends - some)
        lo = hi
    return mix(out + lens.astype(U))


def windows(values: np.ndarray, width: int, base: np.uint64 = WORD_BASE) -> np.ndarray:
    """Hash of values[i : i + width] for each i at which that many are left."""
    n = len(values)
    if n < width:
        return np.zeros(0, U)
    total = np.zeros(n + 1, U)
    np.cumsum(values * powers(base, n), out=total[1:])
    return mix((total[width:] - total[:-width]) * powers(inverse(base), n)[: n - width + 1])
