"""Search for parameters (OPT): loops on the driver around an evaluation that runs as one job for many points."""

from __future__ import annotations

import random
from collections.abc import Callable

Score = Callable[[list[float]], list[float]]
"""Scores of many values of one parameter at once: a grid joined to the counts."""


def linear(score: Score, start: float, scope: float, steps: int = 15, rounds: int = 4) -> tuple[float, float]:
    """OPT2: the best of some steps between start / scope and start * scope, in ever narrower scopes."""
    best, value = start, score([start])[0]
    for _ in range(rounds):
        points = [best / scope * (scope * scope) ** (i / (steps - 1)) for i in range(steps)]
        for p, v in zip(points, score(points), strict=True):
            if v > value:
                best, value = p, v
        scope = 1 + (scope - 1) / 3
    return best, value


def golden(score: Score, low: float, high: float, precision: float = 0.003) -> tuple[float, float]:
    """OPT3: golden-section search for a maximum, until the bracket is narrow relative to its low end."""
    ratio = (5**0.5 - 1) / 2
    c, d = high - ratio * (high - low), low + ratio * (high - low)
    fc, fd = score([c, d])
    while (high - low) / max(abs(low), 1e-12) > precision:
        if fc >= fd:
            high, d, fd = d, c, fc
            c = high - ratio * (high - low)
            fc = score([c])[0]
        else:
            low, c, fc = c, d, fd
            d = low + ratio * (high - low)
            fd = score([d])[0]
    return (c, fc) if fc >= fd else (d, fd)


def integer(score: Score, low: int, high: int) -> tuple[int, float]:
    """OPT4: the best of a range, the smallest of equals."""
    points = list(range(low, high + 1))
    values = score([float(p) for p in points])
    i = max(range(len(points)), key=lambda k: (values[k], -k))
    return points[i], values[i]


def randomized(p: float, scope: float, rng: random.Random) -> float:
    """OPT4: a random change within the scope."""
    r = 1 / scope if scope > 1 else 0.8
    return p * (r + rng.random() * 2 * (1 - r))


def coordinate_ascent(score: Callable[[dict[str, float]], float], start: dict[str, float], order: list[str], scope: float = 4.0, rounds: int = 6) -> tuple[dict[str, float], float]:
    """OPT1: one parameter after the other; the scope halves after each round that helped, and the search ends after one that didn't."""
    best, value = dict(start), score(start)
    for _ in range(rounds):
        before = value
        for name in order:
            p, v = linear(lambda xs, name=name: [score(best | {name: x}) for x in xs], best[name], scope, 7, 1)
            if v > value:
                best, value = best | {name: p}, v
        if value <= before:
            break
        scope = max(1 + (scope - 1) / 2, 1.01)
    return best, value
