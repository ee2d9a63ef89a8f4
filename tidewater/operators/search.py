"""Bayesian search of hyper-parameters: a Gaussian process over past trials chooses the next by expected improvement.

A trial is whatever `evaluate` does with its parameters, such as fitting a Spark ML model and scoring held-out rows; only
the trials themselves, a few dozen numbers, are modelled here. Parameters are mapped to the unit cube, in logarithms where
the scale says so.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

CANDIDATES = 2000


@dataclass(frozen=True)
class Range:
    """A parameter between two bounds; `log` searches its logarithm, `whole` takes whole numbers only."""

    name: str
    low: float
    high: float
    log: bool = False
    whole: bool = False

    def value(self, u: float) -> float:
        low, high = (math.log(self.low), math.log(self.high)) if self.log else (self.low, self.high)
        x = low + (high - low) * float(u)
        x = min(max(math.exp(x) if self.log else x, self.low), self.high)
        return int(round(x)) if self.whole else x

    def place(self, value: float) -> float:
        low, high, x = (math.log(self.low), math.log(self.high), math.log(value)) if self.log else (self.low, self.high, value)
        return (x - low) / (high - low) if high > low else 0.0


def _kernel(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
    """Matern 5/2."""
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)) * math.sqrt(5) / length
    return (1 + d + d * d / 3) * np.exp(-d)


def _fitted(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(length, noise) with the highest marginal likelihood on a grid."""
    best, found = -math.inf, (0.5, 1e-4)
    for length in (0.1, 0.2, 0.35, 0.6, 1.0, 2.0):
        for noise in (1e-6, 1e-4, 1e-2, 1e-1):
            low = np.linalg.cholesky(_kernel(x, x, length) + noise * np.eye(len(x)))
            a = np.linalg.solve(low, y)
            likelihood = -0.5 * a @ a - np.log(np.diag(low)).sum()
            if likelihood > best:
                best, found = likelihood, (length, noise)
    return found


def expected_improvement(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How much higher than the best of y the points `at` are expected to be."""
    mean, spread = y.mean(), y.std() or 1.0
    z = (y - mean) / spread
    length, noise = _fitted(x, z)
    k = _kernel(x, x, length) + noise * np.eye(len(x))
    cross = _kernel(at, x, length)
    middle = cross @ np.linalg.solve(k, z)
    sd = np.sqrt(np.maximum(1 - np.einsum("ij,ji->i", cross, np.linalg.solve(k, cross.T)), 1e-12))
    gain = middle - z.max()
    u = gain / sd
    normal = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in u])
    return (gain * normal + sd * np.exp(-u * u / 2) / math.sqrt(2 * math.pi)) * spread


def bayesian_search(evaluate: Callable[[dict[str, float]], float], space: Sequence[Range], trials: int, initial: int = 5, seed: int = 42) -> list[dict[str, float]]:
    """The trials in order, each with its parameters and `score` (higher is better). The first `initial` fill the space evenly.

    A score that isn't finite counts as the worst so far. A seeded rerun makes the same trials.
    """
    rng, done = np.random.default_rng(seed), []
    points: list[np.ndarray] = []
    start = (np.array([[(i * p + q) % 1 for p, q in zip(_steps(len(space)), rng.random(len(space)), strict=True)] for i in (range(initial))])) if initial else np.zeros((0, len(space)))
    for i in range(trials):
        if i < max(1, initial):
            u = start[i] if initial else rng.random(len(space))
        else:
            scores = np.array([t["score"] for t in done], float)
            finite = scores[np.isfinite(scores)]
            scores = np.where(np.isfinite(scores), scores, finite.min() if len(finite) else 0.0)
            best = points[int(scores.argmax())]
            at = np.concatenate([rng.random((CANDIDATES, len(space))), np.clip(best + rng.normal(0, 0.05, (CANDIDATES // 4, len(space))), 0, 1)])
            at = np.array([[r.place(r.value(v)) for r, v in zip(space, row, strict=True)] for row in at])  # whole numbers have few places
            u = at[int(expected_improvement(np.array(points), scores, at).argmax())]
        values = {r.name: r.value(v) for r, v in zip(space, u, strict=True)}
        points.append(np.array([r.place(values[r.name]) for r in space]))
        done.append(values | {"score": float(evaluate(values))})
    return done


def _steps(n: int) -> list[float]:
    """Steps of an additive recurrence that fills the unit cube evenly: powers of the root of x^(n+1) = x + 1."""
    x = 2.0
    for _ in range(60):
        x = (1 + x) ** (1 / (n + 1))
    return [(1 / x) ** (i + 1) for i in range(n)]
