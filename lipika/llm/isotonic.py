"""Isotonic regression: pool adjacent violators, and the probability of a score."""

from __future__ import annotations

import numpy as np


def pool_adjacent(x: np.ndarray, positives: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """[scores, probabilities], both rising: blocks of rising ``x`` pooled until their shares of positives rise.

    Each share is drawn towards the overall one by a single observation, so no probability is exactly 0 or 1.
    """
    prior = positives.sum() / weight.sum()
    pooled: list[list[float]] = []
    for xi, p, w in zip(x, positives, weight, strict=True):
        pooled.append([xi * w, p, w])
        while len(pooled) > 1 and pooled[-2][1] * pooled[-1][2] >= pooled[-1][1] * pooled[-2][2]:
            a = pooled.pop()
            pooled[-1] = [u + v for u, v in zip(pooled[-1], a, strict=True)]
    return np.array([[sx / w for sx, _, w in pooled], [(p + prior) / (w + 1) for _, p, w in pooled]])


def probability(curve: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Between the blocks' centres linear, beyond them constant."""
    return np.clip(np.interp(raw, curve[0], np.maximum.accumulate(curve[1])), 0.0, 1.0)
