"""Logistic regression on a bounded training sample."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def _descend(times: Callable, back: Callable, n: int, d: int, y: np.ndarray, l2: float, rounds: int):
    """Accelerated gradient descent; ``times`` and ``back`` multiply by the rows (a last column of ones) and their transpose."""
    prior = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    if n == 0 or y.min() == y.max():
        return np.zeros(d), prior
    v = np.ones(d + 1)
    for _ in range(20):  # largest eigenvalue, for the step
        v = back(times(v))
        top = np.linalg.norm(v)
        v /= top
    step, penalty = 1 / (0.26 * top + l2), np.append(np.full(d, l2), 0.0)
    w = np.append(np.zeros(d), prior)
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(times(ahead), -30, 30)))
        new = ahead - step * (back(p - y) + penalty * ahead)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (old - 1) / t * (new - w)
        w = new
    return w[:-1], float(w[-1])


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent on the L2-penalised log loss; the bias is not penalised.

    One class only (or no rows): zero weights and the smoothed log odds as bias.
    """
    n, d = x.shape
    a = np.concatenate([x, np.ones((n, 1))], axis=1).astype(np.float64)
    return _descend(lambda w: a @ w, lambda v: a.T @ v, n, d, y, l2, rounds)


def fit_sparse(row: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, l2: float = 1.0,
               rounds: int = 400) -> tuple[np.ndarray, float]:
    """``fit`` of len(y) rows that hold ``value[col]`` at the (row, col) pairs and 0 elsewhere; memory follows the pairs."""
    n, d = len(y), len(value)
    times = lambda w: np.bincount(row, (w[:-1] * value)[col], n) + w[-1]
    back = lambda v: np.append(np.bincount(col, v[row], d) * value, v.sum())
    return _descend(times, back, n, d, y, l2, rounds)
