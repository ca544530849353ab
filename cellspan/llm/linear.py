"""Logistic regression for the small fits that run on the driver, on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def minimise(loss, w: np.ndarray, steps: int = 30, memory: int = 8, near: float = 3e-3) -> np.ndarray:
    """The minimum of a smooth convex ``loss(w) -> (value, gradient)`` by L-BFGS with halved steps, from ``w``.

    It ends when five steps together have taken less than ``near`` of the first loss away.
    """
    value, gradient = loss(w)
    values, moves, turns = [value], [], []
    for _ in range(steps):
        if not gradient.any() or len(values) > 5 and values[-6] - value <= near * abs(values[0]):
            break
        way, parts = gradient.copy(), []
        for s, y in zip(reversed(moves), reversed(turns), strict=True):
            parts.append((s @ way) / (y @ s))
            way -= parts[-1] * y
        way *= (moves[-1] @ turns[-1]) / (turns[-1] @ turns[-1]) if moves else 1 / max(1.0, np.abs(gradient).sum())
        for s, y, part in zip(moves, turns, reversed(parts), strict=True):
            way += s * (part - (y @ way) / (y @ s))
        length, slope = 1.0, float(gradient @ way)
        while True:
            there = w - length * way
            value_there, gradient_there = loss(there)
            if value_there <= value - 1e-4 * length * slope or length < 1e-6:
                break
            length /= 2
        s, y = there - w, gradient_there - gradient
        if s @ y > 1e-12:
            moves, turns = [*moves, s][-memory:], [*turns, y][-memory:]
        w, value, gradient = there, value_there, gradient_there
        values.append(value)
    return w


def fit_descent(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 200, rate: float = 0.1) -> np.ndarray:
    """Weights (the intercept last) for soft labels and many columns, by Adam over all rows."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    w, m, v = np.zeros(x.shape[1], x.dtype), np.zeros(x.shape[1], x.dtype), np.zeros(x.shape[1], x.dtype)
    for t in range(1, steps + 1):
        g = x.T @ (sigmoid(x @ w) - y).astype(x.dtype) / len(x)
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w
