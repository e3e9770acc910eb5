"""Linear hinge-loss models fitted by dual coordinate descent, and their calibration."""

from __future__ import annotations

import numpy as np


def fit_rows(starts: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray, size: int, cost: np.ndarray | float = 1.0, epochs: int = 15, seed: int = 7, tolerance: float = 1e-2) -> np.ndarray:
    """Weights w minimising |w|^2 / 2 + sum cost_i max(0, 1 - y_i w.x_i), y in {-1, 1}.

    Rows are sparse: row i has value[starts[i]:starts[i + 1]] at index[...].  One dual variable is solved
    exactly at a time, in random order; it ends when no projected gradient exceeds the tolerance.
    """
    rng, w = np.random.default_rng(seed), np.zeros(size)
    cost = np.broadcast_to(np.asarray(cost, float), len(y))
    rows = [(index[a:b], value[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    q = np.array([v @ v for _, v in rows])
    alpha = np.zeros(len(y))
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(np.flatnonzero(q > 0)):
            at, v = rows[i]
            g = y[i] * (v @ w[at]) - 1
            pg = min(g, 0) if alpha[i] == 0 else max(g, 0) if alpha[i] == cost[i] else g
            worst = max(worst, abs(pg))
            if pg:
                new = min(max(alpha[i] - g / q[i], 0.0), cost[i])
                w[at] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
        if worst < tolerance:
            break
    return w


def fit_dense(x: np.ndarray, y: np.ndarray, cost: np.ndarray | float = 1.0, **more) -> np.ndarray:
    n, d = x.shape
    return fit_rows(np.arange(n + 1) * d, np.tile(np.arange(d), n), np.ascontiguousarray(x).ravel(), y, d, cost, **more)


def calibrate(margin: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(a, b) of P(y = 1) = 1 / (1 + exp(-(a m + b))), by Newton steps with smoothed targets."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0 if not len(y) else (4.0 if y[0] else -4.0)
    up, down = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    centre, width = float(margin.mean()), float(margin.std()) or 1.0
    m = (margin - centre) / width
    a, b = 1.0, float(np.log((up + 1) / (down + 1)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -35, 35)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([d @ m + 1e-3 * a, d.sum()])
        hessian = np.array([[(h * m) @ m + 1e-3, h @ m], [h @ m, h.sum() + 1e-9]])
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
    a = max(a, 1e-3) / width
    return a, b - a * centre


def probability(margin: np.ndarray, ab: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(ab[0] * margin + ab[1], -40, 40)))
