"""A linear support vector machine by dual coordinate descent, for bounded training samples."""

from __future__ import annotations

import numpy as np


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int, cost: np.ndarray, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of the hinge-loss model for sparse rows (index, value) and labels -1 or 1.

    Each step solves the dual problem of one row exactly and keeps its multiplier between 0 and that row's cost.
    """
    w, alpha = np.zeros(dims + 1), np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            gradient = y[i] * (w[at] @ v + w[-1]) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * v
                w[-1] += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def balanced_cost(y: np.ndarray, cost: float) -> np.ndarray:
    """A cost for each row so that both labels weigh the same."""
    share = np.maximum(np.array([(y < 0).mean(), (y > 0).mean()]), 1e-9)
    return cost * 0.5 / share[(y > 0).astype(int)]


def calibrate(margins: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the margins (smoothed targets, Newton steps)."""
    n1, n0 = int((y > 0).sum()), int((y < 0).sum())
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (t - p))
        beta += step
        if abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])
