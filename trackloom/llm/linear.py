"""Small numeric helpers that the classifiers share."""

from __future__ import annotations

import numpy as np


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights with the bias last, by Newton steps on the ridge-penalised, class-balanced log loss."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        slope = x.T @ (share * (p - y)) + penalty * w
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def shift(prior: float) -> float:
    """What a class-balanced model's bias lacks where class 1 has the share ``prior``, which is neither 0 nor 1."""
    return float(np.log(prior / (1 - prior)))
