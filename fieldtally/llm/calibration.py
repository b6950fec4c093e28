"""Logistic calibration of a few measures, fitted on a bounded table on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Logistic:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    base: float

    def scores(self, measures: np.ndarray) -> np.ndarray:
        """Probability of label 1; rows without measures (NaN) get the share of label 1."""
        z = (measures - self.mean) / self.scale
        x = self.weights[0] + z @ self.weights[1:]
        p = 1 / (1 + np.exp(-np.clip(x, -60, 60)))
        return np.where(np.isnan(x), self.base, p)


def log_loss(y: np.ndarray, p: np.ndarray) -> float:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()) if len(y) else 0.0


def fit_logistic(measures: np.ndarray, y: np.ndarray, penalty: float = 0.1, rounds: int = 40) -> Logistic:
    """Penalised maximum likelihood by Newton steps on standardised measures."""
    k = measures.shape[1]
    if len(y) == 0:
        return Logistic(np.zeros(k + 1), np.zeros(k), np.ones(k), 0.5)
    mean, scale = measures.mean(axis=0), measures.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    x = np.column_stack([np.ones(len(y)), (measures - mean) / scale])
    w = np.zeros(k + 1)

    def loss(w: np.ndarray) -> float:
        z = np.clip(x @ w, -60, 60)
        return float((np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z).sum() + penalty / 2 * (w @ w))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        slope = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(k + 1), slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return Logistic(w, mean, scale, float((y.sum() + 0.5) / (len(y) + 1)))
