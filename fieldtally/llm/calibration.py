"""Softmax and temperature calibration for small dense score tables."""

from __future__ import annotations

import numpy as np


def softmax(logits: np.ndarray) -> np.ndarray:
    shifted = np.exp(logits - logits.max(axis=1, keepdims=True))
    return shifted / shifted.sum(axis=1, keepdims=True)


def fit_temperature(logits: np.ndarray, labels: np.ndarray, low: float = 0.02, high: float = 20.0) -> float:
    """Temperature of least negative log-likelihood, by golden-section search on its logarithm; 1 without rows."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        chance = softmax(logits / np.exp(log_t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(chance, 1e-12)).mean())

    a, b, ratio = np.log(low), np.log(high), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))
