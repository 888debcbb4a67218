"""Sparse multinomial logistic regression trained by follow-the-regularised-leader (FTRL-proximal)
with an elastic net, and temperature calibration of its probabilities."""

from __future__ import annotations

import numpy as np


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class FTRL:
    """``classes`` x ``dim`` weights; a bias column is kept at index ``dim`` and is not penalised."""

    def __init__(self, classes: int, dim: int, *, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2, self.dim = alpha, beta, l1, l2, dim
        self.z = np.zeros((dim + 1, classes))
        self.n = np.zeros((dim + 1, classes))

    def _weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == self.dim, 0.0, self.l1)[:, None]
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, idx: np.ndarray, val: np.ndarray, label: int, weight: float = 1.0) -> None:
        """One example; ``idx`` must hold no index twice."""
        at, x = np.append(idx, self.dim), np.append(val, 1.0)
        w = self._weights(at)
        p = softmax(x @ w)
        p[label] -= 1.0
        g = weight * x[:, None] * p[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, epochs: int = 2, weights: np.ndarray | None = None, seed: int = 7) -> "FTRL":
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                self.step(*rows[i], int(labels[i]), 1.0 if weights is None else float(weights[labels[i]]))
        return self

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """(dim x classes weights, bias)."""
        w = self._weights(np.arange(self.dim + 1))
        return w[:-1], w[-1]


def logits(rows: list[tuple[np.ndarray, np.ndarray]], w: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.array([v @ w[i] + bias for i, v in rows]).reshape(-1, len(bias))


def temperature(z: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood; 1 where there is nothing to fit it on."""
    if not len(z):
        return 1.0

    def loss(t):
        return -np.log(np.maximum(softmax(z / t)[np.arange(len(z)), labels], 1e-12)).mean()

    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 61))
    k = int(np.argmin([loss(t) for t in grid]))
    lo, hi = grid[max(0, k - 1)], grid[min(60, k + 1)]
    fine = np.linspace(lo, hi, 41)
    return float(fine[int(np.argmin([loss(t) for t in fine]))])
