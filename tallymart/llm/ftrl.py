"""Logistic regression over sparse features by follow-the-regularised-leader updates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Rates:
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.1


class FTRL:
    """Per-coordinate FTRL-proximal; the last coordinate is the bias."""

    def __init__(self, size: int, rates: Rates = Rates()):
        self.rates = rates
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        r, z = self.rates, self.z[at]
        scale = (r.beta + np.sqrt(self.n[at])) / r.alpha + r.l2
        return np.where(np.abs(z) <= r.l1, 0.0, (np.sign(z) * r.l1 - z) / scale)

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        """One update; ``at`` are distinct coordinates."""
        w = self.weights(at)
        p = probability(float(w @ values))
        gradient = (p - label) * values
        squared = gradient * gradient
        sigma = (np.sqrt(self.n[at] + squared) - np.sqrt(self.n[at])) / self.rates.alpha
        self.z[at] += gradient - sigma * w
        self.n[at] += squared


def probability(margin: float) -> float:
    return 1.0 / (1.0 + np.exp(-min(max(margin, -35.0), 35.0)))


def example(indices: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct coordinates with values, the bias last: counts over the root of their sum."""
    at, counts = np.unique(indices, return_counts=True)
    values = counts / np.sqrt(max(len(indices), 1))
    return np.append(at, size), np.append(values, 1.0)


def margin(weights: np.ndarray, indices: np.ndarray) -> float:
    """The dot product of weights and the values of :func:`example`, without sorting the indices."""
    return float(weights[indices].sum() / np.sqrt(max(len(indices), 1)) + weights[-1])
