"""A factorisation machine for two classes."""

from __future__ import annotations

import numpy as np


class FactorisationMachine:
    """bias + w.x + sum over pairs of <v_i, v_j> x_i x_j, by the sum-of-squares identity."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """Linear time: half of (sum of v x) squared less the sum of (v x) squared, over factors."""
        mixed = rows @ self.factors
        pairs = 0.5 * (mixed**2 - rows**2 @ self.factors**2).sum(1)
        return self.bias + rows @ self.weights + pairs

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows), -30, 30)))

    @classmethod
    def fitted(
        cls, rows: np.ndarray, marks: np.ndarray, rank: int = 6, steps: int = 1_500, batch: int = 128, seed: int = 3
    ) -> FactorisationMachine:
        """Adaptive gradient steps on the logistic loss over shuffled batches."""
        random = np.random.default_rng(seed)
        width = rows.shape[1]
        share = min(max(marks.mean() if len(marks) else 0.5, 1e-3), 1 - 1e-3)
        made = cls(float(np.log(share / (1 - share))), np.zeros(width), random.normal(0, 0.02, (width, rank)))
        rate, decay = 0.1, 1e-5
        past = [1e-3, np.full(width, 1e-3), np.full((width, rank), 1e-3)]
        if not 0 < marks.sum() < len(marks):
            return cls(made.bias, made.weights, np.zeros((width, rank)))
        order = random.permutation(len(rows))
        for step in range(steps):
            at = step * batch % len(rows)
            if at < batch:
                order = random.permutation(len(rows))
            x, y = rows[order[at : at + batch]], marks[order[at : at + batch]]
            slope = (made.scores(x) - y) / len(x)
            mixed = x @ made.factors
            grads = [
                slope.sum(),
                x.T @ slope + decay * made.weights,
                x.T @ (slope[:, None] * mixed) - made.factors * (x**2).T.dot(slope)[:, None] + decay * made.factors,
            ]
            for i, grad in enumerate(grads):
                past[i] = past[i] + grad**2
            made.bias -= rate * grads[0] / np.sqrt(past[0])
            made.weights -= rate * grads[1] / np.sqrt(past[1])
            made.factors -= rate * grads[2] / np.sqrt(past[2])
        return made
