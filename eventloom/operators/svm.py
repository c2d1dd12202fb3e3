"""A support-vector machine with a Gaussian kernel and probabilities, for tables that fit the driver (a row per column of training tables).

The dual is solved by moving weight within the pair that violates the optimality conditions most; rows of the kernel are
worked out when needed.  Probabilities come from a sigmoid fitted to decision values of held-out folds.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KERNEL_ROWS = 512
FOLDS = 5
TOLERANCE = 1e-3


@dataclass(frozen=True)
class SupportVectors:
    """Support vectors with their signed weights; decision ``sum(w * exp(-gamma * d^2)) + offset``, probability ``1 / (1 + exp(slope * decision + shift))``."""

    vectors: list[list[float]]
    weights: list[float]
    offset: float
    gamma: float
    slope: float = -1.0
    shift: float = 0.0

    def decide(self, x: np.ndarray) -> np.ndarray:
        if not self.vectors:
            return np.full(len(x), self.offset)
        v = np.array(self.vectors)
        apart = (x * x).sum(axis=1)[:, None] + (v * v).sum(axis=1) - 2 * x @ v.T
        return np.exp(-self.gamma * np.maximum(apart, 0)) @ np.array(self.weights) + self.offset

    def probability(self, inputs: Column) -> Column:
        """Probability of the positive class for arrays of inputs; in Python, since there can be many vectors."""

        @F.pandas_udf("double")
        def score(xs: pd.Series) -> pd.Series:
            decided = self.decide(np.array(xs.tolist(), float).reshape(len(xs), -1))
            return pd.Series(1 / (1 + np.exp(np.clip(self.slope * decided + self.shift, -500, 500))))

        return score(inputs)

    def described(self) -> dict:
        return asdict(self)


def _solve(x: np.ndarray, y: np.ndarray, cost: float, gamma: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights (0 to ``cost``) of the rows and the offset; ``y`` is 1 or -1."""
    squares = (x * x).sum(axis=1)
    kernel = lru_cache(maxsize=KERNEL_ROWS)(lambda i: np.exp(-gamma * np.maximum(squares + squares[i] - 2 * (x @ x[i]), 0)))
    alpha, gradient = np.zeros(len(x)), -np.ones(len(x))
    for _ in range(rounds):
        pull = -y * gradient
        up = np.where((y > 0) & (alpha < cost) | (y < 0) & (alpha > 0), pull, -np.inf)
        low = np.where((y > 0) & (alpha > 0) | (y < 0) & (alpha < cost), pull, np.inf)
        i, j = int(up.argmax()), int(low.argmin())
        if up[i] - low[j] < TOLERANCE:
            break
        # along this direction the weights stay balanced; the step ends at the optimum or at a bound
        step = (up[i] - low[j]) / max(2 - 2 * kernel(i)[j], 1e-12)
        step = min(step, cost - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else cost - alpha[j])
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        gradient += step * y * (kernel(i) - kernel(j))
    pull = -y * gradient
    free = (alpha > 1e-9) & (alpha < cost - 1e-9)
    if free.any():
        return alpha, float(pull[free].mean())
    up = pull[(y > 0) & (alpha < cost) | (y < 0) & (alpha > 0)]
    low = pull[(y > 0) & (alpha > 0) | (y < 0) & (alpha < cost)]
    return alpha, float((up.max(initial=-1) + low.min(initial=1)) / 2)


def _sigmoid(decided: np.ndarray, positive: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift that make the labels likely, with labels drawn in a little by their numbers."""
    n, p = (~positive).sum(), positive.sum()
    target = np.where(positive, (p + 1) / (p + 2), 1 / (n + 2))
    slope, shift = 0.0, float(np.log((n + 1) / (p + 1)))

    def loss(a: float, b: float) -> float:
        z = a * decided + b
        return float((np.logaddexp(0, -z) + (target) * z).sum())

    for _ in range(rounds):
        q = 1 / (1 + np.exp(np.clip(slope * decided + shift, -500, 500)))
        slopes = np.array([(decided * (target - q)).sum(), (target - q).sum()])
        w = np.maximum(q * (1 - q), 1e-12)
        curve = np.array([[(w * decided * decided).sum() + 1e-12, (w * decided).sum()], [(w * decided).sum(), w.sum() + 1e-12]])
        step, size, before = np.linalg.solve(curve, slopes), 1.0, loss(slope, shift)
        while size > 1e-10 and loss(slope - size * step[0], shift - size * step[1]) > before:
            size /= 2
        slope, shift = slope - size * step[0], shift - size * step[1]
        if np.abs(size * step).max() < 1e-8:
            break
    return float(slope), float(shift)


def fit(x: np.ndarray, positive: np.ndarray, cost: float = 1.0, gamma: float | None = None, seed: int = 42, rounds: int = 100_000) -> SupportVectors:
    """The machine for rows ``x``, of which ``positive`` are; ``gamma`` is by default one over features times their variance."""
    gamma = gamma or 1.0 / (x.shape[1] * (x.var() or 1.0))

    def machine(rows: np.ndarray) -> SupportVectors:
        own, y = x[rows], np.where(positive[rows], 1.0, -1.0)
        if len(set(y.tolist())) < 2:
            return SupportVectors([], [], float(y[0]) if len(y) else 0.0, gamma)
        alpha, offset = _solve(own, y, cost, gamma, rounds)
        held = alpha > 1e-12
        return SupportVectors(own[held].tolist(), (alpha * y)[held].tolist(), offset, gamma)

    everything = np.arange(len(x))
    whole = machine(everything)
    fold = np.random.default_rng(seed).permutation(len(x)) % FOLDS
    decided = np.zeros(len(x))
    for k in range(min(FOLDS, len(x))):
        decided[fold == k] = machine(everything[fold != k]).decide(x[fold == k])
    slope, shift = _sigmoid(decided, positive)
    return SupportVectors(whole.vectors, whole.weights, whole.offset, gamma, slope, shift)
