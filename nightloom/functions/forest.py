"""Isolation forest in NumPy: how few random cuts set a point apart."""

from __future__ import annotations

import math

import numpy as np


def _expected(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n``."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def scores(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 42) -> np.ndarray:
    """Anomaly score in (0, 1) of each row; above one half is an outlier."""
    rng = np.random.default_rng(seed)
    n = len(x)
    sample = min(sample, n)
    limit = math.ceil(math.log2(max(sample, 2)))
    depth = np.zeros(n)

    def descend(rows: np.ndarray, own: np.ndarray, level: int) -> None:
        """rows: of all data, own: of the tree's sample, both inside this cell."""
        spread = x[own].max(0) - x[own].min(0) if len(own) else np.zeros(x.shape[1])
        open_ = np.flatnonzero(spread > 0)
        if level >= limit or len(own) <= 1 or not len(open_):
            depth[rows] += level + _expected(len(own))
            return
        axis = rng.choice(open_)
        cut = rng.uniform(x[own, axis].min(), x[own, axis].max())
        left, mine = x[rows, axis] < cut, x[own, axis] < cut
        descend(rows[left], own[mine], level + 1)
        descend(rows[~left], own[~mine], level + 1)

    for _ in range(trees):
        descend(np.arange(n), rng.choice(n, sample, replace=False), 0)
    return 2.0 ** (-depth / trees / max(_expected(sample), 1e-12))


def inliers(x: np.ndarray, least: int = 50, seed: int = 42) -> np.ndarray:
    """Rows that aren't outliers; all of them below ``least`` rows."""
    if len(x) < least:
        return np.ones(len(x), bool)
    return scores(np.asarray(x, float), seed=seed) <= 0.5
