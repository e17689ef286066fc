"""Entropy and fractal dimension of epochs, vectorised over rows."""

from __future__ import annotations

import math

import numpy as np


def permutation_entropy(x: np.ndarray, order: int = 3, delay: int = 1) -> np.ndarray:
    """Normalised entropy of ordinal patterns of each row; 0 for too short rows."""
    n = x.shape[-1] - (order - 1) * delay
    if n < 1:
        return np.zeros(x.shape[0])
    parts = np.stack([x[:, i * delay : i * delay + n] for i in range(order)], -1)
    codes = (np.argsort(parts, -1, kind="stable") * order ** np.arange(order)).sum(-1)
    out = np.empty(len(x))
    for k, row in enumerate(codes):
        p = np.unique(row, return_counts=True)[1] / n
        out[k] = -(p * np.log2(p)).sum()
    return out / math.log2(math.factorial(order))


def higuchi(x: np.ndarray, longest: int = 10) -> np.ndarray:
    """Higuchi's fractal dimension of each row."""
    n = x.shape[-1]
    lengths = np.empty((longest, len(x)))
    for k in range(1, longest + 1):
        parts = []
        for m in range(k):
            line = x[:, m::k]
            steps = line.shape[1] - 1
            parts.append(np.abs(np.diff(line)).sum(1) * (n - 1) / max(steps, 1) / k / k)
        lengths[k - 1] = np.mean(parts, 0)
    t = np.log(1 / np.arange(1, longest + 1))
    tc = t - t.mean()
    y = np.log(np.maximum(lengths, 1e-300))
    return (tc[:, None] * (y - y.mean(0))).sum(0) / (tc**2).sum()


def petrosian(x: np.ndarray) -> np.ndarray:
    """Petrosian's fractal dimension of each row."""
    n = x.shape[-1]
    d = np.diff(x)
    turns = (d[:, 1:] * d[:, :-1] < 0).sum(1)
    return math.log10(n) / (math.log10(n) + np.log10(n / (n + 0.4 * turns)))


def hjorth(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mobility and complexity of each row; nan without variance."""
    d1 = np.diff(x)
    v0, v1, v2 = x.var(1), d1.var(1), np.diff(d1).var(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        mobility = np.sqrt(v1 / v0)
        return mobility, np.sqrt(v2 / v1) / mobility


def svd_entropy(x: np.ndarray, order: int = 3, delay: int = 1) -> np.ndarray:
    """Normalised entropy of the singular values of each row's delay embedding; nan without signal."""
    n = x.shape[-1] - (order - 1) * delay
    parts = np.stack([x[:, i * delay : i * delay + n] for i in range(order)], -1)
    w = np.linalg.svd(parts, compute_uv=False)
    with np.errstate(divide="ignore", invalid="ignore"):
        w = w / w.sum(-1, keepdims=True)
        return -np.where(w > 0, w * np.log2(w), 0.0 * w).sum(-1) / math.log2(order)


def sample_entropy(x: np.ndarray, order: int = 2, tolerance: float = 0.2) -> np.ndarray:
    """Minus log of the share of matches of ``order`` values that last one value longer; nan without any.

    Values match within ``tolerance`` SD (population). One lag at a time, so
    memory follows the row's length.
    """
    n = x.shape[-1]
    limit = tolerance * x.std(1, keepdims=True)
    short, long = np.zeros(len(x)), np.zeros(len(x))
    for lag in range(1, n - order):
        near = np.abs(x[:, lag:] - x[:, :-lag]) <= limit
        places = n - order - lag
        hit = np.ones((len(x), places), bool)
        for i in range(order):
            hit &= near[:, i : i + places]
        short += hit.sum(1)
        long += (hit & near[:, order : order + places]).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(long > 0, -np.log(long / short), np.nan)


def fluctuation_windows(n: int) -> list[int]:
    """Lengths from 4 samples to a tenth of the data (a quarter of short ones), a fifth longer each."""
    top, out = max(n // 10, n // 4 if n < 200 else 0), []
    size = 4.0
    while size <= top:
        if not out or int(size) != out[-1]:
            out.append(int(size))
        size *= 1.2
    return out


def detrended_fluctuation(x: np.ndarray) -> np.ndarray:
    """Exponent of each row's fluctuation about straight lines over window length; nan for rows too short or without variance."""
    y = np.cumsum(x - x.mean(1, keepdims=True), 1)
    sizes = fluctuation_windows(x.shape[-1])
    if len(sizes) < 2:
        return np.full(len(x), np.nan)
    levels = []
    for size in sizes:
        parts = y[:, : y.shape[1] // size * size].reshape(len(x), -1, size)
        t = np.arange(size) - (size - 1) / 2
        slope = (parts * t).sum(-1, keepdims=True) / (t**2).sum()
        rest = parts - parts.mean(-1, keepdims=True) - slope * t
        levels.append(np.sqrt((rest**2).mean((1, 2))))
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = np.log(sizes), np.log(np.stack(levels, 1))
        ac = a - a.mean()
        out = (ac * (b - b.mean(1, keepdims=True))).sum(1) / (ac**2).sum()
    return np.where(np.isfinite(out), out, np.nan)


def katz(x: np.ndarray) -> np.ndarray:
    """Katz's fractal dimension of each row; nan without change."""
    steps = np.abs(np.diff(x))
    length, reach = steps.sum(1), np.abs(x - x[:, :1]).max(1)
    n = math.log10(steps.shape[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(length > 0, n / (n + np.log10(reach / length)), np.nan)


def lempel_ziv(x: np.ndarray) -> np.ndarray:
    """Number of phrases (Lempel and Ziv 1976) of each row's values above their mean, over what a random row has."""
    out = np.empty(len(x))
    for k, row in enumerate(x):
        text = "".join("1" if v else "0" for v in row > row.mean())
        at, phrases = 0, 0
        while at < len(text):
            size = 1
            while at + size <= len(text) and text[at : at + size] in text[: at + size - 1]:
                size += 1
            phrases += 1
            at += size
        out[k] = phrases * math.log2(len(text)) / len(text)
    return out
