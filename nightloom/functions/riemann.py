"""Covariance matrices on their manifold: shrinkage, mean, distance, outlier scores."""

from __future__ import annotations

import numpy as np


def covariances(epochs: np.ndarray, shrinkage: float = 0.1) -> np.ndarray:
    """Covariance ``(n, channels, channels)`` of epochs ``(n, channels, samples)``, drawn to a multiple of the identity."""
    x = epochs - epochs.mean(-1, keepdims=True)
    c = x @ x.transpose(0, 2, 1) / (x.shape[-1] - 1)
    mean = np.trace(c, axis1=1, axis2=2) / c.shape[-1]
    return (1 - shrinkage) * c + shrinkage * mean[:, None, None] * np.eye(c.shape[-1])


def _apply(c: np.ndarray, f) -> np.ndarray:
    w, v = np.linalg.eigh(c)
    return (v * f(np.maximum(w, 1e-300))[..., None, :]) @ np.swapaxes(v, -1, -2)


def mean(c: np.ndarray, rounds: int = 50, tolerance: float = 1e-9) -> np.ndarray:
    """Riemannian mean by gradient descent."""
    m = c.mean(0)
    for _ in range(rounds):
        root, inverse = _apply(m, np.sqrt), _apply(m, lambda w: 1 / np.sqrt(w))
        step = _apply(inverse @ c @ inverse, np.log).mean(0)
        m = root @ _exp(step) @ root
        if np.linalg.norm(step) < tolerance:
            break
    return m


def _exp(s: np.ndarray) -> np.ndarray:
    w, v = np.linalg.eigh((s + s.T) / 2)
    return (v * np.exp(w)) @ v.T


def distance(c: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Affine-invariant distance of each matrix from ``m``."""
    inverse = _apply(m, lambda w: 1 / np.sqrt(w))
    w = np.linalg.eigvalsh(inverse @ c @ inverse)
    return np.sqrt((np.log(np.maximum(w, 1e-300)) ** 2).sum(-1))


def potato(c: np.ndarray, threshold: float = 3.0, rounds: int = 10) -> np.ndarray:
    """z of the log distance from the mean of the epochs that stay below ``threshold``, found in some rounds."""
    keep = np.ones(len(c), bool)
    z = np.zeros(len(c))
    for _ in range(rounds):
        d = np.log(np.maximum(distance(c, mean(c[keep])), 1e-300))
        z = (d - d[keep].mean()) / max(d[keep].std(), 1e-300)
        new = z < threshold
        if (new == keep).all() or new.sum() < 2:
            break
        keep = new
    return z
