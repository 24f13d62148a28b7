"""Tensor-product B-spline fits of a surface by separable least squares."""

from __future__ import annotations

import numpy as np


def knots(inner: np.ndarray, order: int) -> np.ndarray:
    """Distinct break points with the first and last repeated to the order."""
    inner = np.unique(np.asarray(inner, float))
    return np.concatenate([np.repeat(inner[0], order - 1), inner, np.repeat(inner[-1], order - 1)])


def basis(x: np.ndarray, t: np.ndarray, order: int) -> np.ndarray:
    """(len(x), len(t) - order) values of the B-splines; the right end belongs to the last span, outside all are 0."""
    x, t = np.asarray(x, float), np.asarray(t, float)
    span = np.clip(np.searchsorted(t, x, "right") - 1, order - 1, len(t) - order - 1)
    out = np.zeros((len(x), len(t) - 1))
    inside = (x >= t[0]) & (x <= t[-1])
    out[np.flatnonzero(inside), span[inside]] = 1
    for k in range(2, order + 1):
        a, b = t[k - 1 : -1] - t[: -k], t[k:] - t[1 : len(t) - k + 1]
        n = len(t) - k
        left = np.divide(x[:, None] - t[None, :n], a[None, :n], out=np.zeros((len(x), n)), where=a[None, :n] > 0)
        right = np.divide(t[None, k : k + n] - x[:, None], b[None, :n], out=np.zeros((len(x), n)), where=b[None, :n] > 0)
        out = left * out[:, :n] + right * out[:, 1 : n + 1]
    return out


def fit_surface(z: np.ndarray, x: np.ndarray, y: np.ndarray, knots_x: np.ndarray, knots_y: np.ndarray, orders=(4, 3)):
    """(coefficients, fitted surface) for z of shape (len(x), len(y))."""
    bx, by = basis(x, knots(knots_x, orders[0]), orders[0]), basis(y, knots(knots_y, orders[1]), orders[1])
    half = np.linalg.solve(bx.T @ bx, bx.T @ np.asarray(z, float))
    c = np.linalg.solve(by.T @ by, by.T @ half.T).T
    return c, bx @ c @ by.T
