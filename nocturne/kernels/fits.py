"""Bounded least squares and the two surfaces that histograms are described by.

A surface is a sum of modes of six parameters each (amplitude, mean frequency, frequency width, mean of the second axis,
its width, tilt) over a background of three. Images have a row a frequency; cells that are not finite are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Default bounds (low, high) of frequency width, second width and tilt of a mode.
POWER_SHAPE = ((0.1 / math.sqrt(2), 2.5 / math.sqrt(2)), (2.5 / math.sqrt(2), 30.0 / math.sqrt(2)), (-0.03, 0.03))
PHASE_SHAPE = ((1.0 / math.sqrt(2), math.sqrt(7.5)), (math.pi / 5, 2 * math.pi), (-math.pi / 3, math.pi / 3))


def bounded_least_squares(residuals, start: np.ndarray, low: np.ndarray, high: np.ndarray, most: int = 0, jacobian=None, tolerance: float = 1e-10) -> tuple[np.ndarray, int]:
    """Parameters within bounds of least squared residuals, and how often these were taken (``most`` times at most; 0: 100
    times the number of parameters).

    Levenberg-Marquardt on the free parameters: those at a bound that the gradient pushes outward are held. Steps are
    scaled by the columns' norms and cut at the bounds; the damping follows the share of the promised gain that a step
    makes (Nielsen, 1999)."""
    low, high = np.asarray(low, float), np.asarray(high, float)
    x = np.clip(np.asarray(start, float), low, high)
    if not len(x) == len(low) == len(high):
        raise ValueError("start and bounds differ in length")
    if (low > high).any():
        raise ValueError("a lower bound is above its upper bound")
    most = most or 100 * len(x)

    def slopes(x, r):
        if jacobian is not None:
            return jacobian(x)
        out = np.empty((len(r), len(x)))
        for i in range(len(x)):
            h = 1.5e-8 * max(1.0, abs(x[i]))
            h = -h if x[i] + h > high[i] else h
            y = x.copy()
            y[i] += h
            out[:, i] = (residuals(y) - r) / h
        return out

    r, taken, damp, grow = residuals(x), 1, 1e-3, 2.0
    cost = r @ r
    while taken < most:
        j = slopes(x, r)
        g = j.T @ r
        free = ~((x <= low) & (g > 0) | (x >= high) & (g < 0)) & (low < high)
        if not free.any() or np.abs(g[free]).max() <= tolerance * max(cost, 1e-300):
            break
        a = j[:, free].T @ j[:, free]
        scale = np.maximum(np.diag(a), 1e-300)
        while taken < most:
            step = np.zeros(len(x))
            step[free] = -np.linalg.lstsq(a + np.diag(damp * scale), g[free], rcond=None)[0]
            y = np.clip(x + step, low, high)
            move = y - x
            new = residuals(y)
            taken += 1
            gain = cost - new @ new
            promised = -2 * g @ move - np.sum((j @ move) ** 2)
            if gain > 0:
                damp, grow = damp * max(1 / 3, 1 - (2 * gain / max(promised, 1e-300) - 1) ** 3 if promised > 0 else 1 / 3), 2.0
                done = gain <= tolerance * cost and np.abs(move).max() <= tolerance**0.5 * (1 + np.abs(x).max())
                x, r, cost = y, new, new @ new
                if done:
                    return x, taken
                break
            damp, grow = damp * grow, grow * 2
            if damp > 1e12 or np.abs(move).max() <= 1e-14 * (1 + np.abs(x).max()):
                return x, taken
    return x, taken


def rotated_gaussians(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Modes tilted in the plane, over a plane b0 x + b1 y + b2; p: parameter by parameter, then the background."""
    modes, b = p[:-3].reshape(6, -1), p[-3:]
    dy, dx = y[:, None, None] - modes[1], x[None, :, None] - modes[3]
    s, c = np.sin(modes[5]), np.cos(modes[5])
    u, w = (dy * c + dx * s) / modes[2], (dx * c - dy * s) / modes[4]
    return (modes[0] * np.exp(-0.5 * (u * u + w * w))).sum(axis=2) + b[0] * x[None, :] + b[1] * y[:, None] + b[2]


def rotated_gaussians_slopes(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Derivatives of rotated_gaussians() by its parameters: (frequencies, places, parameters)."""
    modes, n = p[:-3].reshape(6, -1), (len(p) - 3) // 6
    dy, dx = y[:, None, None] - modes[1], x[None, :, None] - modes[3]
    s, c = np.sin(modes[5]), np.cos(modes[5])
    u, w = (dy * c + dx * s) / modes[2], (dx * c - dy * s) / modes[4]
    e = np.exp(-0.5 * (u * u + w * w))
    ae = modes[0] * e
    out = np.empty((len(y), len(x), len(p)))
    out[..., :n] = e
    out[..., n : 2 * n] = ae * (u * c / modes[2] - w * s / modes[4])
    out[..., 2 * n : 3 * n] = ae * u * u / modes[2]
    out[..., 3 * n : 4 * n] = ae * (u * s / modes[2] + w * c / modes[4])
    out[..., 4 * n : 5 * n] = ae * w * w / modes[4]
    out[..., 5 * n : 6 * n] = ae * u * w * (modes[2] / modes[4] - modes[4] / modes[2])
    out[..., -3] = x[None, :]
    out[..., -2] = y[:, None]
    out[..., -1] = 1.0
    return out


def von_mises_gaussians(p: np.ndarray, x: np.ndarray, y: np.ndarray, unit_row: bool = True) -> np.ndarray:
    """Modes that are von Mises along the phase x, shifted with frequency, and Gaussian along y, over b0 sin(x + b1) + b2;
    unit_row: each frequency's sum is 1."""
    modes, b = p[:-3].reshape(6, -1), p[-3:]
    dy, dx = y[:, None, None] - modes[1], x[None, :, None] - modes[3]
    bell = np.exp(-0.5 * (dy / modes[2]) ** 2) * np.exp((np.cos(dx + dy * np.sin(modes[5])) - 1) / modes[4] ** 2)
    z = (modes[0] * bell).sum(axis=2) + b[0] * np.sin(x + b[1])[None, :] + b[2]
    total = z.sum(axis=1, keepdims=True)
    return z / np.where(total == 0, 1.0, total) if unit_row else z


@dataclass(frozen=True)
class Fit:
    """modes (mode, parameter), background, the surface, goodness (sse, r2, dfe, adj_r2, rmse) and residual evaluations."""

    modes: np.ndarray
    background: np.ndarray
    surface: np.ndarray
    goodness: dict[str, float]
    taken: int


def goodness(y: np.ndarray, fit: np.ndarray, parameters: int) -> dict[str, float]:
    sse, total, n = float(((y - fit) ** 2).sum()), float(((y - y.mean()) ** 2).sum()) if len(y) else 0.0, len(y)
    dfe = n - parameters
    r2 = 1 - sse / total if total > 0 else math.nan
    return {"sse": sse, "r2": r2, "dfe": dfe, "adj_r2": 1 - (1 - r2) * (n - 1) / dfe if dfe > 0 else math.nan, "rmse": math.sqrt(sse / dfe) if dfe > 0 else math.nan}


def fit_surface(image: np.ndarray, x: np.ndarray, y: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, background=((0.0, 0.0, 0.0),) * 3, phase: bool = False, unit_row: bool = True, most: int = 0) -> Fit:
    """start, low, high: (modes, 6); background: start, low and high of its three. phase: von Mises modes."""
    image, x, y = (np.asarray(v, float) for v in (image, x, y))
    start, low, high = (np.asarray(v, float) for v in (start, low, high))
    if image.shape != (len(y), len(x)):
        raise ValueError(f"image of {image.shape} for {len(y)} frequencies and {len(x)} places")
    if not start.shape == low.shape == high.shape or start.shape[1:] != (6,):
        raise ValueError("start, low and high need the same modes of six parameters")
    ok = np.isfinite(image)
    lay = lambda m, b: np.concatenate([m.T.ravel(), b])
    model = (lambda p: von_mises_gaussians(p, x, y, unit_row)) if phase else (lambda p: rotated_gaussians(p, x, y))
    slopes = None if phase else (lambda p: rotated_gaussians_slopes(p, x, y)[ok])
    p, taken = bounded_least_squares(lambda p: (model(p) - image)[ok], *(lay(m, np.asarray(b, float)) for m, b in zip((start, low, high), background, strict=True)), most, slopes)
    surface = model(p)
    return Fit(p[:-3].reshape(6, -1).T, p[-3:], surface, goodness(image[ok], surface[ok], len(p)), taken)
