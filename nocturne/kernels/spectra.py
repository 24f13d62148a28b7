"""Slepian tapers, multitaper spectrograms, event spectra, not-a-knot splines."""

from __future__ import annotations

import functools

import numpy as np


@functools.cache
def dpss(n: int, bandwidth: float, count: int) -> np.ndarray:
    """(count, n) tapers of unit norm for a time-half-bandwidth: the leading eigenvectors of the symmetric tridiagonal
    matrix that commutes with the concentration problem. Even tapers sum above 0, odd ones rise at the centre."""
    i = np.arange(n)
    diagonal = ((n - 1 - 2 * i) / 2) ** 2 * np.cos(2 * np.pi * bandwidth / n)
    side = i[1:] * (n - i[1:]) / 2
    _, v = np.linalg.eigh(np.diag(diagonal) + np.diag(side, 1) + np.diag(side, -1))
    out = v[:, ::-1][:, :count].T.copy()
    slope = (i - (n - 1) / 2) @ out.T
    sign = np.where(np.arange(count) % 2 == 0, out.sum(axis=1), slope)
    return out * np.where(sign < 0, -1, 1)[:, None]


def detrend(x: np.ndarray, how: str) -> np.ndarray:
    """Rows less their mean (constant) or their line (linear)."""
    if how == "off":
        return x
    x = x - x.mean(axis=1, keepdims=True)
    if how == "linear" and x.shape[1] > 1:
        t = np.arange(x.shape[1]) - (x.shape[1] - 1) / 2
        x = x - (x @ t)[:, None] / (t @ t) * t
    return x


def multitaper(x: np.ndarray, fs: float, window: float, step: float, bandwidth: float, tapers: int, nfft: int, how: str = "constant", band=(0.0, np.inf)):
    """(times, freqs, power (freqs, times)): one-sided power densities averaged over the tapers."""
    n, hop = round(window * fs), round(step * fs)
    if len(x) < n:
        return np.zeros(0), np.zeros(0), np.zeros((0, 0))
    w = dpss(n, bandwidth, tapers)
    f = np.fft.rfftfreq(nfft, 1 / fs)
    keep = (f >= band[0]) & (f <= band[1])
    rows = np.lib.stride_tricks.sliding_window_view(np.asarray(x, float), n)[::hop]
    out = np.empty((keep.sum(), len(rows)))
    for i in range(0, len(rows), 256):
        part = detrend(rows[i : i + 256], how)
        p = np.mean([np.abs(np.fft.rfft(part * t, nfft)) ** 2 for t in w], axis=0) / fs
        p[:, 1 : (nfft + 1) // 2] *= 2
        out[:, i : i + 256] = p[:, keep].T
    return np.arange(len(rows)) * hop / fs + n / 2 / fs, f[keep], out


def event_spectra(x: np.ndarray, fs: float, events: np.ndarray, window: float = 4.0, ds: float = 0.05, band=(0.0, 30.0), how: str = "constant", t0: float = 0.0):
    """(freqs, (events, freqs)): Hann spectra of windows around events; samples outside the recording are 0."""
    start = np.floor((np.asarray(events, float) - t0 - window / 2) * fs).astype(np.int64)
    return event_spectra_at(x, fs, start, round(window * fs), ds, band, how)


def event_spectra_at(x: np.ndarray, fs: float, start: np.ndarray, n: int, ds: float = 0.05, band=(0.0, 30.0), how: str = "constant"):
    """event_spectra() of the windows of n samples that begin at the samples ``start``."""
    at = start[:, None] + np.arange(n)[None, :]
    x = np.asarray(x, float) if len(x) else np.zeros(1)
    rows = np.where((at >= 0) & (at < len(x)), x[np.clip(at, 0, len(x) - 1)], 0.0)
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
    taper /= np.sqrt((taper**2).sum())
    nfft = max(n, 1 << max(0, int(np.ceil(np.log2(max(fs / ds, 1))))))
    p = np.abs(np.fft.rfft(detrend(rows, how) * taper, nfft)) ** 2 / fs
    p[:, 1 : (nfft + 1) // 2] *= 2
    f = np.fft.rfftfreq(nfft, 1 / fs)
    keep = (f >= band[0]) & (f <= band[1])
    return f[keep], p[:, keep]


def not_a_knot(x: np.ndarray, y: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cubic spline whose third derivative runs on at the second and the last but one point; a line through two points
    and a parabola through three. Beyond the ends the outer pieces run on."""
    x, y, q = (np.asarray(a, float) for a in (x, y, q))
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x, y, n - 1), q)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros((n, n))
    r = np.zeros(n)
    i = np.arange(1, n - 1)
    m[i, i - 1], m[i, i], m[i, i + 1], r[i] = h[1:], 2 * (h[1:] + h[:-1]), h[:-1], 3 * (h[1:] * d[:-1] + h[:-1] * d[1:])
    m[0, :2], r[0] = (h[1], h[0] + h[1]), ((h[0] + 2 * (h[0] + h[1])) * h[1] * d[0] + h[0] ** 2 * d[1]) / (h[0] + h[1])
    m[-1, -2:], r[-1] = (h[-1] + h[-2], h[-2]), (h[-1] ** 2 * d[-2] + (2 * (h[-1] + h[-2]) + h[-1]) * h[-2] * d[-1]) / (h[-1] + h[-2])
    s = np.linalg.solve(m, r)
    k = np.clip(np.searchsorted(x, q, "right") - 1, 0, n - 2)
    t = q - x[k]
    c2 = (3 * d[k] - 2 * s[k] - s[k + 1]) / h[k]
    c3 = (s[k] + s[k + 1] - 2 * d[k]) / h[k] ** 2
    return y[k] + t * (s[k] + t * (c2 + t * c3))


def refine(freqs: np.ndarray, power: np.ndarray, lo: float, hi: float, points: int = 1000, edge: float = 1e-3) -> float:
    """Frequency of the highest point of the spline over lo..hi; NaN at an edge or for an empty range."""
    if not hi > lo:
        return float("nan")
    grid = np.linspace(lo, hi, points)
    f = float(grid[np.argmax(not_a_knot(freqs, power, grid))])
    return float("nan") if f - lo <= edge or hi - f <= edge else f
