"""Chebyshev filters as second-order sections, zero-phase filtering, the analytic signal."""

from __future__ import annotations

import numpy as np


def cheby1_sos(order: int, ripple_db: float, edges, fs: float, kind: str = "lowpass") -> np.ndarray:
    """Sections [b0 b1 b2 a0 a1 a2] of a type I Chebyshev filter; kind: lowpass, highpass or bandpass.

    Analogue prototype, frequency transform at prewarped edges, bilinear transform; conjugate roots are paired, sections
    run from the poles farthest from the unit circle to the nearest, the whole gain is in the first."""
    eps = np.sqrt(10 ** (ripple_db / 10) - 1)
    angle = np.pi * (2 * np.arange(1, order + 1) - 1) / (2 * order)
    mu = np.arcsinh(1 / eps) / order
    poles = -np.sinh(mu) * np.sin(angle) + 1j * np.cosh(mu) * np.cos(angle)
    gain = np.prod(-poles).real / (1.0 if order % 2 else np.sqrt(1 + eps**2))
    zeros = np.zeros(0, complex)
    warped = 2 * fs * np.tan(np.pi * np.atleast_1d(np.asarray(edges, float)) / fs)
    if kind == "lowpass":
        poles, gain = poles * warped[0], gain * warped[0] ** order
    elif kind == "highpass":
        gain *= (1 / np.prod(-poles)).real
        poles, zeros = warped[0] / poles, np.zeros(order, complex)
    elif kind == "bandpass":
        width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = poles * width / 2
        root = np.sqrt(half**2 - centre**2 + 0j)
        poles, zeros, gain = np.concatenate([half + root, half - root]), np.zeros(order, complex), gain * width**order
    else:
        raise ValueError(f"unknown kind {kind!r}")
    k = 2 * fs
    gain = gain * (np.prod(k - zeros) / np.prod(k - poles)).real
    digital = (k + poles) / (k - poles)
    digital_zeros = np.concatenate([(k + zeros) / (k - zeros), -np.ones(len(poles) - len(zeros))])
    upper = sorted((p for p in digital if p.imag > 1e-12), key=abs)
    real = sorted((p.real for p in digital if abs(p.imag) <= 1e-12), key=abs)
    pairs = [np.array([p, p.conjugate()]) for p in upper] + [np.array(real[i : i + 2], complex) for i in range(0, len(real), 2)]
    pairs.sort(key=lambda p: np.abs(p).max())
    # for bandpass each section takes a zero at 1 and one at -1
    left = sorted(digital_zeros.real)
    out = []
    for p in pairs:
        z = [left.pop(0), left.pop(-1)] if kind == "bandpass" and len(p) == 2 else [left.pop(0) for _ in range(len(p))]
        b, a = np.poly(z).real, np.poly(p).real
        out.append(np.concatenate([np.pad(b, (0, 3 - len(b))), np.pad(a, (0, 3 - len(a)))]))
    sos = np.array(out)
    sos[0, :3] *= gain
    return sos


def _section(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """One second-order section from a given state.

    The recursion runs over blocks: inside a block the state's part is a power of the 2 x 2 transition, taken from a
    table, and the input's part is a triangular convolution, so numpy does BLOCK samples at a time."""
    size = 256
    m = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    drive = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    power = np.empty((size + 1, 2, 2))
    power[0] = np.eye(2)
    for i in range(size):
        power[i + 1] = power[i] @ m
    response = np.concatenate([[b[0]], (power[: size - 1] @ drive)[:, 0]])
    lag = np.arange(size)[:, None] - np.arange(size)[None, :]
    kernel = np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)
    carry = power[:size, 0, :]
    into = power[size - 1 :: -1] @ drive
    y = np.empty(len(x))
    for i in range(0, len(x), size):
        part = x[i : i + size]
        n = len(part)
        y[i : i + n] = kernel[:n, :n] @ part + carry[:n] @ state
        state = power[n] @ state + (part[:, None] * into[size - n :]).sum(axis=0)
    return y


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """State of a section that has long had an input of 1."""
    gain = b.sum() / a.sum()
    return np.array([gain - b[0], b[2] - a[2] * gain])


def sosfiltfilt(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward through each section in turn, after odd reflection of three times the whole order at both
    ends; every section reflects anew and begins in the steady state of its first sample."""
    sos = np.asarray(sos, float)
    order = sum(2 if s[2] or s[5] else 1 for s in sos)
    y = np.asarray(x, float)
    if len(y) < 2:
        return y.copy()
    pad = min(max(1, 3 * order), len(y) - 1)
    for s in sos:
        b, a = s[:3] / s[3], s[3:] / s[3]
        zi = steady_state(b, a)
        wide = np.concatenate([2 * y[0] - y[pad:0:-1], y, 2 * y[-1] - y[-2 : -pad - 2 : -1]])
        for _ in range(2):
            wide = _section(b, a, wide, zi * wide[0])[::-1]
        y = wide[pad:-pad]
    return y


def analytic(x: np.ndarray) -> np.ndarray:
    """The signal with its negative frequencies taken out and the positive ones doubled."""
    n = len(x)
    f = np.fft.fft(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(f * h)
