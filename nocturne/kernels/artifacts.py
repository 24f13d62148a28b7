"""Artifacts of one channel: flat stretches, extreme samples, and bursts of high-frequency or broadband amplitude."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd

from .filters import analytic, cheby1_sos, sosfiltfilt


def flat_runs(x: np.ndarray, least: int, tolerance: float) -> np.ndarray:
    """Runs that grow while their values span at most the tolerance, of at least ``least`` samples; values that are not
    finite break runs."""
    out = np.zeros(len(x), bool)
    begin, lo, hi = 0, np.inf, -np.inf
    for i, v in enumerate([*x.tolist(), float("nan")]):
        if v == v and abs(v) != np.inf and max(hi, v) - min(lo, v) <= tolerance:
            lo, hi = min(lo, v), max(hi, v)
            continue
        if i - begin >= least:
            out[begin:i] = True
        fine = v == v and abs(v) != np.inf
        begin, lo, hi = (i, v, v) if fine else (i + 1, np.inf, -np.inf)
    return out


def moving(x: np.ndarray, width: int, how: str) -> np.ndarray:
    """Centred mean or median with shrinking ends; missing values are left out."""
    after = (width - 1) // 2
    wide = pd.Series(np.concatenate([x, np.full(after, np.nan)])).rolling(width, min_periods=1)
    return (wide.mean() if how == "mean" else wide.median()).to_numpy()[after:]


def fill(x: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Lines over bad samples between good neighbours, held at the ends; unchanged if all are bad."""
    good = np.flatnonzero(~bad)
    return np.interp(np.arange(len(x)), good, x[good]) if len(good) else x


def robust_outliers(y: np.ndarray, use: np.ndarray, crit: float) -> np.ndarray:
    """Samples over crit from the median, in mean absolute deviations about the mean, of those not flagged yet; again
    until none is new."""
    flagged = ~use | ~np.isfinite(y)
    out = np.zeros(len(y), bool)
    while not flagged.all():
        rest = y[~flagged]
        scale = np.abs(rest - rest.mean()).mean()
        if not scale > 0:
            break
        new = ~flagged & (np.abs(y - np.median(rest)) / scale > crit)
        if not new.any():
            break
        out |= new
        flagged |= new
    return out


def band_artifacts(x: np.ndarray, bad: np.ndarray, fs: float, cutoff: float, crit: float, smooth: float = 2.0, trend: float = 300.0) -> np.ndarray:
    """Outliers of the log envelope above a cutoff, less its moving median."""
    if cutoff >= fs / 2:
        return np.zeros(len(x), bool)
    amplitude = moving(np.abs(analytic(sosfiltfilt(cheby1_sos(4, 0.2, cutoff, fs, "highpass"), x))), max(1, round(smooth * fs)), "mean")
    y = np.full(len(x), np.nan)
    y[amplitude > 0] = np.log(amplitude[amplitude > 0])
    return robust_outliers(y - moving(y, max(1, round(trend * fs)), "median"), ~bad, crit)


def flat_tolerance_share() -> float:
    try:
        found = float(os.environ.get("NOCTURNE_FLAT_SHARE", ""))
    except ValueError:
        return 0.02
    return found if np.isfinite(found) and found >= 0 else 0.02


def detect(x: np.ndarray, fs: float, known: np.ndarray | None = None, high: float = 35.0, high_crit: float = 5.5, broad: float = 0.1, broad_crit: float = 5.5, flat_seconds: float = 1.0, flat_share: float | None = None, buffer_seconds: float = 0.0) -> np.ndarray:
    """Mask of artifacts: what is missing, flat or known, extreme noise, and both bands; widened by the buffer. flat_share: of
    the standard deviation, within which a stretch is flat; NOCTURNE_FLAT_SHARE in the environment, or 0.02."""
    flat_share = flat_tolerance_share() if flat_share is None else flat_share
    x = np.asarray(x, float)
    bad = ~np.isfinite(x)
    if bad.all():
        return bad
    tolerance = flat_share * x[~bad].std(ddof=1) if (~bad).sum() > 1 else 0.0
    bad |= flat_runs(x, max(1, round(flat_seconds * fs)), tolerance)
    if known is not None:
        bad |= known
    good = x[~bad]
    if len(good) > 1:
        with np.errstate(invalid="ignore"):
            bad |= (x <= good.mean() - 10 * good.std(ddof=1)) | (x >= good.mean() + 10 * good.std(ddof=1))
    clean = fill(np.where(np.isfinite(x), x, 0.0), bad)
    out = bad | band_artifacts(clean, bad, fs, high, high_crit) | band_artifacts(clean, bad, fs, broad, broad_crit)
    k = round(buffer_seconds * fs)
    if k:
        near = np.convolve(out, np.ones(2 * k + 1), "full")[k : k + len(out)]
        out = near > 0.5
    return out
