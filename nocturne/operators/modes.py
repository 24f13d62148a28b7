"""Modes of two-dimensional histograms: regions around peaks of an image, and surfaces fitted to them.

A histogram is one image of bounded size, so each recording is one Arrow group.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import fits
from ..kernels import watershed as ws
from ..kernels.regions import trim


@dataclass(frozen=True)
class Axes:
    """First value and step of the context (rows) and of frequency (columns)."""

    c0: float
    dc: float
    f0: float
    df: float


@dataclass(frozen=True)
class Limits:
    """Least extents along context and frequency, least height, merge threshold, merges at most, volume kept, floor."""

    duration: float = 5.0
    bandwidth: float = 2.0
    height: float = 2.0
    threshold: float = 0.1
    most: float = math.inf
    keep: float = 0.95
    floor: float | None = None


COLUMNS = ("label", "height", "peak_freq", "context", "duration", "bandwidth")


def _boxes(label: np.ndarray, image: np.ndarray, finite: bool) -> dict[str, np.ndarray]:
    """Of each label, in order: box, least and greatest value and value-weighted middle; finite: only finite pixels."""
    r, c = np.nonzero((label > 0) & np.isfinite(image)) if finite else np.nonzero(label)
    names, of = np.unique(label[r, c], return_inverse=True)
    v = image[r, c]
    least = lambda x, best, fill: (lambda out: (best.at(out, of, x), out)[1])(np.full(len(names), fill))
    out = {"label": names, "r0": least(r, np.minimum, 1 << 60), "r1": least(r, np.maximum, -1), "c0": least(c, np.minimum, 1 << 60), "c1": least(c, np.maximum, -1)}
    seen = ~np.isnan(v)
    out["low"], out["high"] = least(np.where(seen, v, np.inf), np.minimum, np.inf), least(np.where(seen, v, -np.inf), np.maximum, -np.inf)
    total = np.bincount(of, np.nan_to_num(v), len(names))
    share = np.where(total == 0, 1.0, total)
    out["row"] = np.where(total == 0, (out["r0"] + out["r1"]) / 2, np.bincount(of, np.nan_to_num(v) * r, len(names)) / share)
    out["col"] = np.where(total == 0, (out["c0"] + out["c1"]) / 2, np.bincount(of, np.nan_to_num(v) * c, len(names)) / share)
    return out


def find_modes(image: np.ndarray, axes: Axes, limits: Limits = Limits()) -> tuple[np.ndarray, list[dict]]:
    """Labels, dense from 1, of the modes of an image (contexts by frequencies), and a row of COLUMNS for each.

    Watershed of the turned-over image, missing pixels out; regions with all that they have held are merged pairwise,
    those whose first and last pixels are no farther apart than the least extents go, the others are cut to the share
    ``keep`` of their volume, and go again by extents of whole pixels and by height."""
    none = np.zeros(image.shape, np.int64), []
    if min(image.shape) < 2:
        return none
    basins = ws.components((ws.watershed(np.where(np.isnan(image), 0.0, -image)) > 0) & ~np.isnan(image))
    label = ws.merge(basins, image, limits.threshold, limits.most, "every")
    box = _boxes(label, image, False)
    wide = ((box["r1"] - box["r0"]) * axes.dc > limits.duration) & ((box["c1"] - box["c0"]) * axes.df > limits.bandwidth)
    if max(limits.duration, limits.bandwidth) > 0:
        label = np.where(np.isin(label, box["label"][wide]), label, 0)
    if limits.keep < 1:
        label = trim(label, image, limits.keep, limits.floor)
    box = _boxes(label, image, False)
    height = np.where(np.isfinite(box["high"]) & np.isfinite(box["low"]), box["high"] - box["low"], 0.0)
    fine = ((box["r1"] - box["r0"] + 1) * axes.dc > limits.duration) & ((box["c1"] - box["c0"] + 1) * axes.df > limits.bandwidth) & (height > limits.height)
    kept = box["label"][fine]
    label = np.where(np.isin(label, kept), np.searchsorted(kept, label) + 1, 0)
    b = _boxes(label, image, True)
    rows = zip(b["label"].tolist(), (b["high"] - b["low"]).tolist(), (axes.f0 + b["col"] * axes.df).tolist(), (axes.c0 + b["row"] * axes.dc).tolist(), ((b["r1"] - b["r0"] + 1) * axes.dc).tolist(), ((b["c1"] - b["c0"] + 1) * axes.df).tolist(), strict=True)
    return label, [dict(zip(COLUMNS, r, strict=True)) for r in rows]


def find_phase_modes(image: np.ndarray, axes: Axes, limits: Limits = Limits(), sigma: tuple[float, float] = (5.0, 10.0)) -> tuple[np.ndarray, list[dict]]:
    """Modes on a circle of contexts whose first and last row are the same phase: the image is laid out three times, the
    doubled rows once, and smoothed; modes whose middle lies within -pi .. pi are kept, and labels of the middle period."""
    n = len(image)
    if n < 4 or image.shape[1] < 2:
        return np.zeros(image.shape, np.int64), []
    three = np.concatenate([image, image[1:-1], image])
    three = smooth(three, *sigma)
    label, rows = find_modes(three, Axes(axes.c0 - 2 * math.pi, axes.dc, axes.f0, axes.df), limits)
    middle = label[n - 1 : 2 * n - 1]
    names = np.unique(middle[middle > 0])
    return np.where(middle > 0, np.searchsorted(names, middle) + 1, 0), [r for r in rows if -math.pi <= r["context"] <= math.pi]


def smooth(image: np.ndarray, rows: float, columns: float) -> np.ndarray:
    """Gaussian smoothing of different reach along the two axes; missing pixels count as 0."""
    out = np.where(np.isfinite(image), image, 0.0)
    for axis, sigma in ((0, rows), (1, columns)):
        if sigma > 0:
            reach = int(np.ceil(2 * sigma))
            w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
            pad = [(reach, reach) if a == axis else (0, 0) for a in (0, 1)]
            out = np.lib.stride_tricks.sliding_window_view(np.pad(out, pad, mode="edge"), 2 * reach + 1, axis=axis) @ (w / w.sum())
    return out


def _image(table: pa.Table, value: str) -> np.ndarray:
    c, f = table.column("c_bin").to_numpy(), table.column("f_bin").to_numpy()
    out = np.full((int(c.max()) + 1, int(f.max()) + 1), np.nan)
    out[c, f] = table.column(value).to_numpy(zero_copy_only=False).astype(float)
    return out


def histogram_modes(cells: DataFrame, axes: Axes, limits: Limits = Limits(), rec: str = "rec", value: str = "value", circular: bool = False, sigma: tuple[float, float] = (5.0, 10.0)) -> DataFrame:
    """cells (rec, c_bin, f_bin, value), a row for each cell -> (rec, label, height, peak_freq, context, duration,
    bandwidth). Cells without a value, or without a row, are missing."""

    def run(table):
        image = _image(table, value)
        _, rows = find_phase_modes(image, axes, limits, sigma) if circular else find_modes(image, axes, limits)
        out = {c: pa.array([r[c] for r in rows], pa.int64() if c == "label" else pa.float64()) for c in COLUMNS}
        return pa.table({rec: pa.array([table.column(rec)[0].as_py()] * len(rows), table.schema.field(rec).type), **out})

    cells = cells.select(rec, F.col("c_bin").cast("long").alias("c_bin"), F.col("f_bin").cast("long").alias("f_bin"), value)
    kind = f"`{rec}` {cells.schema[rec].dataType.simpleString()}, label long, " + ", ".join(f"{c} double" for c in COLUMNS[1:])
    return cells.groupBy(rec).applyInArrow(run, kind)


PARAMETERS = ("amplitude", "frequency", "frequency_width", "context", "context_width", "tilt")


def fit_histogram(cells: DataFrame, axes: Axes, start, low, high, background=((0.0, 0.0, 0.0),) * 3, rec: str = "rec", value: str = "value", phase: bool = False, unit_row: bool = True, most: int = 0) -> DataFrame:
    """cells (rec, c_bin, f_bin, value) -> a row for each fitted mode: (rec, mode, PARAMETERS, sse, r2, adj_r2, rmse). start,
    low, high: a row of six for each mode, the same for all recordings."""

    def run(table):
        image = _image(table, value).T
        x, y = axes.c0 + axes.dc * np.arange(image.shape[1]), axes.f0 + axes.df * np.arange(image.shape[0])
        fit = fits.fit_surface(image, x, y, start, low, high, background, phase, unit_row, most)
        n = len(fit.modes)
        good = {k: pa.array([fit.goodness[k]] * n, pa.float64()) for k in ("sse", "r2", "adj_r2", "rmse")}
        return pa.table({rec: pa.array([table.column(rec)[0].as_py()] * n, table.schema.field(rec).type), "mode": pa.array(np.arange(1, n + 1)), **dict(zip(PARAMETERS, fit.modes.T, strict=True)), **good})

    cells = cells.select(rec, F.col("c_bin").cast("long").alias("c_bin"), F.col("f_bin").cast("long").alias("f_bin"), value)
    kind = f"`{rec}` {cells.schema[rec].dataType.simpleString()}, mode long, " + ", ".join(f"{c} double" for c in (*PARAMETERS, "sse", "r2", "adj_r2", "rmse"))
    return cells.groupBy(rec).applyInArrow(run, kind)


__all__ = ["Axes", "Limits", "find_modes", "find_phase_modes", "fit_histogram", "histogram_modes", "smooth"]
