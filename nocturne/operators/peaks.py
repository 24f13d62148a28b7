"""Peaks of spectrograms: segments of an image into labelled regions, and regions into a table.

A segment is one Arrow group of bounded width; segments of all recordings are dealt over the cluster by their key. The
kernel returns labelled pixels; properties, filters and numbering are ordinary aggregates and windows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import watershed as ws
from ..kernels.regions import contours, grow, resize, trim
from . import asof, series
from .quantile import _on, divide_by


def label_segments(px: DataFrame, rec: str = "rec", segment: str = "segment", threshold: float = 8.0, keep: float = 0.8, stride: tuple[int, int] = (1, 1), reach: int = 0, least: tuple[float, float] = (0.0, 0.0), steps: tuple[float, float] = (1.0, 1.0), most: float = math.inf, floor: float | None = None) -> DataFrame:
    """px (rec, segment, t_idx, f_idx, power) -> the pixels that belong to a region, with label.

    A segment is thinned to every stride[0]-th column and stride[1]-th row; the watershed of the turned-over image is
    merged, regions grow by one pixel all round, later ones over earlier ones, or with ``reach`` up to so many steps into
    the background; labels are brought back to full size, regions that span no more than least[0] seconds or least[1]
    hertz go, and each is cut to the share ``keep`` of its volume above ``floor`` (1: not cut). steps: seconds a column
    and hertz a row. Segments under 2 columns or rows, thinned or not, have no regions."""

    def run(table):
        t, f, v = (table.column(c).to_numpy() for c in ("t_idx", "f_idx", "power"))
        t0, f0 = t.min(), f.min()
        image = np.full((int(f.max() - f0) + 1, int(t.max() - t0) + 1), np.nan)
        image[f - f0, t - t0] = v
        label = regions_of(image, threshold, keep, stride, reach, least, steps, most, floor)[f - f0, t - t0]
        return table.append_column("label", pa.array(label.astype(np.int64))).filter(pa.array(label > 0))

    px = px.select(rec, segment, F.col("t_idx").cast("long").alias("t_idx"), F.col("f_idx").cast("long").alias("f_idx"), F.col("power").cast("double").alias("power"))
    kind = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in px.schema) + ", label long"
    return px.groupBy(rec, segment).applyInArrow(run, kind)


def regions_of(image: np.ndarray, threshold: float = 8.0, keep: float = 0.8, stride=(1, 1), reach: int = 0, least=(0.0, 0.0), steps=(1.0, 1.0), most: float = math.inf, floor: float | None = None) -> np.ndarray:
    """Label image of one segment (frequencies by times), numbered densely."""
    none = np.zeros(image.shape, np.int64)
    small = image[:: stride[1], :: stride[0]]
    if min(image.shape) < 2 or min(small.shape) < 2:
        return none
    label = ws.merge(ws.basins(-small), small, threshold, most)
    label = grow(label, reach) if reach else ws.paint(label)
    if small.shape != image.shape:
        label = resize(label, image.shape)
    if max(least) > 0:
        label = np.where(np.isin(label, wide_enough(label, least, steps)), label, 0)
    if keep < 1:
        label = trim(label, image, keep, floor)
    _, dense = np.unique(np.append(label.ravel(), 0), return_inverse=True)
    return dense[:-1].reshape(label.shape)


def wide_enough(label: np.ndarray, least, steps) -> list[int]:
    """Labels whose boxes span more than least[0] seconds and least[1] hertz."""
    f, t = np.nonzero(label)
    if not len(f):
        return []
    names, of = np.unique(label[f, t], return_inverse=True)

    def span(x):
        lo, hi = np.full(len(names), np.iinfo(np.int64).max), np.full(len(names), -1)
        np.minimum.at(lo, of, x)
        np.maximum.at(hi, of, x)
        return hi - lo + 1

    return names[(span(t) * steps[0] > least[0]) & (span(f) * steps[1] > least[1])].tolist()


def _measured(labels: DataFrame, dt: float, df: float, rec: str, segment: str, t0: float, f0: float) -> DataFrame:
    """One row a region, in one aggregate, so that the labels are found once."""
    out = series.regions(labels, [rec, segment, "label"], "t_idx", "f_idx", "power", dt, df, corner=True)
    return out.withColumns({"peak_time": F.col("peak_time") + t0, "peak_freq": F.col("peak_freq") + f0, "bbox_t": F.col("t_lo") * dt + t0, "bbox_f": F.col("f_lo") * df + f0}).drop("t_lo", "f_lo")


def _numbered(regions: DataFrame, rec: str, segment: str) -> DataFrame:
    return regions.withColumn("peak_id", F.row_number().over(Window.partitionBy(rec).orderBy(segment, "label")))


def peak_table(labels: DataFrame, dt: float, df: float, rec: str = "rec", segment: str = "segment", t0: float = 0.0, f0: float = 0.0) -> DataFrame:
    """One row a region, numbered through each recording by segment and label; t0, f0: time and frequency of pixel 0."""
    return _numbered(_measured(labels, dt, df, rec, segment, t0, f0), rec, segment)


@dataclass(frozen=True)
class Extraction:
    """peaks: one row a peak, numbered by peak_id from 1 in each recording; labels: the pixels of each, with peak_id."""

    peaks: DataFrame
    labels: DataFrame


def extract(px: DataFrame, dt: float, df: float, t0: float = 0.0, f0: float = 0.0, baseline: DataFrame | None = None, longest: int = 600, duration=(0.0, math.inf), bandwidth=(0.0, math.inf), frequency=(0.0, math.inf), least_db: float = -math.inf, **kernel) -> Extraction:
    """px (rec, t_idx, f_idx, power) -> its peaks.

    The power is divided by the baseline (rec, f_idx, pct) of its frequency where that can be done; each recording is
    dealt into the fewest even segments of at most ``longest`` columns, whose regions are found one Arrow group each and
    measured; peaks outside the ranges go, and the others are numbered by segment and label."""
    px = px.select("rec", "t_idx", "f_idx", F.col("power").cast("double").alias("power"))
    if baseline is not None:
        px = divide_by(px, baseline, ["rec", "f_idx"], "power", "power", True)
    whole = px.groupBy("rec").agg((F.max("t_idx") + 1).cast("double").alias("_n"))
    px = series.segments(_on(px, whole, ["rec"]), ["rec"], "t_idx", "_n", longest, "segment").drop("_n")
    labels = label_segments(px, least=(max(duration[0], 0.0), max(bandwidth[0], 0.0)), steps=(dt, df), **kernel)
    peaks = series.filter_peaks(_measured(labels, dt, df, "rec", "segment", t0, f0), duration, bandwidth, frequency, least_db)
    peaks = _numbered(peaks, "rec", "segment")
    return Extraction(peaks, labels.join(peaks.select("rec", "segment", "label", "peak_id"), ["rec", "segment", "label"]))


def mask_second_pass(px: DataFrame, labels: DataFrame) -> DataFrame:
    """px (rec, t, f_idx, power) of a second spectrogram, labels (rec, t, f_idx, t_idx, label) of the first pass, with a
    row for every column -> px with power kept where the nearest first column has a region at the frequency and not its
    outline, 0 elsewhere. Outlines are traced a recording's segment at a time."""

    def run(table):
        t, f, k = (table.column(c).to_numpy() for c in ("t_idx", "f_idx", "label"))
        image = np.zeros((int(f.max() - f.min()) + 1, int(t.max() - t.min()) + 1), np.int64)
        image[f - f.min(), t - t.min()] = k
        return table.filter(pa.array((k > 0) & ~contours(image)[f - f.min(), t - t.min()])).select(["rec", "t_idx", "f_idx"])

    rows = labels.select("rec", "segment", F.col("t_idx").cast("long").alias("t_idx"), F.col("f_idx").cast("long").alias("f_idx"), F.col("label").cast("long").alias("label"))
    kind = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.select("rec", "t_idx", "f_idx").schema)
    inside = rows.groupBy("rec", "segment").applyInArrow(run, kind).withColumnRenamed("t_idx", "_at").withColumn("_in", F.lit(True))
    columns = labels.select("rec", "t", F.col("t_idx").cast("double").alias("v")).distinct()
    near = asof.nearest(px.select("rec", "t").distinct(), columns, ["rec"], "_at").withColumn("_at", F.col("_at").cast("long"))
    out = px.join(near, ["rec", "t"]).join(inside, ["rec", "_at", "f_idx"], "left")
    return out.withColumn("power", F.when(F.col("_in"), F.col("power")).otherwise(0.0)).select(*px.columns)
