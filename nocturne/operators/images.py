"""Operators on label and value images: one Arrow group an image, whose pixels are rows (rec, f_idx, t_idx, ...)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import regions
from ..kernels import watershed as ws


def _fill(table: pa.Table, column: str, fill, kind) -> np.ndarray:
    f, t = table.column("f_idx").to_numpy(), table.column("t_idx").to_numpy()
    out = np.full((int(f.max()) + 1, int(t.max()) + 1), fill, kind)
    out[f, t] = table.column(column).to_numpy(zero_copy_only=False).astype(kind)
    return out


def _pixels(px: DataFrame, *columns: str) -> DataFrame:
    return px.select("rec", F.col("f_idx").cast("long").alias("f_idx"), F.col("t_idx").cast("long").alias("t_idx"), *columns)


def _whole(px: DataFrame, make, name: str, kind: str) -> DataFrame:
    """(rec, f_idx, t_idx, name) for every pixel of the image that make(table) gives."""
    arrow = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[kind]

    def run(table):
        image = make(table)
        f, t = (x.ravel() for x in np.indices(image.shape))
        rec = pa.array([table.column("rec")[0].as_py()] * image.size, table.schema.field("rec").type)
        return pa.table({"rec": rec, "f_idx": f, "t_idx": t, name: pa.array(image.ravel(), arrow)})

    return px.groupBy("rec").applyInArrow(run, f"rec {px.schema['rec'].dataType.simpleString()}, f_idx long, t_idx long, {name} {kind}")


def components(px: DataFrame, flag: str) -> DataFrame:
    """label: which 8-connected component of the true pixels a pixel is in, numbered down the columns; 0 for others."""
    return _whole(_pixels(px, flag), lambda t: ws.components(_fill(t, flag, False, bool)), "label", "long")


def minima(px: DataFrame, value: str) -> DataFrame:
    """minimum: pixels of plateaus without a lower neighbour; missing pixels are none."""
    return _whole(_pixels(px, value), lambda t: ws.minima(_fill(t, value, np.nan, float)), "minimum", "boolean")


def paint(px: DataFrame, label: str = "label") -> DataFrame:
    """label: regions numbered densely and grown by one pixel all round, later ones over earlier ones."""
    return _whole(_pixels(px, label), lambda t: ws.paint(_fill(t, label, 0, np.int64)), "label", "long")


def grow(px: DataFrame, steps: int, label: str = "label") -> DataFrame:
    """label: background within so many steps of a region joins it; of equals the least."""
    return _whole(_pixels(px, label), lambda t: regions.grow(_fill(t, label, 0, np.int64), steps), "label", "long")


def resize(px: DataFrame, rows: int, columns: int, label: str = "label") -> DataFrame:
    """label at another size, by the nearest pixel."""
    return _whole(_pixels(px, label), lambda t: regions.resize(_fill(t, label, 0, np.int64), (rows, columns)), "label", "long")


def trim(px: DataFrame, keep: float, floor: float | None = None, label: str = "label", value: str = "value") -> DataFrame:
    """label: each region cut to the share ``keep`` of its volume."""
    return _whole(_pixels(px, label, value), lambda t: regions.trim(_fill(t, label, 0, np.int64), _fill(t, value, np.nan, float), keep, floor), "label", "long")


def contours(px: DataFrame, label: str = "label") -> DataFrame:
    """contour: is a pixel on the outline of a region?"""
    return _whole(_pixels(px, label), lambda t: regions.contours(_fill(t, label, 0, np.int64)), "contour", "boolean")


def smooth(px: DataFrame, rows: float, columns: float, value: str = "value") -> DataFrame:
    """value: Gaussian smoothing along both axes, edges repeated."""
    from .modes import smooth as kernel

    return _whole(_pixels(px, value), lambda t: kernel(_fill(t, value, np.nan, float), rows, columns), "value", "double")


def adjacency(px: DataFrame, label: str = "label", value: str = "value") -> DataFrame:
    """(rec, a, b, weight): the edges of the regions' graph, a < b, by the merge's weights; regions near each other whose
    borders share no pixel have none."""

    def run(table):
        graph = ws.graph(_fill(table, label, 0, np.int64))
        v = _fill(table, value, np.nan, float).ravel(order="F")
        rows = [(a, b, ws.weight(graph[a], graph[b], v)) for a in sorted(graph) for b in sorted(graph[a].near) if a < b]
        rows = [r for r in rows if r[2] is not None]
        rec = pa.array([table.column("rec")[0].as_py()] * len(rows), table.schema.field("rec").type)
        return pa.table({"rec": rec, "a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64()), "weight": pa.array([r[2] for r in rows], pa.float64())})

    px = _pixels(px, label, value)
    return px.groupBy("rec").applyInArrow(run, f"rec {px.schema['rec'].dataType.simpleString()}, a long, b long, weight double")


def regions_of_graph(px: DataFrame, label: str = "label") -> DataFrame:
    """(rec, label, inside, border, near): pixels inside and on the border of each region, and how many are near it."""

    def run(table):
        graph = sorted(ws.graph(_fill(table, label, 0, np.int64)).items())
        rec = pa.array([table.column("rec")[0].as_py()] * len(graph), table.schema.field("rec").type)
        each = lambda f: pa.array([f(r) for _, r in graph], pa.int64())
        return pa.table({"rec": rec, "label": pa.array([k for k, _ in graph], pa.int64()), "inside": each(lambda r: len(r.inside)), "border": each(lambda r: len(r.border)), "near": each(lambda r: len(r.near))})

    px = _pixels(px, label)
    return px.groupBy("rec").applyInArrow(run, f"rec {px.schema['rec'].dataType.simpleString()}, label long, inside long, border long, near long")


def merge(px: DataFrame, threshold: float, view: str = "inside", label: str = "label", value: str = "value") -> DataFrame:
    """label: regions merged along edges above the threshold; view: see the kernel."""
    return _whole(_pixels(px, label, value), lambda t: ws.merge(_fill(t, label, 0, np.int64), _fill(t, value, np.nan, float), threshold, view=view), "label", "long")


__all__ = ["adjacency", "components", "contours", "grow", "merge", "minima", "paint", "regions_of_graph", "resize", "smooth", "trim"]
