"""Ordered-frame operators on sample series. An even width W covers W/2 samples before and W/2 - 1 after."""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .asof import numbered


def centred(by: list[str], t: str, width: int) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(t).rowsBetween(-(width // 2), (width - 1) // 2)


def movmean(df: DataFrame, by: list[str], t: str, value: str, width: int, name: str) -> DataFrame:
    return df.withColumn(name, F.avg(value).over(centred(by, t, width)))


#: Frames up to this width are taken by the window aggregate, wider ones by a sorted list over stretches.
NARROW = 64


def movmedian(df: DataFrame, by: list[str], t: str, value: str, width: int, name: str) -> DataFrame:
    """Mean of the middle two of an even count; missing values are left out of the frame.

    A wide frame goes over stretches of a few frames with the samples that reach into them, one Arrow group each, with a
    sorted list that takes a sample in and one out at every step; t must not repeat within a key there."""
    if width <= NARROW:
        return df.withColumn(name, F.percentile(value, F.lit(0.5)).over(centred(by, t, width)))
    back, ahead, stretch = width // 2, (width - 1) // 2, max(4 * width, 50_000)
    rows = numbered(df.select(*by, t, F.col(value).cast("double").alias("_v")), by, t, "_i").withColumn("_i", F.col("_i").cast("long") - 1)
    first, last = F.floor((F.col("_i") - ahead) / stretch), F.floor((F.col("_i") + back) / stretch)
    rows = rows.withColumn("_s", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))

    def run(table):
        table = table.sort_by("_i")
        i, v = table.column("_i").to_numpy(), table.column("_v").to_numpy(zero_copy_only=False)
        own = table.column("_s")[0].as_py() == i // stretch
        out = moving_median(v, back, ahead)
        keep = table.append_column(name, pa.array(out, from_pandas=True)).filter(pa.array(own))
        return keep.drop_columns(["_v", "_i", "_s"])

    kind = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema if x.name not in ("_v", "_i", "_s")) + f", `{name}` double"
    found = rows.groupBy(*by, "_s").applyInArrow(run, kind)
    keys = [*by, t]
    names = {k: f"_k{j}" for j, k in enumerate(keys)}
    found, same = found.withColumnsRenamed(names), F.lit(True)
    for k, n in names.items():
        same = same & df[k].eqNullSafe(found[n])
    return df.join(found, same, "left").drop(*names.values())


def moving_median(v: np.ndarray, back: int, ahead: int) -> np.ndarray:
    """Medians of v[i - back .. i + ahead]; missing values are left out, a frame of none is missing."""
    held: list[float] = []
    out = np.full(len(v), np.nan)
    good = ~np.isnan(v)
    values, there = v.tolist(), good.tolist()
    for j in range(min(ahead, len(v))):
        if there[j]:
            insort(held, values[j])
    for i in range(len(values)):
        if i + ahead < len(values) and there[i + ahead]:
            insort(held, values[i + ahead])
        if i - back - 1 >= 0 and there[i - back - 1]:
            del held[bisect_left(held, values[i - back - 1])]
        n = len(held)
        if n:
            out[i] = held[n // 2] if n % 2 else (held[n // 2 - 1] + held[n // 2]) / 2
    return out


def dilate(df: DataFrame, by: list[str], t: str, flag: str, k: int, name: str) -> DataFrame:
    """True within k samples of a true one."""
    return df.withColumn(name, F.max(F.coalesce(F.col(flag), F.lit(False))).over(Window.partitionBy(*by).orderBy(t).rowsBetween(-k, k)))


def unwrap(df: DataFrame, by: list[str], t: str, value: str, name: str, discont: float = math.pi) -> DataFrame:
    """Phase without jumps: whole turns are added where neighbours differ by more than discont."""
    w = Window.partitionBy(*by).orderBy(t)
    turn = 2 * math.pi
    df = df.withColumn("_d", F.col(value) - F.lag(value).over(w))
    step = F.when(F.col("_d") > discont, -F.floor((F.col("_d") + math.pi) / turn) * turn).when(F.col("_d") < -discont, F.floor((-F.col("_d") + math.pi) / turn) * turn).otherwise(0.0)
    return df.withColumn("_step", step).withColumn(name, F.col(value) + F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d", "_step")


def flat_runs(df: DataFrame, by: list[str], t: str, value: str, least: int, name: str) -> DataFrame:
    """True in runs of at least ``least`` equal neighbours. Missing values break runs."""
    w = Window.partitionBy(*by).orderBy(t)
    change = F.when(F.col(value) == F.lag(value).over(w), 0).otherwise(1)
    df = df.withColumn("_c", change).withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn(name, F.col(value).isNotNull() & (F.count("*").over(Window.partitionBy(*by, "_run")) >= least)).drop("_c", "_run")


def average_rank(value: Column, w: WindowSpec, ties: WindowSpec) -> Column:
    """Rank with the mean rank for ties. w: the group in order of value; ties: the group and value."""
    return F.rank().over(w) + (F.count(value).over(ties) - 1) / 2.0
