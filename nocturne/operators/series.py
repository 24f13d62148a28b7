"""Aggregates over sample series: outliers, spectra's slopes, band power, goodness of fit, segments, trims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finite, pow2db
from .quantile import _on


def outlier_noise(df: DataFrame, by: list[str], value: str, bad: str, name: str, sigmas: float = 10.0) -> DataFrame:
    """name: value at or beyond mean +- sigmas * standard deviation of the key's good samples."""
    good = finite(F.when(~F.col(bad), F.col(value)))
    df = _on(df, df.groupBy(*by).agg(F.avg(good).alias("_m"), F.stddev_samp(good).alias("_s")), by)
    x = finite(F.col(value))
    out = (x <= F.col("_m") - sigmas * F.col("_s")) | (x >= F.col("_m") + sigmas * F.col("_s"))
    return df.withColumn(name, F.coalesce(out, F.lit(False))).drop("_m", "_s")


def slope(df: DataFrame, by: list[str], freq: str, power: str) -> DataFrame:
    """(by, slope, bad): regression of ln power on ln freq; a power that is missing or not above 0 spoils the window."""
    p = finite(F.col(power))
    spoiled = F.bool_or(F.coalesce(p <= 0, F.lit(True)))
    fit = F.regr_slope(F.log(F.when(p > 0, p)), F.log(F.when(F.col(freq) > 0, F.col(freq))))
    return df.groupBy(*by).agg(fit.alias("slope"), spoiled.alias("bad")).select(*by, F.when(~F.col("bad"), F.col("slope")).alias("slope"), "bad")


def band_power(spect: DataFrame, power: str, lo: int, hi: int, df: float, name: str) -> DataFrame:
    """Sum of the finite values of array positions lo..hi times df; NULL if there are none."""
    part = F.filter(F.slice(power, lo + 1, hi - lo + 1), lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return spect.withColumn(name, F.when(F.size(part) > 0, F.aggregate(part, F.lit(0.0), lambda a, x: a + x) * df))


def stride(spect: DataFrame, index: str, power: str, every_t: int, every_f: int) -> DataFrame:
    """Every every_t-th column and, in it, every every_f-th value."""
    return spect.where(F.col(index) % every_t == 0).withColumn(power, F.filter(power, lambda x, i: i % every_f == 0))


def goodness(df: DataFrame, by: list[str], y: str, fit: str, parameters: int) -> DataFrame:
    """(by, n, sse, r2, adj_r2, rmse) over the cells where both are finite."""
    rows = df.select(*by, finite(F.col(y)).alias("_y"), finite(F.col(fit)).alias("_f")).where("_y IS NOT NULL AND _f IS NOT NULL")
    r = F.col("_y") - F.col("_f")
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(r * r).alias("sse"), (F.var_pop("_y") * F.count("*")).alias("_t"))
    rest = F.when(F.col("n") > parameters, F.col("n") - parameters)
    r2 = 1 - F.col("sse") / F.when(F.col("_t") > 0, F.col("_t"))
    return out.select(*by, "n", "sse", r2.alias("r2"), (1 - (1 - r2) * (F.col("n") - 1) / rest).alias("adj_r2"), F.sqrt(F.col("sse") / rest).alias("rmse"))


def segments(df: DataFrame, by: list[str], index: str, total: str, longest: int, name: str) -> DataFrame:
    """Segment numbers from 1: total columns are dealt into the fewest segments of at most ``longest``, of even width."""
    width = F.ceil(F.col(total) / F.ceil(F.col(total) / F.lit(float(longest))))
    return df.withColumn(name, (F.floor(F.col(index) / width) + 1).cast("int"))


def regional_minima(px: DataFrame, by: list[str], row: str, col: str, value: str) -> DataFrame:
    """Pixels strictly below all of their eight neighbours (images without plateaus): each pixel is sent to its
    neighbours' places, so it is one shuffle and no join."""
    here = px.select(*by, row, col, F.col(value).alias("_v"), F.lit(True).alias("_own"))
    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j))
    sent = px.withColumn("_d", F.explode(near)).select(*by, (F.col(row) + F.col("_d.i")).alias(row), (F.col(col) + F.col("_d.j")).alias(col), F.col(value).alias("_v"), F.lit(False).alias("_own"))
    g = here.unionByName(sent).groupBy(*by, row, col).agg(F.max(F.when(F.col("_own"), F.col("_v"))).alias(value), F.min(F.when(~F.col("_own"), F.col("_v"))).alias("_near"))
    return g.where((F.col(value) < F.col("_near")) | F.col(value).isNotNull() & F.col("_near").isNull()).drop("_near")


def regions(px: DataFrame, by: list[str], t: str, f: str, value: str, dt: float, df: float, corner: bool = False) -> DataFrame:
    """Properties of labelled regions, one row each: weighted centroid, box, duration, bandwidth, area, volume, height,
    peakiness (NULL for one pixel or a flat region); with ``corner``, t_lo and f_lo, where the box begins."""
    v = F.col(value)
    out = px.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(v).alias("_s"), F.sum(v * F.col(t)).alias("_st"), F.sum(v * F.col(f)).alias("_sf"),
        F.min(t).alias("t_lo"), F.max(t).alias("t_hi"), F.min(f).alias("f_lo"), F.max(f).alias("f_hi"), F.min(v).alias("_lo"), F.max(v).alias("_hi"),
    )
    centre = lambda s, lo: F.when(F.col("_s") > 0, F.col(s) / F.col("_s")).otherwise(F.col(lo))
    peaky = F.col("n") / F.when(F.col("n") > 1, F.col("n") - 1) * (F.col("_hi") - F.col("_s") / F.col("n")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return out.select(
        *by, "n", (centre("_st", "t_lo") * dt).alias("peak_time"), (centre("_sf", "f_lo") * df).alias("peak_freq"), ((F.col("t_hi") - F.col("t_lo") + 1) * dt).alias("duration"), ((F.col("f_hi") - F.col("f_lo") + 1) * df).alias("bandwidth"),
        (F.col("n") * dt * df).alias("area"), (F.col("_s") * dt * df).alias("volume"), (F.col("_hi") - F.col("_lo")).alias("height"), peaky.alias("peakiness"),
        *(("t_lo", "f_lo") if corner else ()),
    )


def in_stages(stage: str, wanted) -> Column:
    """Is the stage one of those? A missing stage is none."""
    return F.coalesce(F.col(stage).isin(*wanted), F.lit(False))


def filter_peaks(peaks: DataFrame, duration=(0.0, float("inf")), bandwidth=(0.0, float("inf")), frequency=(0.0, float("inf")), least_db: float = float("-inf")) -> DataFrame:
    """Peaks strictly inside all ranges whose height is above 0 and above least_db decibels."""
    inside = lambda c, r: (F.col(c) > r[0]) & (F.col(c) < r[1])
    db = pow2db(F.col("height"))
    return peaks.where(inside("duration", duration) & inside("bandwidth", bandwidth) & inside("peak_freq", frequency) & F.coalesce(finite(db) > least_db, F.lit(False)))


def renumber(df: DataFrame, by: list[str], old: str, name: str) -> DataFrame:
    """Dense numbers from 1 in the order of old."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(old)))


def extent_cut(px: DataFrame, by: list[str], t: str, f: str, steps: tuple[float, float], least: tuple[float, float]) -> DataFrame:
    """(by, wide, apart): is a region's box more than the least extents, counted in whole pixels (wide), or from its first
    to its last pixel (apart)?"""
    out = px.groupBy(*by).agg((F.max(t) - F.min(t)).alias("_t"), (F.max(f) - F.min(f)).alias("_f"))
    more = lambda k: ((F.col("_t") + k) * steps[0] > least[0]) & ((F.col("_f") + k) * steps[1] > least[1])
    return out.select(*by, more(1).alias("wide"), more(0).alias("apart"))


def trim_level(px: DataFrame, by: list[str], value: str, keep: float) -> DataFrame:
    """(by, level): the value at which the ascending running volume above the region's minimum first exceeds
    (1 - keep) of all; constant regions have no level."""
    px = _on(px, px.groupBy(*by).agg(F.min(value).alias("_least")), by).withColumn("_v", F.col(value) - F.col("_least"))
    each = px.groupBy(*by, value, "_v").agg(F.sum("_v").alias("_part"))
    each = _on(each, px.groupBy(*by).agg(F.sum("_v").alias("_all")), by)
    run = F.sum("_part").over(Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    return each.withColumn("_run", run).where((F.col("_all") > 0) & (F.col("_run") > (1 - keep) * F.col("_all"))).groupBy(*by).agg(F.min(value).alias("level"))
