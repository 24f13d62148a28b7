"""Bins that may overlap, on a line or a circle, and two-dimensional rates over them.

With bins of one width on a uniform grid, a value names its first and last bin by arithmetic, checked exactly at both
ends, and the numbers between are exploded: the range join needs no nested loop and the bins are never shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finite


@dataclass(frozen=True)
class Bins:
    """count bins [lo, hi) of one width; bin i (from 0) is centred at first + i * step. period: the circle's length."""

    first: float
    step: float
    width: float
    count: int
    period: float | None = None

    def low(self, i: Column) -> Column:
        return F.lit(self.first) + i * self.step - self.width / 2

    def rows(self, df: DataFrame, x: str, name: str) -> DataFrame:
        """A row of df for each bin that holds x. The first and the last bin follow from x by arithmetic, which rounding
        may put off by one; they are checked against the edges, those between them need no check."""
        reach, v = self.width / 2, F.col(x).cast("double")
        uniform = self.period is not None and math.isclose(self.count * self.step, self.period, rel_tol=1e-12) and self.width < self.period
        if self.period is not None and not uniform:
            raise ValueError("circular bins must lie evenly on the circle and be shorter than it")
        turn = (lambda i: F.floor(i / self.count)) if uniform else (lambda i: F.lit(0))
        own = (lambda i: i - turn(i) * self.count) if uniform else (lambda i: i)
        at = (lambda i: v - turn(i) * self.period) if uniform else (lambda i: v)
        holds = lambda i: (self.low(own(i)) <= at(i)) & (at(i) < self.low(own(i)) + self.width)
        lo, hi = F.floor((v - self.first - reach) / self.step), F.floor((v - self.first + reach) / self.step) + 1
        df = df.withColumns({"_lo": lo, "_hi": hi})
        lo, hi = F.col("_lo"), F.col("_hi")
        lo = F.when(holds(lo), lo).when(holds(lo + 1), lo + 1).otherwise(lo + 2)
        hi = F.when(holds(hi), hi).when(holds(hi - 1), hi - 1).otherwise(hi - 2)
        if not uniform:
            lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, F.lit(self.count - 1))
        df = df.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi")
        return df.withColumn(name, F.explode(F.sequence("_lo", "_hi"))).withColumn(name, F.pmod(F.col(name), F.lit(self.count)) if uniform else F.col(name)).drop("_lo", "_hi")


def bin_join(df: DataFrame, x: str, bins: Bins, name: str) -> DataFrame:
    """A row for each bin that holds x; rows without a bin, or without x, go."""
    return bins.rows(df.where(finite(F.col(x).cast("double")).isNotNull()), x, name)


def peak_histogram(peaks: DataFrame, samples: DataFrame, c_bins: Bins, f_bins: Bins, dt: float, least_minutes: float = 0.0, rate: bool = True) -> DataFrame:
    """peaks (c, f), samples (c, valid) -> c_bin, f_bin, n, minutes, value for the whole grid of cells.

    A peak counts in every cell it lies in. minutes: time the samples spend in the c bin; value: n / minutes, or n for
    counts and where there is no time; NULL for c bins under least_minutes."""
    spark = peaks.sparkSession
    grid = spark.range(c_bins.count).select(F.col("id").alias("c_bin")).crossJoin(F.broadcast(spark.range(f_bins.count).select(F.col("id").alias("f_bin"))))
    cells = bin_join(bin_join(peaks, "c", c_bins, "c_bin"), "f", f_bins, "f_bin").groupBy("c_bin", "f_bin").agg(F.count("*").alias("n"))
    time = bin_join(samples.where("valid"), "c", c_bins, "c_bin").groupBy("c_bin").agg((F.count("*") * dt / 60).alias("minutes"))
    out = grid.join(cells, ["c_bin", "f_bin"], "left").join(time, "c_bin", "left").select("c_bin", "f_bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("minutes", F.lit(0.0)).alias("minutes"))
    value = F.when(F.col("minutes") > 0, F.col("n") / F.col("minutes")).otherwise(F.col("n").cast("double")) if rate else F.col("n").cast("double")
    return out.withColumn("value", F.when(F.col("minutes") >= least_minutes, value))


STAGES = 5


@dataclass(frozen=True)
class Histogram:
    """cells (c_bin, f_bin, n, value), time (c_bin, stage, minutes, share) and peaks (f_bin, n)."""

    cells: DataFrame
    time: DataFrame
    peaks: DataFrame


def stage_histogram(peaks: DataFrame, samples: DataFrame, c_bins: Bins, f_bins: Bins, dt: float, rate: bool = True, least_minutes: float = 0.0, least_peaks: int = 0, norm: str | None = None) -> Histogram:
    """peaks (c, f), samples (c, stage, valid, valid_all) -> a histogram with the time by stage.

    minutes: time of the valid samples of stages 1 to 5 in a c bin; share: of the time of all samples that are valid in
    any stage. value: n over the minutes of all stages (rate) or n; NULL where these are under least_minutes (if rates or
    a least time are asked for) or the frequency has under least_peaks peaks, whatever their c. norm: "f_bin" or "c_bin",
    the bins over which the others sum to 1 then; NULL cells are left out of sums."""
    spark = peaks.sparkSession
    every = lambda n, c: spark.range(n).select(F.col("id").alias(c))
    grid = every(c_bins.count, "c_bin").crossJoin(F.broadcast(every(f_bins.count, "f_bin")))
    in_f = bin_join(peaks, "f", f_bins, "f_bin")
    at_freq = every(f_bins.count, "f_bin").join(in_f.groupBy("f_bin").agg(F.count("*").alias("n")), "f_bin", "left").select("f_bin", F.coalesce("n", F.lit(0)).alias("n"))
    cells = bin_join(in_f, "c", c_bins, "c_bin").groupBy("c_bin", "f_bin").agg(F.count("*").alias("n"))
    counted = lambda ok: F.count_if(F.coalesce(ok, F.lit(False)))
    spent = bin_join(samples, "c", c_bins, "c_bin").groupBy("c_bin").agg(counted(F.col("valid_all")).alias("whole"), *(counted(F.col("valid") & (F.col("stage") == k)).alias(f"s{k}") for k in range(1, STAGES + 1)))
    each = F.array(*(F.struct(F.lit(k).alias("stage"), (F.coalesce(F.col(f"s{k}"), F.lit(0)) * (dt / 60)).alias("minutes")) for k in range(1, STAGES + 1)))
    time = every(c_bins.count, "c_bin").join(spent, "c_bin", "left").select("c_bin", (F.col("whole") * (dt / 60)).alias("whole"), F.explode(each).alias("e"))
    time = time.select("c_bin", "e.stage", "e.minutes", F.when(F.col("whole") > 0, F.col("e.minutes") / F.col("whole")).otherwise(0.0).alias("share"))
    per_bin = time.groupBy("c_bin").agg(F.sum("minutes").alias("_m"))
    out = grid.join(cells, ["c_bin", "f_bin"], "left").join(per_bin, "c_bin").join(at_freq.withColumnRenamed("n", "_p"), "f_bin").withColumn("n", F.coalesce("n", F.lit(0)))
    value = F.when(F.col("_m") > 0, F.col("n") / F.col("_m")).otherwise(F.col("n").cast("double")) if rate else F.col("n").cast("double")
    timed = F.col("_m") >= least_minutes if rate or least_minutes > 0 else F.lit(True)
    out = out.withColumn("value", F.when(timed & ((F.col("_p") >= least_peaks) | F.lit(least_peaks <= 0)), value)).drop("_m", "_p")
    return Histogram(normalise(out, norm) if norm else out, time, at_freq)


def normalise(cells: DataFrame, dim: str, value: str = "value") -> DataFrame:
    """value divided by its sum over each value of dim; a sum of 0 divides by 1."""
    total = F.coalesce(F.sum(value).over(Window.partitionBy(dim)), F.lit(0.0))
    return cells.withColumn(value, F.col(value) / F.when(total == 0, 1.0).otherwise(total))
