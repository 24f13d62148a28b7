"""Hazen percentiles: rank h = q n + 1/2 within 1 and n, linear between order statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finite

ACCURACY = 2_000


def _on(df: DataFrame, small: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """df joined with a table of one row a group; null keys meet null keys."""
    if not by:
        return df.crossJoin(small)  # one row
    names = {k: f"_k{i}" for i, k in enumerate(by)}
    small = small.withColumnsRenamed(names)
    same = F.lit(True)
    for k, n in names.items():
        same = same & df[k].eqNullSafe(small[n])
    return df.join(small, same, how).drop(*names.values())


def hazen(df: DataFrame, by: list[str], value: str, q: float, name: str = "pct") -> DataFrame:
    """(by, name, n): the percentile of the finite values of each group; groups without any are left out.

    No group is sorted or gathered: a mergeable sketch brackets the rank (its error is at most one in ACCURACY of the
    group), values below the bracket are counted, equal values inside it, about a thousandth of the group, are counted on
    the map side, and only these counts are ordered. The result is exact."""
    rows = df.select(*by, finite(F.col(value).cast("double")).alias("_x")).where("_x IS NOT NULL")
    slack = 2.0 / ACCURACY
    near = F.percentile_approx("_x", F.array(F.lit(max(q - slack, 0.0)), F.lit(min(q + slack, 1.0))), ACCURACY)
    bracket = rows.groupBy(*by).agg(F.count("*").alias("n"), near.alias("_b"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
    few = F.col("n") < 4 * ACCURACY  # an error of one rank would count; these values are all ordered
    low = F.when(few | F.lit(q <= slack), F.col("_least")).otherwise(F.col("_b")[0])
    high = F.when(few | F.lit(q >= 1 - slack), F.col("_most")).otherwise(F.col("_b")[1])
    inside = _on(rows, bracket.select(*by, "n", low.alias("_lo"), high.alias("_hi")), by).where("_x <= _hi")
    counts = inside.groupBy(*by, F.when(F.col("_x") >= F.col("_lo"), F.col("_x")).alias("_x")).agg(F.count("*").alias("_k"), F.first("n").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.col("_x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_upto", F.sum("_k").over(w))
    h = F.least(F.greatest(F.lit(q) * F.col("n") + 0.5, F.lit(1.0)), F.col("n").cast("double"))
    reach = lambda r: F.min(F.when(F.col("_upto") >= r(F.col("_h")), F.col("_x")))
    out = counts.withColumn("_h", h).groupBy(*by).agg(reach(F.floor).alias("_l"), reach(F.ceil).alias("_u"), F.first("_h").alias("_h"), F.first("n").alias("n"))
    return out.select(*by, (F.col("_l") + (F.col("_h") - F.floor("_h")) * (F.col("_u") - F.col("_l"))).alias(name), "n")


def baseline(samples: DataFrame, by: list[str], value: str, q: float, valid: str, name: str = "pct") -> DataFrame:
    """(by, name, n) over the samples where ``valid`` holds, zeros dropped as missing. No valid sample at all raises
    ValueError."""
    good = samples.where(F.coalesce(F.col(valid), F.lit(False)))
    if good.limit(1).count() == 0:
        raise ValueError("no valid sample to take a baseline from")
    return hazen(good.where(F.col(value) != 0), by, value, q, name)


def divide_by(df: DataFrame, baseline: DataFrame, by: list[str], value: str, name: str, skip_unusable: bool) -> DataFrame:
    """df with name = value / baseline.pct. skip_unusable: a baseline of 0 or none leaves the value as it is (peak
    extraction); else it gives NULL (plain division)."""
    out = df.join(baseline.select(*by, F.col("pct").alias("_b")), by, "left")
    ratio = F.col(value) / F.when(F.col("_b") != 0, F.col("_b"))
    return out.withColumn(name, F.coalesce(ratio, F.col(value)) if skip_unusable else ratio).drop("_b")
