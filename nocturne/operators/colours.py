"""Label images as colours, for looking at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the multiplier that spreads neighbouring ranks over the colours.
SPREAD = 2_654_435_761


def jet(t: Column, centre: float) -> Column:
    """One channel at t in 0..1: full within an eighth of its centre, none from three eighths on."""
    return F.round(F.least(F.greatest(1.5 - F.abs(4 * (t - centre)), F.lit(0.0)), F.lit(1.0)) * 255).cast("int")


def label_colours(pixels: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """pixels with red, green and blue: labels above 0, ranked and spread, along the jet scale; others are black."""
    names = pixels.where(F.col(label) > 0).select(*by, label).distinct()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(label)) - 1
    n = F.count("*").over(Window.partitionBy(*by))
    at = F.pmod(rank.cast("long") * SPREAD, n)
    names = names.withColumn("_t", F.when(n == 1, 0.5).otherwise(at / (n - 1)))
    out = pixels.join(names, [*by, label], "left")
    channel = lambda c: F.coalesce(jet(F.col("_t"), c), F.lit(0))
    return out.withColumns({"red": channel(0.75), "green": channel(0.5), "blue": channel(0.25)}).drop("_t")
