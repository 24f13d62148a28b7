"""Samples as streams: levels per window of event time.

A whole recording's percentile baseline or its segment width is known only at its end, so what runs here is an
approximation for watching a recording while it comes in; the batch operators give the final figures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import finite


def window_levels(samples: DataFrame, ts: str, by: list[str], value: str, width: str = "30 seconds", late: str = "60 seconds") -> DataFrame:
    """(by, start, n, missing, mean, sd, lowest, highest) of each window of event time. Samples later than the watermark
    are dropped; windows close when it has passed them. Works on batches too. Missing values only count as such."""
    x = finite(F.col(value))
    out = samples.withWatermark(ts, late).groupBy(*by, F.window(ts, width)).agg(
        F.count("*").alias("n"), F.count_if(x.isNull()).alias("missing"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("lowest"), F.max(x).alias("highest")
    )
    return out.select(*by, F.col("window.start").alias("start"), "n", "missing", "mean", "sd", "lowest", "highest")
