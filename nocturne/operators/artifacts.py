"""Artifact masks of channels, one Arrow group a channel: the filters run over whole recordings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.artifacts import detect


def artifact_mask(samples: DataFrame, by: list[str], t: str, value: str, fs: float, **options) -> DataFrame:
    """(by, t, artifact) for every sample; options are those of the kernel. Repeated times keep their rows."""

    def run(table):
        table = table.sort_by(t)
        mask = detect(table.column(value).to_numpy(), fs, **options)
        return table.drop_columns([value]).append_column("artifact", pa.array(mask))

    rows = samples.select(*by, F.col(t).cast("double").alias(t), F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias(value))
    kind = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema if x.name != value) + ", artifact boolean"
    return rows.groupBy(*by).applyInArrow(run, kind)
