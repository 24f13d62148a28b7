"""As-of joins and interpolation of one series at the times of another.

Both series are put in one order by key and time; a window carries the last sample forward and, in the opposite order,
the next one back, each a running frame, so a key costs its length and not its square. A key is dealt into stretches of
``chunk`` seconds, so a recording with a third of all rows is many groups: what a stretch begins and ends with comes
from a table of one row a stretch. No range join and no broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finite

CHUNK = 3600.0
EXTRA = ("p_t", "p_v", "n_t", "n_v")


def _ends(rows: DataFrame, by: list[str], mark: str) -> DataFrame:
    """(by, _c, _before, _after): the last mark of the stretches before each stretch and the first of those after."""
    each = rows.groupBy(*by, "_c").agg(F.max(mark).alias("_last"), F.min(mark).alias("_first"))
    w = Window.partitionBy(*by)
    before = F.last("_last", True).over(w.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("_first", True).over(w.orderBy(F.col("_c").desc()).rowsBetween(Window.unboundedPreceding, -1))
    return each.select(*by, "_c", before.alias("_before"), after.alias("_after"))


def _same_key(df: DataFrame, ends: DataFrame, by: list[str]) -> DataFrame:
    keys = [*by, "_c"]
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    ends = ends.select(*(F.col(k).alias(n) for k, n in names.items()), "_before", "_after")
    same = F.lit(True)
    for k, n in names.items():
        same = same & df[k].eqNullSafe(ends[n])
    return df.join(ends, same, "left").drop(*names.values())


def neighbours(left: DataFrame, right: DataFrame, by: list[str], t: str = "t", value: str = "v", chunk: float = CHUNK) -> DataFrame:
    """left with p_t, p_v (last sample of right at or before t) and n_t, n_v (first at or after t)."""
    stretch = F.floor(F.col(t).cast("double") / chunk).alias("_c")
    rows = left.select(*by, stretch, F.col(t).cast("double").alias("_t"), F.lit(1).alias("_s"), F.struct(*left.columns).alias("_l"), F.lit(None).cast("struct<t:double,v:double>").alias("_r"))
    sample = F.struct(F.col(t).cast("double").alias("t"), F.col(value).cast("double").alias("v"))
    rows = rows.unionByName(right.where(F.col(t).isNotNull()).select(*by, stretch, F.col(t).cast("double").alias("_t"), F.lit(0).alias("_s"), F.lit(None).cast(rows.schema["_l"].dataType).alias("_l"), sample.alias("_r")))
    rows = _same_key(rows, _ends(rows, by, "_r"), by)
    w = Window.partitionBy(*by, "_c")
    rows = rows.withColumn("_p", F.last("_r", True).over(w.orderBy("_t", "_s").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_n", F.last("_r", True).over(w.orderBy(F.col("_t").desc(), F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, -1)))
    p, n = F.coalesce("_p", "_before"), F.coalesce("_n", "_after")
    rows = rows.where("_s = 1").select("_l.*", F.when(F.col("_t").isNotNull(), p).alias("_p"), F.when(F.col("_t").isNotNull(), F.when(p["t"] == F.col("_t"), p).otherwise(n)).alias("_n"))
    return rows.select(*left.columns, F.col("_p.t").alias("p_t"), F.col("_p.v").alias("p_v"), F.col("_n.t").alias("n_t"), F.col("_n.v").alias("n_v"))


def previous(left: DataFrame, right: DataFrame, by: list[str], name: str, fill=0.0, t: str = "t", value: str = "v", chunk: float = CHUNK) -> DataFrame:
    """The value that holds at t: that of the last sample. Before the first and after the last sample: fill."""
    df = neighbours(left, right, by, t, value, chunk)
    return df.withColumn(name, F.when(F.col("p_t").isNotNull() & F.col("n_t").isNotNull(), F.col("p_v")).otherwise(fill)).drop(*EXTRA)


def nearest(left: DataFrame, right: DataFrame, by: list[str], name: str, t: str = "t", value: str = "v", outside=None, chunk: float = CHUNK) -> DataFrame:
    """The value of the nearest sample; midway the later one; beyond the ends the end, or ``outside`` where given."""
    df = neighbours(left, right, by, t, value, chunk)
    later = F.col("p_t").isNull() | (F.col("n_t") - F.col(t) <= F.col(t) - F.col("p_t"))
    v = F.when(F.col("n_t").isNotNull() & later, F.col("n_v")).otherwise(F.col("p_v"))
    if outside is not None:
        v = F.when(F.col("p_t").isNull() | F.col("n_t").isNull(), F.lit(outside)).otherwise(v)
    return df.withColumn(name, v).drop(*EXTRA)


def nearest_index(left: DataFrame, right: DataFrame, by: list[str], name: str, t: str = "t", index: str = "i", chunk: float = CHUNK) -> DataFrame:
    """The index of the nearest sample of right, as nearest() picks it."""
    out = nearest(left, right.select(*by, t, F.col(index).cast("double").alias(index)), by, name, t, index, chunk=chunk)
    return out.withColumn(name, F.col(name).cast("long"))


def _between(t: str):
    share = (F.col(t) - F.col("p_t")) / F.when(F.col("n_t") > F.col("p_t"), F.col("n_t") - F.col("p_t"))
    return F.when(F.col("p_t") == F.col(t), F.col("p_v")).otherwise(F.col("p_v") + share * (F.col("n_v") - F.col("p_v")))


def linear(left: DataFrame, right: DataFrame, by: list[str], name: str, t: str = "t", value: str = "v", chunk: float = CHUNK) -> DataFrame:
    """Linear between samples, flat beyond the ends; 0 without samples."""
    df = neighbours(left, right, by, t, value, chunk)
    v = F.when(F.col("p_t").isNull(), F.coalesce("n_v", F.lit(0.0))).when(F.col("n_t").isNull(), F.col("p_v")).otherwise(_between(t))
    return df.withColumn(name, v).drop(*EXTRA)


def linear_padded(left: DataFrame, right: DataFrame, by: list[str], name: str, t: str = "t", value: str = "v", chunk: float = CHUNK) -> DataFrame:
    """Linear between samples; within one first step beyond an end the end's value, farther NULL. A sample is met
    exactly even beside a missing one; a missing neighbour, or time, gives NULL."""
    first = right.groupBy(*by).agg(F.min(t).alias("_t0"))
    second = right.join(first, by).where(F.col(t) > F.col("_t0")).groupBy(*by).agg((F.min(t) - F.first("_t0")).alias("_step"))
    clean = right.withColumn(value, F.coalesce(finite(F.col(value)), F.lit(float("nan"))))
    df = neighbours(left, clean, by, t, value, chunk).join(second, by, "left")
    q = finite(F.col(t))
    v = F.when(F.col("p_t").isNull(), F.when(F.col("n_t") - q <= F.col("_step"), F.col("n_v")))
    v = v.when(F.col("n_t").isNull(), F.when(q - F.col("p_t") <= F.col("_step"), F.col("p_v"))).otherwise(_between(t))
    return df.withColumn(name, F.when(q.isNotNull(), finite(v))).drop(*EXTRA, "_step")


def numbered(df: DataFrame, by: list[str], t: str, name: str, chunk: float = CHUNK) -> DataFrame:
    """df with name: number of the row in its key in order of t, from 1, counted by stretches."""
    df = df.withColumn("_c", F.floor(F.col(t).cast("double") / chunk))
    each = df.groupBy(*by, "_c").agg(F.count("*").alias("_k"))
    base = F.coalesce(F.sum("_k").over(Window.partitionBy(*by).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = _same_key(df, each.select(*by, "_c", base.alias("_before"), F.lit(None).alias("_after")), by)
    w = Window.partitionBy(*by, "_c").orderBy(t)
    return df.withColumn(name, F.row_number().over(w) + F.col("_before")).drop("_before", "_after", "_c")


def fill_gaps(df: DataFrame, by: list[str], t: str, value: str, bad: str, name: str, chunk: float = CHUNK) -> DataFrame:
    """value, where bad is true replaced by the line between the good neighbours in order of t, held at the ends.
    The line runs over sample numbers, not times."""
    df = numbered(df, by, t, "_i", chunk).withColumn("_c", F.floor(F.col(t).cast("double") / chunk))
    df = df.withColumn("_g", F.when(~F.col(bad), F.struct(F.col("_i").alias("i"), F.col(value).alias("v"))))
    df = _same_key(df, _ends(df, by, "_g"), by)
    w = Window.partitionBy(*by, "_c")
    df = df.withColumn("_p", F.coalesce(F.last("_g", True).over(w.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)), F.col("_before")))
    df = df.withColumn("_n", F.coalesce(F.last("_g", True).over(w.orderBy(F.col("_i").desc()).rowsBetween(Window.unboundedPreceding, 0)), F.col("_after")))
    line = F.col("_p.v") + (F.col("_i") - F.col("_p.i")) / F.when(F.col("_n.i") > F.col("_p.i"), F.col("_n.i") - F.col("_p.i")) * (F.col("_n.v") - F.col("_p.v"))
    return df.withColumn(name, F.when(~F.col(bad), F.col(value)).otherwise(F.coalesce(line, F.col("_p.v"), F.col("_n.v")))).drop("_i", "_p", "_n", "_g", "_c", "_before", "_after")
