"""Rank tests and false-discovery-rate control."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import finite
from ..kernels.permutation import permutation_test
from ..kernels.tests_of_rank import erfc
from ..kernels.tests_of_rank import ranksum_p as exact_ranksum
from ..kernels.tests_of_rank import signrank_p as exact_signrank
from .quantile import _on
from .windows import average_rank


def rank_sums(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """Per bin, for groups 1 and 2: n1, n2, w (rank sum of group 1), ties (sum of t^3 - t), u, z (normal approximation
    with tie correction and a continuity of 1/2 toward 0; NULL if the variance is 0) and exact (n1 + n2 < 20)."""
    x = df.select(*by, F.col(group).alias("_g"), finite(F.col(value)).alias("_v")).where("_v IS NOT NULL")
    w, ties = Window.partitionBy(*by).orderBy("_v"), Window.partitionBy(*by, "_v")
    x = x.withColumn("_r", average_rank(F.col("_v"), w, ties)).withColumn("_t", F.count("*").over(ties))
    n1, n2 = F.count_if(F.col("_g") == 1), F.count_if(F.col("_g") == 2)
    x = x.groupBy(*by).agg(n1.alias("n1"), n2.alias("n2"), F.sum(F.when(F.col("_g") == 1, F.col("_r"))).alias("w"), F.sum(F.col("_t") * F.col("_t") - 1.0).alias("ties"))
    x = x.where("n1 > 0 AND n2 > 0").withColumn("_n", (F.col("n1") + F.col("n2")).cast("double"))
    mean, u = F.col("n1") * (F.col("_n") + 1) / 2, F.col("w") - F.col("n1") * (F.col("n1") + 1) / 2
    var = F.col("n1") * F.col("n2") / 12.0 * (F.col("_n") + 1 - F.col("ties") / (F.col("_n") * F.greatest(F.col("_n") - 1, F.lit(1.0))))
    d = F.col("w") - mean
    z = (d - 0.5 * F.signum(d)) / F.sqrt(F.when(var > 0, var))
    return x.select(*by, "n1", "n2", "w", "ties", u.alias("u"), z.alias("z"), (F.col("_n") < 20).alias("exact"))


def fdr(df: DataFrame, family: list[str], p: str, q: float = 0.05, dependent: bool = False) -> DataFrame:
    """df with p_adj (step-up, not clipped at 1) and significant. dependent: divides by the harmonic sum of the family's
    size. P-values that are not finite are outside the family and stay NULL."""
    df = df.withColumn("_p", finite(F.col(p)))
    w, up = Window.partitionBy(*family), Window.partitionBy(*family).orderBy(F.col("_p").asc_nulls_last())
    df = df.withColumn("_k", F.row_number().over(up)).withColumn("_m", F.count("_p").over(w))
    scale = F.sum(F.when(F.col("_p").isNotNull(), 1.0 / F.col("_k"))).over(w) if dependent else F.lit(1.0)
    df = df.withColumn("_raw", F.when(F.col("_p").isNotNull(), F.col("_p") * F.col("_m") * scale / F.col("_k")))
    down = Window.partitionBy(*family).orderBy(F.col("_k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("p_adj", F.when(F.col("_p").isNotNull(), F.min("_raw").over(down)))
    return df.withColumn("significant", F.coalesce(F.least(F.col("p_adj"), F.lit(1.0)) <= q, F.lit(False))).drop("_p", "_k", "_m", "_raw")


@F.pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal tail of z; missing where z is not finite."""
    x = z.astype("float64").to_numpy()
    p = np.minimum(1.0, erfc(np.abs(x) / math.sqrt(2)))
    return pd.Series(np.where(np.isfinite(x), p, np.nan)).astype(object).where(np.isfinite(x), None).astype("float64")


def ranksum_p(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """(by, p): two-sided rank-sum test of groups 1 and 2. From 20 values on the normal tail of rank_sums(), 1 where the
    variance is 0; below, exact over the observed ranks, for which these few values go to one Arrow group a bin. Bins
    without values in both groups are left out."""
    z = rank_sums(df, by, group, value)
    large = z.where("NOT exact").select(*by, F.coalesce(two_sided_p("z"), F.lit(1.0)).alias("p"))
    few = df.select(*by, F.col(group).alias("_g"), finite(F.col(value)).alias("_v")).where("_v IS NOT NULL")
    few = _on(few, z.where("exact").select(*by), by)

    def run(table):
        g, v = table.column("_g").to_numpy(), table.column("_v").to_numpy()
        return table.select(by).slice(0, 1).append_column("p", pa.array([exact_ranksum(v[g == 1], v[g == 2])]))

    kind = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in few.select(*by).schema) + ", p double"
    return large.unionByName(few.groupBy(*by).applyInArrow(run, kind))


def signrank_p(pairs: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, p): two-sided signed-rank test of the pairs (x, y) of each bin, NULL for a bin without a difference. A bin is
    one Arrow group: it holds one pair a subject."""
    rows = pairs.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))

    def run(table):
        a, b = (table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("_x", "_y"))
        p = exact_signrank(a, b)
        return table.select(by).slice(0, 1).append_column("p", pa.array([None if math.isnan(p) else p], pa.float64()))

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema) + ", p double"
    return rows.groupBy(*by).applyInArrow(run, kind)


def paired(df: DataFrame, by: list[str], subject: str, group: str, value: str) -> DataFrame:
    """(by, subject, x, y): the values of groups 1 and 2 of a subject in a bin, where both are there."""
    side = lambda g, c: df.where(F.col(group) == g).select(*by, subject, finite(F.col(value).cast("double")).alias(c)).where(F.col(c).isNotNull())
    return side(1, "x").join(side(2, "y"), [*by, subject])


def parse_method(text: str) -> bool:
    """Is the control for dependent tests? Names: pdep, bh, independent; dep, by, dependent."""
    known = {"pdep": False, "bh": False, "independent": False, "dep": True, "by": True, "dependent": True}
    if (found := known.get(text.strip().lower())) is None:
        raise ValueError(f"unknown method {text!r}")
    return found


def fdr_critical(df: DataFrame, family: list[str], p: str, q: float = 0.05, dependent: bool = False) -> DataFrame:
    """(family, m, crit_p, n_sig): size of the family, greatest p at or below its step-up threshold (0: none) and number
    of significant ones."""
    rows = df.select(*family, finite(F.col(p)).alias("_p")).where("_p IS NOT NULL")
    k, m = F.row_number().over(Window.partitionBy(*family).orderBy("_p")), F.count("*").over(Window.partitionBy(*family))
    rows = rows.withColumn("_k", k).withColumn("_m", m)
    scale = F.aggregate(F.sequence(F.lit(1), F.col("_m")), F.lit(0.0), lambda a, i: a + 1.0 / i) if dependent else F.lit(1.0)
    passes = F.col("_p") <= F.col("_k") * q / (F.col("_m") * scale)
    crit = rows.groupBy(*family).agg(F.count("*").alias("m"), F.coalesce(F.max(F.when(passes, F.col("_p"))), F.lit(0.0)).alias("crit_p"))
    n_sig = fdr(rows.withColumn(p, F.col("_p")), family, p, q, dependent).groupBy(*family).agg(F.count_if("significant").alias("n_sig"))
    return _on(crit, n_sig, family)


def fdr_grid(df: DataFrame, by: list[str], group: str, value: str, q: float = 0.05, method: str = "dep", subject: str | None = None) -> DataFrame:
    """(by, p, p_adj, significant) for each bin of the grid: groups 1 and 2 are compared by ranks, or with ``subject`` by
    signed ranks of its pairs, and the error is controlled over the bins that can be tested; the others have p NULL."""
    bins = df.select(*by).distinct()
    p = signrank_p(paired(df, by, subject, group, value), by, "x", "y") if subject else ranksum_p(df, by, group, value)
    return fdr(_on(bins, p, by, "left").withColumn("_all", F.lit(1)), ["_all"], "p", q, parse_method(method)).drop("_all")


def permutation_grid(df: DataFrame, by: list[str], bin_: str, subject: str, group: str, value: str, alpha: float = 0.05, n: int = 10_000, seed: int = 0) -> DataFrame:
    """(by, bin, diff, bound, significant): the permutation test over the bins of each grid. A grid is one Arrow group: it
    has a value for each bin and subject, and its permutations share one bound."""
    rows = df.select(*by, bin_, subject, F.col(group).cast("int").alias("_g"), F.col(value).cast("double").alias("_v"))

    def numbered(column, of):
        """Distinct values in order, and the number of each row's."""
        d = column.combine_chunks().dictionary_encode("encode")
        names, at = np.unique(of(d.dictionary), return_inverse=True)
        return names, at[d.indices.to_numpy()]

    def run(table):
        names, at = numbered(table.column(bin_), lambda x: x.to_numpy(zero_copy_only=False))
        who, of = numbered(table.column(subject), lambda x: np.array([str(v) for v in x.to_pylist()]))
        g = table.column("_g").to_numpy()
        sides = []
        for side in (1, 2):
            m = np.full((len(names), len(who)), np.nan)
            m[at[g == side], of[g == side]] = table.column("_v").to_numpy(zero_copy_only=False).astype(float)[g == side]
            sides.append(m)
        out = permutation_test(*sides, alpha, n, seed)
        found = pa.table({bin_: names, "diff": pa.array(out["diff"], from_pandas=True), "bound": pa.array(out["bound"], from_pandas=True), "significant": out["significant"]})
        for k in reversed(by):
            found = found.add_column(0, k, pa.array([table.column(k)[0].as_py()] * len(names), table.schema.field(k).type))
        return found

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by, bin_).schema) + ", diff double, bound double, significant boolean"
    return rows.groupBy(*by).applyInArrow(run, kind)
