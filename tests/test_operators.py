"""Hand-made cases of single operators."""

import math

import pytest
from pyspark.sql import functions as F

from nocturne.functions import clock_seconds, wrap_to_pi
from nocturne.operators import asof, bins, quantile, so, stats, windows


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("q,expected", [(0.5, 3.0), (0.25, 1.75), (0.02, 1.0)])
def test_hazen(spark, q, expected):
    df = frame(spark, [("a", float(x)) for x in (1, 2, 3, 4, 5)] + [("a", float("nan")), ("b", None)], "k string, v double")
    assert [(r.k, r.pct, r.n) for r in quantile.hazen(df, ["k"], "v", q).collect()] == [("a", expected, 5)]


def _interpolated(spark, how, xp, fp, q):
    right = frame(spark, [(1, float(t), v) for t, v in zip(xp, fp, strict=True)], "k int, t double, v double")
    left = frame(spark, [(1, float(t)) for t in q], "k int, t double")
    return [r.x for r in how(left, right, ["k"], "x").orderBy("t").collect()]


def test_previous(spark):
    assert _interpolated(spark, asof.previous, [0, 10, 20, 30], [1.0, 2.0, 3.0, 4.0], [-5, 0, 5, 10, 29.9, 30, 100]) == [0, 1, 1, 2, 3, 4, 0]


def test_nearest_takes_the_later_of_two(spark):
    assert _interpolated(spark, asof.nearest, [1, 2, 3], [0.0, 1.0, 0.0], [1.5, 2.5]) == [1, 0]


def test_linear(spark):
    assert _interpolated(spark, asof.linear, [0, 1, 2], [10.0, 20.0, 30.0], [-1, 0, 0.5, 1.5, 2, 100]) == [10, 10, 15, 25, 30, 30]


def test_linear_padded(spark):
    assert _interpolated(spark, asof.linear_padded, [0, 1, 2, 3], [5.0, 6.0, 7.0, 8.0], [-1.5, -1, -0.5, 0, 3, 3.5, 4, 4.5]) == [None, 5, 5, 5, 8, 8, 8, None]
    assert _interpolated(spark, asof.linear_padded, [1, 2, 3], [10.0, float("nan"), 30.0], [1, 1.5, 2, 2.5, 3]) == [10, None, None, None, 30]


def test_wrap(spark):
    got = frame(spark, [(i, x * math.pi) for i, x in enumerate((1, -1, 3, -3, 1.5))], "i int, x double").orderBy("i").select(wrap_to_pi(F.col("x")).alias("x")).collect()
    assert [r.x for r in got] == pytest.approx([math.pi, -math.pi, math.pi, -math.pi, -0.5 * math.pi])


def test_moving(spark):
    df = frame(spark, [(1, i, float(v)) for i, v in enumerate((1, 2, 3, 4, 5, 6))], "k int, t int, v double")
    assert [r.m for r in windows.movmean(df, ["k"], "t", "v", 4, "m").orderBy("t").collect()] == [1.5, 2, 2.5, 3.5, 4.5, 5]
    df = frame(spark, [(1, i, float(v)) for i, v in enumerate((1, 5, 2, 8, 3, 9))], "k int, t int, v double")
    assert [r.m for r in windows.movmedian(df, ["k"], "t", "v", 4, "m").orderBy("t").collect()] == [3, 2, 3.5, 4, 5.5, 8]


def test_flat_runs(spark):
    df = frame(spark, [(1, i, float(v)) for i, v in enumerate((1, 1, 1, 1, 2, 2, 3, 3, 3))], "k int, t int, v double")
    assert [r.f for r in windows.flat_runs(df, ["k"], "t", "v", 3, "f").orderBy("t").collect()] == [True] * 4 + [False] * 2 + [True] * 3


def test_clock(spark):
    cases = {"22.12.52": 79972.0, "10:19:22 PM": 80362.0, "12:00:00 AM": 0.0, "2024-01-02T01:29:29.42+01:00": 5369.42, "2024-01-02": None, "25:00": None, "": None}
    df = frame(spark, list(cases.items()), "s string, x double").select("s", clock_seconds(F.col("s")).alias("t"))
    assert {r.s: r.t for r in df.collect()} == pytest.approx(cases)


def test_rank_sums_and_fdr(spark):
    df = frame(spark, [(0, 1, float(v)) for v in (1, 2, 2, 3)] + [(0, 2, float(v)) for v in (2, 3, 3, 4)], "bin int, g int, v double")
    r = stats.rank_sums(df, ["bin"], "g", "v").collect()[0]
    assert (r.n1, r.n2, r.w, r.exact) == (4, 4, 13.0, True)
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216]
    out = stats.fdr(frame(spark, [(1, i, x) for i, x in enumerate(p)], "fam int, i int, p double"), ["fam"], "p").orderBy("i").collect()
    assert [r.p_adj for r in out] == pytest.approx([0.01, 0.04, 0.084, 0.084, 0.084, 0.1, 0.105714285714286, 0.216, 0.216, 0.216])


def test_circular_bins(spark):
    b = bins.Bins(-math.pi, math.pi / 2, math.pi, 4, 2 * math.pi)
    df = frame(spark, [(math.pi - 0.1,)], "x double")
    assert sorted(r.b for r in bins.bin_join(df, "x", b, "b").collect()) == [0, 3]


def test_methods():
    assert so.parse_method("shift") == ("shift", 2.0, (1, 2, 3, 4))
    assert so.parse_method("p5shift2")[1:] == (5.0, (2,))
    with pytest.raises(ValueError):
        so.parse_method("p500shift9")
