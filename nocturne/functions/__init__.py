"""Scalar functions on columns: missing values, decibels, rounding, angles, clock strings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def finite(x: Column) -> Column:
    """x, or NULL where it is NaN or infinite: missing values leave every aggregate alone."""
    return F.when(F.abs(x) < float("inf"), x)


def or_nan(x: Column) -> Column:
    return F.coalesce(x, F.lit(float("nan")))


def pow2db(x: Column) -> Column:
    """10 log10 x; NULL at or below 0."""
    return F.when(x > 0, 10 * F.log10(x))


def round_sig(x: Column, digits: int | Column) -> Column:
    """x to a number of significant digits; 0 and values that are not finite pass."""
    n = F.lit(digits) if isinstance(digits, int) else digits
    scale = F.pow(F.lit(10.0), n - 1 - F.floor(F.log10(F.abs(x))))
    return F.when((x == 0) | finite(x).isNull(), x).otherwise(F.round(x * scale) / scale)


def over(x: Column, d: Column) -> Column:
    """x / d as floating-point hardware has it: infinite or NaN where d is 0."""
    by_zero = F.when(x > 0, float("inf")).when(x < 0, float("-inf")).when(x.isNotNull(), float("nan"))
    return F.when(d == 0, by_zero).otherwise(x / F.when(d != 0, d))


def time_digits(fs: Column) -> Column:
    """Significant digits of times at a sampling rate: ceil(log10 fs) + 6 within 6 and 12; 8 if fs is no rate."""
    ok = finite(fs).isNotNull() & (fs > 0)
    return F.when(ok, F.least(F.greatest(F.ceil(F.log10(F.when(ok, fs))) + 6, F.lit(6)), F.lit(12))).otherwise(8).cast("int")


def wrap_to_pi(x: Column) -> Column:
    """x turned into [-pi, pi]; what lies inside stays, odd multiples of pi keep their sign."""
    turned = F.pmod(x + PI, F.lit(2 * PI)) - PI
    return F.when((x >= -PI) & (x <= PI), x).when((turned == -PI) & (x > 0), F.lit(PI)).otherwise(turned)


def clock_seconds(text: Column) -> Column:
    """Seconds of the day of a clock string: HH:MM[:SS[.f]] with ':' or '.', AM or PM, after an ISO date, before a zone;
    NULL for anything else."""
    s = F.regexp_replace(F.trim(text), r"^\d{4}-\d{1,2}-\d{1,2}[T ]", "")
    s = F.regexp_replace(s, r"(?i)\s*(z|[+-]\d{2}:?\d{2})$", "")
    pattern = r"(?i)^(\d{1,2})[:.](\d{2})(?:[:.](\d{2}(?:\.\d+)?))?\s*(am|pm)?$"
    part = lambda i: F.regexp_extract(s, pattern, i)
    ok = F.regexp_like(s, F.lit(pattern))
    half = F.lower(part(4))
    h, m, sec = part(1).try_cast("int"), part(2).try_cast("int"), F.coalesce(part(3).try_cast("double"), F.lit(0.0))
    h12 = F.when(half == "pm", F.pmod(h, F.lit(12)) + 12).when(half == "am", F.pmod(h, F.lit(12))).otherwise(h)
    valid = ok & (m < 60) & (sec < 60) & F.when(half == "", h < 24).otherwise((h >= 1) & (h <= 12))
    return F.when(valid, h12 * 3600.0 + m * 60.0 + sec)
