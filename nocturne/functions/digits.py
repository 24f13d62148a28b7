"""Significant digits of plain numbers, as the functions on columns have them."""

from __future__ import annotations

import math


def significant(x: float, digits: int) -> float:
    """x to a number of significant digits; 0 and values that are not finite pass."""
    if x == 0 or not math.isfinite(x):
        return float(x)
    scale = 10.0 ** (digits - 1 - math.floor(math.log10(abs(x))))
    return math.copysign(math.floor(abs(x) * scale + 0.5), x) / scale


def time_places(fs: float) -> int:
    return min(max(math.ceil(math.log10(fs)) + 6, 6), 12) if math.isfinite(fs) and fs > 0 else 8
