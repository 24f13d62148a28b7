"""Exact rank distributions, signed ranks, and permutation bounds."""

from __future__ import annotations

import math

import numpy as np


def _counts(weights: np.ndarray, chosen: int | None) -> np.ndarray:
    """Number of subsets (of a given size, or any) by the sum of their whole-number weights."""
    total = int(weights.sum())
    if chosen is None:
        ways = np.zeros(total + 1)
        ways[0] = 1
        for w in weights.astype(int):
            ways[w:] = ways[w:] + ways[: total + 1 - w]
        return ways
    ways = np.zeros((chosen + 1, total + 1))
    ways[0, 0] = 1
    for w in weights.astype(int):
        for k in range(chosen, 0, -1):
            ways[k, w:] += ways[k - 1, : total + 1 - w]
    return ways[chosen]


def average_ranks(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x, kind="stable")
    s = x[order]
    first = np.append(True, s[1:] != s[:-1])
    group = np.cumsum(first) - 1
    at = np.append(np.flatnonzero(first), len(x))
    out = np.empty(len(x))
    out[order] = ((at[:-1] + 1 + at[1:]) / 2)[group]
    return out


def erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function: a series of positive terms below 3, a continued fraction above."""
    x = np.asarray(x, float)
    y = np.abs(x)
    small, out = np.minimum(y, 3.0), np.empty_like(y)
    term = total = small
    for n in range(1, 80):
        term = term * 2 * small**2 / (2 * n + 1)
        total = total + term
    out = 1 - 2 / math.sqrt(math.pi) * np.exp(-(small**2)) * total
    large = np.maximum(y, 3.0)
    tail = large
    for n in range(60, 0, -1):
        tail = large + n / 2 / tail
    out = np.where(y < 3, out, np.exp(-np.minimum(large**2, 745.0)) / (tail * math.sqrt(math.pi)))
    return np.where(np.isnan(x), np.nan, np.where(x < 0, 2 - out, out))


def normal_p(z: float) -> float:
    return min(1.0, math.erfc(abs(z) / math.sqrt(2)))


def ranksum_p(x, y) -> float:
    """Two-sided rank-sum test: exact over the observed ranks below 20 values in all, else normal with tie correction
    and continuity. Values that are not finite are left out; an empty side gives NaN."""
    x, y = (np.asarray(v, float)[np.isfinite(v)] for v in (x, y))
    n1, n2 = len(x), len(y)
    if not n1 or not n2:
        return float("nan")
    ranks = average_ranks(np.concatenate([x, y]))
    w, n = ranks[:n1].sum(), n1 + n2
    if n < 20:
        ways = _counts(np.rint(2 * ranks), n1)
        at = int(round(2 * w))
        return min(1.0, 2 * min(ways[: at + 1].sum(), ways[at:].sum()) / ways.sum())
    _, t = np.unique(ranks, return_counts=True)
    var = n1 * n2 / 12 * (n + 1 - (t**3 - t).sum() / (n * (n - 1)))
    d = w - n1 * (n + 1) / 2
    return 1.0 if var <= 0 else normal_p((d - 0.5 * np.sign(d)) / math.sqrt(var))


def signrank_p(x, y) -> float:
    """Two-sided signed-rank test of pairs: exact up to 15 differences, else normal without continuity. Differences
    within the spacing of their operands are none; ranks of differences that close are tied."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = x[ok], y[ok]
    d, e = x - y, np.spacing(np.abs(x)) + np.spacing(np.abs(y))
    d, e = d[np.abs(d) > e], e[np.abs(d) > e]
    n = len(d)
    if not n:
        return float("nan")
    order = np.argsort(np.abs(d), kind="stable")
    a, s = np.abs(d)[order], e[order]
    group = np.concatenate([[0], np.cumsum(a[:-1] + s[:-1] < a[1:] - s[1:])])
    size = np.bincount(group)
    last = np.cumsum(size)
    ranks = (last - (size - 1) / 2)[group]
    w = ranks[d[order] > 0].sum()
    w = min(w, n * (n + 1) / 2 - w)
    if n <= 15:
        ways = _counts(np.rint(2 * ranks), None)
        return min(1.0, 2 * ways[: int(round(2 * w)) + 1].sum() / ways.sum())
    var = n * (n + 1) * (2 * n + 1) / 24 - (size.astype(float) ** 3 - size).sum() / 48
    return 1.0 if var <= 0 else normal_p((w - n * (n + 1) / 4) / math.sqrt(var))
