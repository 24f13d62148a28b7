"""Numeric kernels on cases with known answers."""

import itertools
import math

import numpy as np
import pytest

from nocturne.kernels import filters, spectra
from nocturne.kernels import tests_of_rank as ranks


def test_filter_response_and_zero_phase():
    fs = 100.0
    for kind, edges, inside, outside in (("lowpass", 10.0, 3.0, 30.0), ("highpass", 10.0, 30.0, 2.0), ("bandpass", (5.0, 12.0), 8.0, 30.0)):
        sos = filters.cheby1_sos(4, 0.2, edges, fs, kind)
        def gain(f):
            z = np.exp(-2j * np.pi * f / fs * np.arange(3))
            return abs(np.prod([(s[:3] @ z) / (s[3:] @ z) for s in sos]))
        assert 10 ** (-0.2 / 20) - 1e-6 <= gain(inside) <= 1 + 1e-6 and gain(outside) < 0.03
        for e in np.atleast_1d(edges):
            assert gain(e) == pytest.approx(10 ** (-0.2 / 20), abs=1e-6)
        t = np.arange(3000) / fs
        x = np.sin(2 * np.pi * inside * t)
        y = filters.sosfiltfilt(sos, x)
        assert y[500:-500] == pytest.approx(x[500:-500] * gain(inside) ** 2, abs=1e-3)


def test_section_is_the_recursion():
    rng = np.random.default_rng(0)
    x, b, a = rng.standard_normal(700), np.array([0.3, -0.2, 0.1]), np.array([1.0, -1.2, 0.5])
    z, expected = np.zeros(2), []
    for v in x:
        y = b[0] * v + z[0]
        z = np.array([b[1] * v - a[1] * y + z[1], b[2] * v - a[2] * y])
        expected.append(y)
    assert filters._section(b, a, x, np.zeros(2)) == pytest.approx(expected)


def test_analytic_phase():
    t = np.arange(1000) / 100
    assert np.abs(filters.analytic(np.cos(2 * np.pi * 2 * t)) - np.exp(2j * np.pi * 2 * t)).max() < 1e-9


def test_tapers_and_spectrogram():
    w = spectra.dpss(128, 3.0, 5)
    assert w @ w.T == pytest.approx(np.eye(5), abs=1e-9) and (w[::2].sum(axis=1) > 0).all()
    x = np.sin(2 * np.pi * 13 * np.arange(2000) / 100)
    t, f, p = spectra.multitaper(x, 100.0, 2.0, 0.5, 2.0, 3, 256)
    assert p.shape == (len(f), len(t)) and f[p.mean(axis=1).argmax()] == pytest.approx(13, abs=0.8)
    assert (p.sum(axis=0) * (f[1] - f[0])).mean() == pytest.approx(0.5, rel=0.05)
    f, p = spectra.event_spectra(x, 100.0, np.array([5.0, 10.0]))
    assert spectra.refine(f, p[0], 11, 15) == pytest.approx(13, abs=0.02)
    assert math.isnan(spectra.refine(f, p[0], 13.05, 13.3)) and math.isnan(spectra.refine(f, p[0], 3, 3))


def test_spline():
    got = spectra.not_a_knot(np.arange(6), [1, 3, 2, 5, 4, 6], [0.5, 1.5, 4.5, -0.5, 5.5])
    assert got == pytest.approx([3.125, 2.125, 3.875, -4.875, 11.875])
    x = np.array([0, 0.5, 2, 2.5, 4])
    assert spectra.not_a_knot(x, x**3 - x, [1.0, 3.3]) == pytest.approx([0, 3.3**3 - 3.3])


def test_ranksum():
    assert ranks.ranksum_p([1, 2, 3, 4, 5], [2, 3, 4, 5, 6]) == pytest.approx(0.44444444444444442)
    assert ranks.ranksum_p([1, 2, 2, 3], [2, 3, 3, 4]) == pytest.approx(0.2857142857142857)
    assert ranks.ranksum_p([1, 2], [3, 4, np.nan]) == pytest.approx(1 / 3)
    assert ranks.ranksum_p([1] * 20, [1] * 20) == 1
    assert math.isnan(ranks.ranksum_p([], [1]))


def test_signrank():
    assert ranks.signrank_p(np.arange(15) + 1.0, np.arange(15)) == pytest.approx(2 / 32768)
    assert math.isnan(ranks.signrank_p([1, 2], [1, 2]))
    x, y = np.array([3.0, 5, 1, 8]), np.array([1.0, 6, 4, 2])
    r = ranks.average_ranks(np.abs(x - y))
    sums = [sum(r[i] for i in range(4) if s[i]) for s in itertools.product((0, 1), repeat=4)]
    w = min(r[x > y].sum(), r[x < y].sum())
    assert ranks.signrank_p(x, y) == pytest.approx(min(1, 2 * np.mean([s <= w for s in sums])))


def test_permutation_finds_the_planted_bin():
    from nocturne.kernels.permutation import permutation_test

    rng = np.random.default_rng(4)
    a, b = rng.standard_normal((4, 20)), rng.standard_normal((4, 20))
    a[2] += 3
    a[1, 3] = np.nan
    out = permutation_test(np.concatenate([a, np.full((4, 1), np.nan)], axis=1), b, n=2000)
    assert out["significant"].tolist() == [False, False, True, False]
    hits = sum(permutation_test(rng.standard_normal((5, 12)), rng.standard_normal((5, 12)), n=400, seed=i)["significant"].any() for i in range(40))
    assert hits <= 7


@pytest.mark.parametrize("m,n,limit", [(5_000, 60, None), (300, 1_000, 1 << 63), (70, 4_000, None), (3, 5, None)])
def test_shuffles_are_those_of_the_generator(monkeypatch, m, n, limit):
    """Also where half of all draws are thrown away; many items are not shuffled a step at a time."""
    from nocturne.kernels import permutation

    if limit:
        monkeypatch.setattr(permutation, "last", lambda n: limit + 0 * n)
    draw, items, expected = permutation.Xoshiro(9), list(range(m)), []
    for _ in range(n):
        draw.shuffle(items)
        expected.append(list(items))
    if m * n >= 1 << 18:
        monkeypatch.delattr(permutation.Xoshiro, "shuffle")
    assert [x.tolist() for x in permutation.shuffles(9, m, n)] == expected


def test_bsplines():
    from nocturne.kernels import bspline

    t = bspline.knots([0, 1, 2, 4], 4)
    x = np.linspace(0, 4, 41)
    b = bspline.basis(x, t, 4)
    assert b.shape == (41, 6) and b.sum(axis=1) == pytest.approx(np.ones(41)) and (b >= -1e-12).all() and b[-1, -1] == 1
    y = np.linspace(-1, 1, 15)
    z = x[:, None] ** 3 - x[:, None] * y[None, :] ** 2 + 1
    c, fit = bspline.fit_surface(z, x, y, [0, 1, 2, 4], [-1, 0, 1])
    assert c.shape == (6, 4) and fit == pytest.approx(z, abs=1e-8)


def test_artifacts():
    from nocturne.kernels import artifacts

    assert artifacts.flat_runs(np.array([1.0, 1, 1, 1, 2, 2, 3, 3, 3]), 3, 0.0).tolist() == [True] * 4 + [False] * 2 + [True] * 3
    x = np.array([1.0, 5, 2, 8, 3, 9])
    assert artifacts.moving(x, 4, "median").tolist() == [3, 2, 3.5, 4, 5.5, 8]
    assert artifacts.moving(np.arange(1.0, 7), 4, "mean").tolist() == [1.5, 2, 2.5, 3.5, 4.5, 5]
    assert artifacts.fill(np.array([9.0, 1, 9, 9, 4, 9]), np.array([1, 0, 1, 1, 0, 1], bool)).tolist() == [1, 1, 2, 3, 4, 4]
    rng = np.random.default_rng(6)
    fs, n = 100.0, 60_000
    x = np.cumsum(rng.standard_normal(n)) * 0.02 + rng.standard_normal(n)
    x[12_000:12_400] = 0.5
    x[30_000:30_200] += 60 * rng.standard_normal(200)
    x[5] = np.nan
    mask = artifacts.detect(x, fs)
    assert mask[5] and mask[12_000:12_400].all() and mask[30_050:30_150].all() and mask.mean() < 0.05
