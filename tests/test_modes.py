"""Modes of histograms and fitted surfaces."""

import math

import numpy as np
import pytest

from nocturne.kernels import fits
from nocturne.operators import modes


def test_bounded_least_squares_finds_known_answers():
    rosen = lambda p: np.array([10 * (p[1] - p[0] ** 2), 1 - p[0]])
    x, _ = fits.bounded_least_squares(rosen, np.array([-1.2, 1.0]), np.full(2, -5.0), np.full(2, 5.0), 500)
    assert x == pytest.approx([1, 1], abs=1e-5)
    x, _ = fits.bounded_least_squares(rosen, np.array([-1.2, 1.0]), np.array([-2.0, -2.0]), np.array([0.5, 5.0]), 500)
    assert x == pytest.approx([0.5, 0.25], abs=1e-5)
    a, b = np.random.default_rng(0).standard_normal((30, 4)), np.arange(30.0)
    x, _ = fits.bounded_least_squares(lambda p: a @ p - b, np.zeros(4), np.full(4, -1e9), np.full(4, 1e9))
    assert x == pytest.approx(np.linalg.lstsq(a, b, rcond=None)[0], rel=1e-6, abs=1e-6)
    with pytest.raises(ValueError, match="above its upper"):
        fits.bounded_least_squares(rosen, np.zeros(2), np.ones(2), np.zeros(2))


X, Y = np.linspace(-10, 30, 41), np.linspace(5, 18, 53)


def test_rotated_gaussian_slopes():
    p = np.array([3.0, 2, 10, 13, 0.8, 1.2, 5, 15, 6, 4, 0.02, -0.3, 0.01, 0.02, 0.5])
    got = fits.rotated_gaussians_slopes(p, X, Y)
    for i in range(len(p)):
        h = np.zeros(len(p))
        h[i] = 1e-6
        slope = (fits.rotated_gaussians(p + h, X, Y) - fits.rotated_gaussians(p - h, X, Y)) / 2e-6
        assert np.allclose(got[..., i], slope, atol=1e-6)


def test_two_rotated_modes_are_recovered():
    true = np.array([[4.0, 9.5, 0.9, 4, 6, 0.02], [2.5, 13.5, 0.7, 16, 5, -0.02]])
    back = np.array([0.01, 0.02, 0.3])
    image = fits.rotated_gaussians(np.concatenate([true.T.ravel(), back]), X, Y)
    image[3, 4] = np.nan
    shape = np.array(fits.POWER_SHAPE)
    start = true + np.array([[0.5, 0.5, 0.3, 2, -1, 0], [-0.4, -0.4, 0.3, -2, 1, 0]])
    low = np.column_stack([[0, 0], [7, 11], np.full(2, shape[0, 0]), [-10, -10], np.full(2, shape[1, 0]), np.full(2, shape[2, 0])])
    high = np.column_stack([[20, 20], [12, 16], np.full(2, shape[0, 1]), [30, 30], np.full(2, shape[1, 1]), np.full(2, shape[2, 1])])
    fit = fits.fit_surface(image, X, Y, start, low, high, ([0, 0, 0], [-1, -1, -1], [1, 1, 1]))
    assert np.allclose(fit.modes, true, rtol=1e-3, atol=1e-3) and np.allclose(fit.background, back, atol=1e-3)
    assert fit.goodness["r2"] > 1 - 1e-8 and fit.goodness["dfe"] == image.size - 1 - 15


def test_von_mises_mode_is_recovered():
    x = np.linspace(-math.pi, math.pi, 40, endpoint=False)
    true = np.array([[1.0, 12.0, 2.0, 0.6, 1.1, 0.1]])
    image = fits.von_mises_gaussians(np.concatenate([true.T.ravel(), [0, 0, 0.4]]), x, Y)
    assert np.allclose(image.sum(axis=1), 1)
    (f, p, t), one = fits.PHASE_SHAPE, np.ones(1)
    low = np.column_stack([one * 0.1, one * 8, one * f[0], one * -3, one * p[0], one * t[0]])
    high = np.column_stack([one * 3, one * 16, one * f[1], one * 3, one * p[1], one * t[1]])
    start = np.array([[0.8, 11.0, 1.5, 0.0, 1.5, 0.0]])
    fit = fits.fit_surface(image, x, Y, start, low, high, ([0, 0, 0.4], [0, 0, 0.4], [0, 0, 0.4]), phase=True)
    assert np.allclose(fit.modes, true, rtol=1e-3, atol=1e-3)
    # one known point, by hand
    z = fits.von_mises_gaussians(np.array([1, 12, 2.5, math.pi / 3, 1.0, 0.1, 0, 0, 0]), np.array([0.5]), np.array([11.0]), False)[0, 0]
    assert z == pytest.approx(math.exp(-0.5 / 6.25) * math.exp(math.cos(0.5 - math.pi / 3 - math.sin(0.1)) - 1), rel=1e-12)


def bumps(rows, columns, *peaks):
    r, c = np.mgrid[:rows, :columns]
    return sum(h * np.exp(-((r - a) ** 2) / (2 * s * s) - (c - b) ** 2 / (2 * t * t)) for a, b, s, t, h in peaks)


def test_modes_of_an_image():
    image = bumps(40, 50, (10, 15, 4, 5, 10.0), (28, 36, 4, 5, 8.0)) + 0.001 * np.arange(50)[None, :]
    axes = modes.Axes(100.0, 1.0, 4.0, 0.25)
    label, rows = modes.find_modes(image, axes, modes.Limits(2.0, 0.5, 2.0))
    assert [r["label"] for r in rows] == [1, 2] and set(np.unique(label)) == {0, 1, 2}
    near = sorted(rows, key=lambda r: r["context"])
    assert near[0]["context"] == pytest.approx(110, abs=0.5) and near[0]["peak_freq"] == pytest.approx(4 + 15 / 4, abs=0.2)
    assert near[1]["context"] == pytest.approx(128, abs=0.5) and near[1]["height"] > 5
    assert modes.find_modes(image, axes, modes.Limits(2.0, 0.5, 99.0))[1] == []
    assert modes.find_modes(image, axes, modes.Limits(50.0, 0.5, 2.0))[1] == []
    image[10, 15] = np.nan
    assert len(modes.find_modes(image, axes, modes.Limits(2.0, 0.5, 2.0))[1]) == 2
    assert modes.find_modes(image[:1], axes)[1] == []


def test_a_mode_across_the_end_of_the_circle_is_one():
    n = 41
    phase = np.linspace(-math.pi, math.pi, n)
    image = (np.exp(2 * (np.cos(phase - math.pi) - 1)))[:, None] * np.exp(-((np.arange(50) - 25) ** 2) / 60)[None, :] * 10
    axes = modes.Axes(-math.pi, 2 * math.pi / (n - 1), 4.0, 0.25)
    label, rows = modes.find_phase_modes(image, axes, modes.Limits(0.5, 0.5, 0.5), (1.0, 2.0))
    assert label[0].any() and label[-1].any() and not label[n // 2].any()
    assert all(abs(abs(r["context"]) - math.pi) < 0.1 for r in rows) and 1 <= len(rows) <= 2


def test_modes_and_fits_of_recordings(spark):
    image = bumps(30, 40, (12, 18, 4, 5, 10.0))
    rows = [(k, c, f, float(image[c, f] * k)) for k in (1, 2) for c in range(30) for f in range(40)]
    cells = spark.createDataFrame(rows, "rec long, c_bin long, f_bin long, value double")
    axes = modes.Axes(0.0, 1.0, 0.0, 0.25)
    out = modes.histogram_modes(cells, axes, modes.Limits(2.0, 0.5, 1.0)).collect()
    assert sorted((r.rec, r.label) for r in out) == [(1, 1), (2, 1)]
    start, low, high = [[8.0, 4.0, 1.0, 11.0, 5.0, 0.0]], [[0.0, 1.0, 0.1, 5.0, 1.0, -0.03]], [[50.0, 9.0, 3.0, 20.0, 9.0, 0.03]]
    fit = {r.rec: r for r in modes.fit_histogram(cells, axes, start, low, high).collect()}
    assert fit[2].amplitude == pytest.approx(20, rel=1e-3) and fit[1].context == pytest.approx(12, abs=1e-2)
    assert fit[1].frequency_width == pytest.approx(5 / 4, rel=1e-3) and fit[1].context_width == pytest.approx(4, rel=1e-3)
