"""Operators on recordings against their kernels over the whole recording."""

import numpy as np
import pytest

from nocturne.kernels import filters, regions, spectra
from nocturne.operators import asof, signals

FS = 20.0


@pytest.fixture(scope="module")
def night():
    t = np.arange(2000) / FS
    rng = np.random.default_rng(2)
    return t, np.sin(2 * np.pi * 3.3 * t) * (1 + 0.5 * np.sin(2 * np.pi * 0.05 * t)) + 0.3 * rng.standard_normal(len(t)).cumsum() * 0.05


def frame(spark, night, **more):
    t, x = night
    return spark.createDataFrame([("a", float(u), float(v)) for u, v in zip(t, x, strict=True)] + [("b", 0.0, 1.0)], "rec string, t double, v double")


def test_spectrogram_in_stretches(spark, night, monkeypatch):
    monkeypatch.setattr(signals, "WINDOWS", 37)
    taper = signals.Taper(2.0, 0.25, 2.0, 3, (0.5, 8.0))
    got = signals.spectrogram(frame(spark, night), ["rec"], FS, taper).orderBy("t_idx").collect()
    times, f, p = spectra.multitaper(night[1], FS, 2.0, 0.25, 2.0, 3, taper.nfft(FS), "constant", (0.5, 8.0))
    assert [r.t for r in got] == pytest.approx(times.tolist()) and {r.rec for r in got} == {"a"}
    assert np.allclose(np.array([r.power for r in got]).T, p) and np.allclose(signals.frequencies(FS, taper), f)
    assert abs(f[p.mean(axis=1).argmax()] - 3.3) < 0.3


def test_slope_artifacts(spark, night):
    t, x = night
    x = x.copy()
    x[900:1100] += np.random.default_rng(0).standard_normal(200) * 30  # flat spectrum
    taper = signals.Taper(5.0, 2.5, 3.0, 5, (1.0, 9.0), "linear")
    out = signals.slope_artifacts(frame(spark, (t, x)), ["rec"], FS, -0.5, taper=taper).orderBy("rec", "t").collect()
    mask = np.array([r.artifact for r in out if r.rec == "a"])
    times, f, p = spectra.multitaper(x, FS, 5.0, 2.5, 3.0, 5, taper.nfft(FS), "linear", (1.0, 9.0))
    slopes = np.polyfit(np.log(f), np.log(p), 1)[0]
    bad = slopes > -0.5
    for u, m in zip(t, mask, strict=True):
        d = np.abs(times - u)
        near = len(d) - 1 - int(np.argmin(d[::-1]))  # midway the later one
        assert m == (bad[near] if times[0] <= u <= times[-1] else True)
    assert mask[1000] and not all(mask) and [r.artifact for r in out if r.rec == "b"] == [False]


def test_refinement(spark, night):
    peaks = [("a", i, float(u), 3.0, 2.5, 4.2) for i, u in enumerate([0.5, 20.0, 31.3, 60.0, 99.9])] + [("a", 9, 50.0, 5.0, 4.5, 4.4), ("c", 10, 50.0, 7.0, 4.0, 6.0)]
    df = spark.createDataFrame(peaks, "rec string, id int, peak_time double, peak_freq double, lo double, hi double")
    got = {r.id: r for r in signals.refine_peaks(df, frame(spark, night), ["rec"], FS, 4.0, 0.05, (0.0, 9.0), stretch=15.0).collect()}
    for i, u in ((1, 20.0), (2, 31.3), (3, 60.0)):
        f, p = spectra.event_spectra(night[1], FS, np.array([u]), 4.0, 0.05, (0.0, 9.0))
        assert got[i].refined == pytest.approx(spectra.refine(f, p[0], 2.5, 4.2), abs=1e-9) and abs(got[i].refined - 3.3) < 0.1 and got[i].keep
    assert (got[0].refined, got[0].keep, got[4].refined) == (3.0, True, 3.0)
    assert (got[9].refined, got[9].keep, got[10].refined) == (None, False, 7.0)


def test_phase_and_stage(spark, night):
    sos = filters.cheby1_sos(2, 0.2, (2.0, 5.0), FS, "bandpass")
    stages = spark.createDataFrame([("a", 10.0, 2), ("a", 40.0, 3), ("a", 70.0, 1)], "rec string, t double, stage int")
    df = frame(spark, night).withColumn("out", asof.F.col("t") > 90)
    got = signals.phase_of(df, ["rec"], sos, stages, excluded="out").where("rec = 'a'").orderBy("t").collect()
    phase = regions.so_phase(night[1], sos)
    assert [r.phase for r in got[:1801]] == pytest.approx(phase[:1801].tolist()) and got[1900].phase is None and got[1900].filtered is None
    assert (got[0].stage, got[300].stage, got[900].stage, got[1500].stage) == (0, 2, 3, 0)
    assert signals.phase_of(df, ["rec"], sos).first().stage == 1


def test_power_of_a_spectrogram(spark):
    rows = [("a", float(i), [float(i + 1), None, 2.0 * (i + 1)]) for i in range(40)]
    spect = spark.createDataFrame(rows, "rec string, t double, power array<double>")
    out = signals.power_of(spect, ["rec"], 0.5, "none", begin=100.0).orderBy("t").collect()
    assert [r.so_power for r in out] == pytest.approx([10 * np.log10(1.5 * (i + 1)) if i else None for i in range(40)], nan_ok=True) or out[0].so_power is None
    assert out[0].t == 100.0 and out[5].stage == 1
    samples = spark.createDataFrame([("a", 99.0, False), ("a", 110.5, False), ("a", 120.0, True), ("a", 200.0, False)], "rec string, t double, out boolean")
    up = signals.power_of(spect, ["rec"], 0.5, "none", samples=samples, excluded="out", begin=100.0).orderBy("t").collect()
    db = lambda i: 10 * np.log10(1.5 * (i + 1))
    assert up[1].so_power == pytest.approx((db(10) + db(11)) / 2) and up[2].so_power is None and up[3].so_power == pytest.approx(db(39))
