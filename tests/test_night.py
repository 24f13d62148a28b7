"""A made-up night through both passes."""

import math

import numpy as np

from nocturne.operators import bins, signals
from nocturne.plans.channels import ExpressionError, needed, read_channel, references, satisfied
from nocturne.plans.night import Settings, night

FS = 32.0


def test_bursts_of_a_night_are_found_with_their_context(spark):
    rng = np.random.default_rng(4)
    n = int(FS * 240)
    t = np.arange(n) / FS
    slow = 20 * np.sin(2 * np.pi * 0.8 * t) * (1 + 0.3 * np.sin(2 * np.pi * t / 60))
    x = slow + rng.standard_normal(n)
    bursts = np.arange(12.0, 230.0, 9.0)
    for b in bursts:
        x += 12 * np.exp(-0.5 * ((t - b) / 0.35) ** 2) * np.sin(2 * np.pi * 11.0 * (t - b))
    samples = spark.createDataFrame([("n1", float(u), float(v)) for u, v in zip(t, x, strict=True)], "rec string, t double, v double")
    stages = spark.createDataFrame([("n1", 30.0 * k, 2 if k % 3 else 1) for k in range(9)], "rec string, t double, stage int")
    first, second = (signals.Taper(w, 0.125, 2.0, 3, (0.0, 16.0), spacing=0.25) for w in (1.0, 2.0))
    settings = Settings(first=first, second=second, segment_seconds=60.0, threshold=8.0, stride=(1, 1), duration=(0.3, 6.0), bandwidth=(0.5, 12.0), frequency=(4.0, 15.0), power_taper=signals.Taper(5.0, 0.5, 4.0, 7, (0.3, 1.5), "linear"), power_bins=bins.Bins(0.0, 1.0, 2.0, 20), phase_bins=bins.Bins(-math.pi, 2 * math.pi / 20, 2 * math.pi / 5, 20, 2 * math.pi), frequency_bins=bins.Bins(5.0, 0.5, 1.0, 20), least_minutes=0.0)
    out = night(samples, stages, FS, settings)
    peaks = out.peaks.collect()
    strong = [r for r in peaks if r.height > 30]
    hit = [b for b in bursts if any(abs(r.peak_time - b) < 0.7 and abs(r.peak_freq - 11) < 1 for r in peaks)]
    assert len(hit) >= 0.8 * len(bursts)
    assert all(4 <= r.peak_freq <= 16 and r.stage in (0, 1, 2) for r in peaks)
    assert any(r.so_power is not None for r in strong or peaks) and all(r.so_phase is None or abs(r.so_phase) <= math.pi + 1e-9 for r in peaks)
    assert out.context.count() == n
    assert out.phase.cells.where("n > 0").count() > 0 and out.power.peaks.agg({"n": "max"}).first()[0] >= len(hit)


def test_channels_of_recordings(spark, tmp_path):
    from nocturne.sources.edf import encode_edf

    a = {"C3": np.arange(8.0), "M1": np.ones(8) * 2, "M2": np.ones(8) * 4, "X": np.zeros(8)}
    (tmp_path / "a.edf").write_bytes(encode_edf(a, dict.fromkeys(a, 2), (-100.0, 100.0)))
    (tmp_path / "b.edf").write_bytes(encode_edf({"C3": np.arange(4.0), "M2": np.ones(4)}, {"C3": 2, "M2": 2}, (-100.0, 100.0)))
    (tmp_path / "c.edf").write_bytes(encode_edf({"M2": np.ones(4)}, {"M2": 2}, (-100.0, 100.0)))
    named = references(["# references", "REF = mean(M1, M2)", "", "BAD = C3 *", "Y = X  # same"])
    assert named == {"REF": "mean(M1, M2)", "BAD": "C3 *", "Y": "X"}
    out = {r.path[-5:]: r.x for r in read_channel(spark, str(tmp_path), "C3 - REF", named).collect()}
    assert set(out) == {"a.edf", "b.edf"}
    assert np.allclose(out["a.edf"], np.arange(8) - 3, atol=0.02) and np.allclose(out["b.edf"], np.arange(4) - 1, atol=0.02)
    assert satisfied("C3 - REF", ["C3", "M2"], named) and not satisfied("C3 - REF", ["C3"], named) and not satisfied("O1", ["C3"])
    assert needed(["C3 - M1", "mean(M1, M2)"], ["C3", "M1", "M2", "O1"]) == ["C3", "M1", "M2"]
    for bad in (["nothing"], ["A = C3", "a = M1"], ["= C3"]):
        try:
            references(bad)
        except ExpressionError:
            continue
        raise AssertionError(bad)
