"""Recordings, stage files and channel expressions on made-up files."""

import gzip

import numpy as np
import pytest

from nocturne.plans import channels
from nocturne.sources.edf import read_edf, read_headers
from nocturne.sources.staging import read_staging


def edf(signals, records=4, duration=1):
    """signals: label -> (samples in a record, int16 values)."""
    pad = lambda x, n: str(x).ljust(n).encode()
    n = len(signals)
    out = pad(0, 8) + pad("p", 80) + pad("r", 80) + pad("01.01.24", 8) + pad("21.44.00", 8) + pad(256 * (n + 1), 8) + pad("", 44) + pad(-1, 8) + pad(duration, 8) + pad(n, 4)
    for values, width in ((list(signals), 16), ([""] * n, 80), (["uV"] * n, 8), ([-100] * n, 8), ([100] * n, 8), ([-1000] * n, 8), ([1000] * n, 8), ([""] * n, 80), ([s for s, _ in signals.values()], 8), ([""] * n, 32)):
        out += b"".join(pad(v, width) for v in values)
    for r in range(records):
        out += b"".join(np.asarray(x[r * s : (r + 1) * s], "<i2").tobytes() for s, x in signals.values())
    return out


def test_edf(spark, tmp_path):
    data = edf({"C3-A2": (2, range(8)), "": (1, [10, 20, 30, 40])})
    (tmp_path / "a.edf").write_bytes(data)
    (tmp_path / "b.edf.gz").write_bytes(gzip.compress(data))
    (tmp_path / "c.edf").write_bytes(b"short")
    heads = read_headers(spark, str(tmp_path)).collect()
    assert sorted((r.path[-4:], r.ch, r.fs, r.records) for r in heads if r.error is None) == sorted((p, c, f, 4) for p in (".edf", "f.gz") for c, f in (("C3-A2", 2.0), ("ch1", 1.0)))
    assert [r.error for r in heads if r.error] == ["shorter than a header"]
    got = read_edf(spark, [str(tmp_path / "a.edf"), str(tmp_path / "b.edf.gz")], ["c3-a2", "none"], chunk_seconds=3).collect()
    assert sorted((r.t0, len(r.x)) for r in got) == [(0.0, 6), (0.0, 6), (3.0, 2), (3.0, 2)]
    assert [x for r in sorted(got, key=lambda r: (r.path, r.t0))[:2] for x in r.x] == pytest.approx([0.1 * i for i in range(8)])


def test_staging(spark, tmp_path):
    (tmp_path / "s.csv").write_text("time,stage\n23:59:30,Wake\n23:59:45,what\n00:00:00,N2\n00:00:30,\"REM\"\n")
    got = read_staging(spark, str(tmp_path / "s.csv"), header_lines=1, start_time="23:59:00").orderBy("line").collect()
    assert [(r.t, r.stage) for r in got] == [(0.0, 0), (30.0, 5), (60.0, 2), (90.0, 4)]
    (tmp_path / "e.csv").write_text("1,W\n2,N1\n4,N2\n5,N3\n")
    assert [r.t for r in read_staging(spark, str(tmp_path / "e.csv")).orderBy("line").collect()] == [30, 60, 120, 150]
    (tmp_path / "late.csv").write_text("21:40:00,N2\n21:40:30,N2\n")
    got = read_staging(spark, str(tmp_path / "late.csv"), start_time="21:44:00").orderBy("line").collect()
    assert [r.t for r in got] == [0.0, 86160.0, 86190.0]
    with pytest.raises(ValueError, match="earlier than the recording start time"):
        read_staging(spark, str(tmp_path / "late.csv"), start_time="21:44:00", recording_seconds=8 * 3600.0)
    (tmp_path / "night.csv").write_text("01:55:00,N2\n01:55:30,N2\n")
    got = read_staging(spark, str(tmp_path / "night.csv"), start_time="21:44:00", recording_seconds=8 * 3600.0).orderBy("line").collect()
    assert [r.t for r in got] == [0.0, 15060.0, 15090.0]
    (tmp_path / "twice.csv").write_text("5,N2\n5,N1\n")
    with pytest.raises(Exception, match="two stages at one time"):
        read_staging(spark, str(tmp_path / "twice.csv")).collect()
    (tmp_path / "q.csv").write_text('"x, y",10.5,"stage 2"\n"z",20.5,U\n')
    assert [(r.t, r.stage) for r in read_staging(spark, str(tmp_path / "q.csv"), time_col=2, stage_col=3).orderBy("line").collect()] == [(10.5, 2), (20.5, 0)]


def test_files_are_written_and_read_back(spark, tmp_path):
    from nocturne.sources import edf as edf_source
    from nocturne.sources import npy, peaks_csv

    signals = {"A": np.arange(7.0), "B": np.linspace(-3, 3, 12)}
    (tmp_path / "w.edf").write_bytes(edf_source.encode_edf(signals, {"A": 2, "B": 3}, (-10.0, 10.0)))
    back = {r.ch: r.x for r in read_edf(spark, str(tmp_path / "w.edf")).collect()}
    assert np.allclose(back["A"][:7], signals["A"], atol=2e-4) and np.allclose(back["B"], signals["B"], atol=2e-4) and len(back["A"]) == 8
    (tmp_path / "bad.edf").write_bytes(b"short")
    assert read_edf(spark, str(tmp_path / "bad.edf"), skip_bad=True).count() == 0
    np.save(tmp_path / "a.npy", np.arange(6.0).reshape(2, 3))
    assert [r.x for r in npy.read_npy(spark, str(tmp_path / "a.npy")).orderBy("row").collect()] == [[0, 1, 2], [3, 4, 5]]
    assert npy.filter_name(100.0, (0.3, 1.5)) == "sophase_sos_Fs100_0.3_1.5.npy"
    assert npy.phase_filter(spark, 100.0, (0.3, 1.5), str(tmp_path)).shape[1] == 6
    np.save(tmp_path / npy.filter_name(128.0, (0.5, 2.0)), np.ones((3, 6)))
    assert (npy.phase_filter(spark, 128.0, (0.5, 2.0), str(tmp_path)) == 1).all()
    row = {c: 1.23456789 for c in peaks_csv.COLUMNS} | {"SegmentNum": 1, "PeakStage": None, "SOpower": None}
    kinds = ", ".join(f"{c} {'int' if c in ('SegmentNum', 'PeakStage') else 'double'}" for c in peaks_csv.COLUMNS)
    df = spark.createDataFrame([tuple(row[c] for c in peaks_csv.COLUMNS)], kinds)
    peaks_csv.write_peaks(df, str(tmp_path / "p"), 100.0, peaks_csv.preamble("nocturne", "1", "2", subject="s 1"))
    lines = "".join(f.read_text() for f in (tmp_path / "p").glob("part-*")).splitlines()
    assert lines[0] == "# peaks table" and "# subjectID: s 1" in lines and lines[6] == ",".join(peaks_csv.COLUMNS)
    (got,) = peaks_csv.read_peaks(spark, str(tmp_path / "p")).collect()
    assert (got.PeakTime, got.PeakFrequency, got.Height, got.PeakStage) == (1.2345679, 1.235, 1.23, 0) and got.SOpower != got.SOpower


def test_expressions():
    have = ["C3", "C4", "A1", "A2", "C3-A2", "O1"]
    assert channels.select("C3-A2", have) == {"C3-A2": 1.0}
    assert channels.select("C4-A1", have) == {"C4": 1.0, "A1": -1.0}
    assert channels.select("0.5*[C3 + C4] - mean(A1, A2, M1)", have) == {"C3": 0.5, "C4": 0.5, "A1": -0.5, "A2": -0.5}
    assert channels.select("$C3-A2$ - M", have, {"M": "mean(A1, A2)"}) == {"C3-A2": 1.0, "A1": -0.5, "A2": -0.5}
    assert channels.select("C3 - C3 + O1", have) == {"O1": 1.0}
    for bad in ("C3*C4", "C3/C4", "1/C3", "C3/0", "C3+1", "C3 +", "(C3", "C3 & C4"):
        with pytest.raises(channels.ExpressionError):
            channels.flatten(channels.parse(bad), have)
    with pytest.raises(LookupError):
        channels.select("mean(X, Y)", have)
    with pytest.raises(channels.ExpressionError):
        channels.select("P", have, {"P": "Q", "Q": "P"})


def test_evaluate(spark):
    df = spark.createDataFrame([(i, c, v + i) for i in range(2) for c, v in (("C3", 10.0), ("A1", 4.0), ("O1", 99.0))] + [(2, "C3", 1.0)], "i int, ch string, x double")
    got = {r.i: r.x for r in channels.evaluate(df, {"C3": 1.0, "A1": -0.5}, ["i"]).collect()}
    assert got == {0: 8.0, 1: 8.5, 2: None}
