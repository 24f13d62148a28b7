"""Spectrograms, spectral slopes, refinement of peaks and slow-oscillation phase of recordings.

Windows of a recording are independent, so its samples are dealt into stretches of so many windows, with those that
reach over the end; a stretch is one Arrow group of bounded size, and a night is as many groups as it is long. Filters
are recursive and take a recording whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import finite
from ..kernels import spectra
from ..kernels.regions import so_phase
from . import asof, series
from .quantile import _on
from .so import so_power

WINDOWS = 2_000  # a group


@dataclass(frozen=True)
class Taper:
    """Window and step in seconds, time-half-bandwidth and number of tapers, band in hertz, detrending, least spacing."""

    window: float
    step: float
    bandwidth: float
    tapers: int
    band: tuple[float, float]
    detrend: str = "constant"
    spacing: float = 0.1

    def nfft(self, fs: float) -> int:
        return 1 << max(0, math.ceil(math.log2(max(fs / self.spacing, 1.0))), math.ceil(math.log2(max(round(self.window * fs), 1))))


#: Window, step, band and detrending of the two passes, of slow-oscillation power and of the slope test.
PASS_1, PASS_2 = Taper(1.0, 0.05, 2.0, 3, (0.0, 30.0)), Taper(2.0, 0.05, 2.0, 3, (0.0, 30.0))
SO_POWER, SLOPE = Taper(5.0, 0.5, 15.0, 29, (0.3, 1.5), "linear"), Taper(10.0, 5.0, 10.0, 19, (1.0, 55.0), "linear")


def _stretches(samples: DataFrame, by: list[str], t: str, value: str, n: int, hop: int) -> DataFrame:
    """(by, _s, _i, t, value): samples numbered from 0, in every stretch of WINDOWS windows that they take part in."""
    rows = asof.numbered(samples.select(*by, F.col(t).cast("double").alias(t), F.col(value).cast("double").alias(value)), by, t, "_i").withColumn("_i", F.col("_i").cast("long") - 1)
    first, last = F.greatest(F.ceil((F.col("_i") - n + 1) / hop), F.lit(0)), F.floor(F.col("_i") / hop)
    return rows.where(first <= last).withColumn("_s", F.explode(F.sequence(F.floor(first / WINDOWS), F.floor(last / WINDOWS))))


def spectrogram(samples: DataFrame, by: list[str], fs: float, taper: Taper = PASS_1, t: str = "t", value: str = "v") -> DataFrame:
    """samples, evenly spaced at fs -> (by, t_idx, t, power ARRAY<DOUBLE>): multitaper power densities of each window, t its
    middle after the first sample. frequencies() gives those of the array. Missing samples count as 0; recordings
    shorter than a window have none."""
    n, hop = round(taper.window * fs), max(1, round(taper.step * fs))
    nfft = taper.nfft(fs)

    def run(table):
        table = table.sort_by("_i")
        s, i = table.column("_s")[0].as_py(), table.column("_i").to_numpy()
        x = np.nan_to_num(table.column(value).to_numpy(zero_copy_only=False).astype(float))
        x = x[: n + (WINDOWS - 1) * hop] if i[0] == s * WINDOWS * hop else x
        _, _, p = spectra.multitaper(x, fs, n / fs, hop / fs, taper.bandwidth, taper.tapers, nfft, taper.detrend, taper.band)
        k = p.shape[1] if p.size else 0
        at = s * WINDOWS + np.arange(k)
        out = {c: pa.array([table.column(c)[0].as_py()] * k, table.schema.field(c).type) for c in by}
        power = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * (len(p) if k else 0)), pa.array(np.ascontiguousarray(p.T).ravel() if k else np.zeros(0)))
        return pa.table({**out, "t_idx": pa.array(at), "t": pa.array(at * hop / fs + n / 2 / fs), "power": power})

    rows = _stretches(samples, by, t, value, n, hop)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema) + ", t_idx long, t double, power array<double>"
    return rows.groupBy(*by, "_s").applyInArrow(run, kind)


def frequencies(fs: float, taper: Taper = PASS_1) -> np.ndarray:
    f = np.fft.rfftfreq(taper.nfft(fs), 1 / fs)
    return f[(f >= taper.band[0]) & (f <= taper.band[1])]


def long_form(spect: DataFrame, power: str = "power") -> DataFrame:
    """A row for each window and frequency (f_idx)."""
    return spect.select(*[c for c in spect.columns if c != power], F.posexplode(power).alias("f_idx", power))


def slope_artifacts(samples: DataFrame, by: list[str], fs: float, crit: float = -0.5, t: str = "t", value: str = "v", taper: Taper = SLOPE) -> DataFrame:
    """samples with artifact: the slope of log power over log frequency of the nearest window is above crit, or cannot be
    taken; true before the first and after the last window's middle, false where a recording has no window."""
    taper = Taper(taper.window, taper.step, taper.bandwidth, taper.tapers, (taper.band[0], min(taper.band[1], fs / 2)), taper.detrend, taper.spacing)
    f = frequencies(fs, taper)
    spect = spectrogram(samples, by, fs, taper, t, value)
    flat = long_form(spect).join(F.broadcast(samples.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(f)], "f_idx int, f double")), "f_idx")
    bad = series.slope(flat, [*by, "t_idx", "t"], "f", "power").select(*by, "t", (F.col("bad") | F.coalesce(F.col("slope") > crit, F.lit(True))).cast("double").alias("v"))
    begin = samples.groupBy(*by).agg(F.min(t).alias("_t0"))
    bad = _on(bad, begin, by).select(*by, (F.col("t") + F.col("_t0")).alias(t), F.col("v").alias(value))
    out = asof.nearest(samples, bad, by, "_bad", t, value, outside=1.0)
    some = bad.groupBy(*by).agg(F.lit(True).alias("_some"))
    return _on(out, some, by, "left").withColumn("artifact", F.coalesce(F.col("_some"), F.lit(False)) & (F.col("_bad") > 0.5)).drop("_bad", "_some")


def refine_peaks(peaks: DataFrame, samples: DataFrame, by: list[str], fs: float, window: float = 4.0, spacing: float = 0.05, band=(0.0, 30.0), t: str = "t", value: str = "v", points: int = 1000, stretch: float = 600.0) -> DataFrame:
    """peaks (by, peak_time, peak_freq, lo, hi) with refined and keep: the frequency between lo and hi at which the spline
    through the Hann spectrum of the window around the peak is highest; NULL and not kept where that is at an edge of
    the range. Peaks not strictly inside the recording by half a window keep their frequency, and are kept."""
    n = round(window * fs)
    rows = asof.numbered(samples.select(*by, F.col(t).cast("double").alias("_t"), F.col(value).cast("double").alias("_v")), by, "_t", "_i").withColumn("_i", F.col("_i").cast("long") - 1)
    span = samples.groupBy(*by).agg(F.min(t).cast("double").alias("_t0"), F.count("*").alias("_n"))
    asked = _on(peaks, span, by, "left").withColumn("_start", F.floor((F.col("peak_time") - F.col("_t0") - window / 2) * fs).cast("long"))
    length = int(stretch * fs)
    asked = asked.withColumn("_s", F.floor(F.col("_start") / length)).withColumn("_row", F.monotonically_increasing_id())
    first, last = F.floor((F.col("_i") - n + 1) / length), F.floor(F.col("_i") / length)
    dealt = rows.withColumn("_s", F.explode(F.sequence(first, last)))
    need = asked.where("_start IS NOT NULL").select(*by, "_s", "_start", "lo", "hi", "_row")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"_row": pa.array([], pa.int64()), "refined": pa.array([], pa.float64())})
        i = right.column("_i").to_numpy() if right.num_rows else np.zeros(0, np.int64)
        base = int(i.min()) if len(i) else 0
        x = np.zeros(int(i.max()) - base + 1 if len(i) else 0)
        x[i - base] = np.nan_to_num(right.column("_v").to_numpy(zero_copy_only=False).astype(float)) if len(i) else 0
        start = left.column("_start").to_numpy()
        f, p = spectra.event_spectra_at(x, fs, start - base, n, spacing, band)
        lo, hi = (left.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("lo", "hi"))
        found = [spectra.refine(f, q, a, b, points) for q, a, b in zip(p, lo, hi, strict=True)]
        return pa.table({"_row": left.column("_row"), "refined": pa.array(found, pa.float64(), from_pandas=True)})

    got = need.groupBy(*by, "_s").cogroup(dealt.groupBy(*by, "_s")).applyInArrow(run, "_row long, refined double")
    end = (F.col("_n") - 1) / fs
    inside = (F.col("peak_time") > F.col("_t0") + window / 2) & (F.col("peak_time") < end - window / 2)
    out = asked.join(got, "_row", "left")
    out = out.withColumn("refined", F.when(F.coalesce(inside, F.lit(False)), F.col("refined")).otherwise(F.col("peak_freq")))
    return out.withColumn("keep", F.col("refined").isNotNull()).select(*peaks.columns, "refined", "keep")


def phase_of(samples: DataFrame, by: list[str], sos: np.ndarray, stages: DataFrame | None = None, t: str = "t", value: str = "v", excluded: str | None = None) -> DataFrame:
    """(by, t, phase, filtered, stage): unwrapped phase of the zero-phase filtered recording; phase and filtered are NULL at
    excluded samples. stage: the one that holds at t, 0 outside the scoring, 1 without any. A recording is one group."""
    from ..kernels.filters import sosfiltfilt

    rows = samples.select(*by, F.col(t).cast("double").alias("t"), F.coalesce(finite(F.col(value).cast("double")), F.lit(0.0)).alias("v"), (F.coalesce(F.col(excluded), F.lit(False)) if excluded else F.lit(False)).alias("_x"))

    def run(table):
        table = table.sort_by("t")
        x, out = table.column("v").to_numpy(), table.column("_x").to_numpy(zero_copy_only=False)
        phase, filtered = so_phase(x, sos), sosfiltfilt(sos, x)
        hide = lambda a: pa.array(np.where(out, np.nan, a), from_pandas=True)
        return table.select([*by, "t"]).append_column("phase", hide(phase)).append_column("filtered", hide(filtered))

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema) + ", t double, phase double, filtered double"
    found = rows.groupBy(*by).applyInArrow(run, kind)
    if stages is None:
        return found.withColumn("stage", F.lit(1))
    held = stages.select(*by, "t", F.col("stage").cast("double").alias("v"))
    return asof.previous(found, held, by, "stage", 0.0).withColumn("stage", F.col("stage").cast("int"))


def power_of(spect: DataFrame, by: list[str], df: float, method: str = "p2shift1234", stages: DataFrame | None = None, samples: DataFrame | None = None, excluded: str | None = None, begin: float = 0.0, outlier_z: float = 3.0) -> DataFrame:
    """spect (by, t, power ARRAY) -> (by, t, so_power, stage): finite powers summed over frequency, in decibels, outliers out,
    normalised by the method over the stages that hold (1 without scoring); t is moved by ``begin``. With samples
    (by, t), the values are brought to their times by lines through those that are there, held at the ends, NULL at
    excluded samples."""
    rows = spect.select(*by, (F.col("t") + begin).alias("t"), "power")
    rows = series.band_power(rows, "power", 0, 1 << 20, df, "_sum").drop("power")
    staged = lambda d: d.withColumn("stage", F.lit(1)) if stages is None else asof.previous(d, stages.select(*by, "t", F.col("stage").cast("double").alias("v")), by, "stage", 0.0).withColumn("stage", F.col("stage").cast("int"))
    out = so_power(staged(rows), by, "_sum", "stage", method, outlier_z).select(*by, "t", "so_power", "stage")
    if samples is None:
        return out
    known = out.where("so_power IS NOT NULL").select(*by, "t", F.col("so_power").alias("v"))
    some = known.groupBy(*by).agg(F.lit(True).alias("_some"))
    up = asof.linear(samples.select(*by, "t", *([F.col(excluded).alias("_x")] if excluded else [])), known, by, "so_power")
    up = _on(up, some, by, "left").withColumn("so_power", F.when(F.col("_some") & (~F.coalesce(F.col("_x"), F.lit(False)) if excluded else F.lit(True)), F.col("so_power")))
    return staged(up.select(*by, "t", "so_power"))
