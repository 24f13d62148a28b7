"""From recordings to peaks, their context and histograms, in two passes, as one call.

Every step is a DataFrame operator, so all recordings go through each step together; what is used more than once is
written as Parquet in the folder that the session names for checkpoints, and read again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import asof, bins, peaks, quantile, signals
from ..operators.artifacts import artifact_mask
from ..sources.npy import phase_filter
from ..sources.shared import keep


@dataclass(frozen=True)
class Settings:
    """How a night is taken apart; the fields of Taper, extract() and so on say what they mean."""

    first: signals.Taper = signals.PASS_1
    second: signals.Taper = signals.PASS_2
    baseline_percent: float = 2.0
    baseline_stages: tuple[int, ...] = (1, 2, 3, 4, 5)
    segment_seconds: float = 30.0
    threshold: float = 11.0
    keep_volume: float = 0.8
    stride: tuple[int, int] = (2, 2)
    duration: tuple[float, float] = (0.5, 5.0)
    bandwidth: tuple[float, float] = (2.0, 15.0)
    frequency: tuple[float, float] = (0.0, math.inf)
    least_db: float = -math.inf
    refine_window: float = 4.0
    power_method: str = "p2shift1234"
    phase_band: tuple[float, float] = (0.3, 1.5)
    power_taper: signals.Taper = signals.SO_POWER
    power_bins: bins.Bins = field(default_factory=lambda: bins.Bins(0.0, 0.5, 5.0, 60))
    phase_bins: bins.Bins = field(default_factory=lambda: bins.Bins(-math.pi, 2 * math.pi / 100, 2 * math.pi / 5, 100, 2 * math.pi))
    frequency_bins: bins.Bins = field(default_factory=lambda: bins.Bins(4.0, 0.2, 1.0, 60))
    least_minutes: float = 1.0


@dataclass(frozen=True)
class Night:
    """peaks (rec, peak_id, ...), samples' context (rec, t, stage, excluded), and two histograms of all recordings."""

    peaks: DataFrame
    context: DataFrame
    power: bins.Histogram
    phase: bins.Histogram


def _pass(px_source: DataFrame, taper: signals.Taper, fs: float, begin: DataFrame) -> DataFrame:
    """(rec, t_idx, t, f_idx, power) of one spectrogram, in time of the recording."""
    spect = signals.spectrogram(px_source, ["rec"], fs, taper)
    spect = quantile._on(spect, begin, ["rec"]).withColumn("t", F.col("t") + F.col("_t0")).drop("_t0")
    return signals.long_form(spect)


def night(samples: DataFrame, stages: DataFrame, fs: float, settings: Settings = Settings(), filters: str | None = None) -> Night:
    """samples (rec, t, v) at fs per second, stages (rec, t, stage) -> Night.

    1. artifacts; samples are excluded that are artifacts or in a stage that the baseline leaves out;
    2. first spectrogram, its baseline over columns that are not excluded, and its regions;
    3. second spectrogram where the first had regions, over the same baseline's percentile of its own, and its peaks;
    4. refined frequencies; stage, slow-oscillation power and phase at each peak; histograms over both."""
    spark, s = samples.sparkSession, settings
    samples = samples.select("rec", F.col("t").cast("double").alias("t"), F.col("v").cast("double").alias("v"))
    begin = samples.groupBy("rec").agg(F.min("t").alias("_t0"))
    mask = artifact_mask(samples, ["rec"], "t", "v", fs)
    staged = asof.previous(mask, stages.select("rec", "t", F.col("stage").cast("double").alias("v")), ["rec"], "stage", 0.0)
    context = keep(spark, staged.select("rec", "t", "artifact", F.col("stage").cast("int").alias("stage"), (F.col("artifact") | ~F.col("stage").cast("int").isin(*s.baseline_stages)).alias("excluded")), "context")
    excluded = context.select("rec", "t", F.col("excluded").cast("double").alias("v"))

    def baseline(px: DataFrame) -> DataFrame:
        columns = px.select("rec", "t_idx", "t").distinct()
        good = asof.nearest(columns, excluded, ["rec"], "x").select("rec", "t_idx", (F.col("x") < 0.5).alias("valid"))
        return quantile.baseline(px.join(good, ["rec", "t_idx"]), ["rec", "f_idx"], "power", s.baseline_percent / 100, "valid")

    def found(px: DataFrame, taper: signals.Taper) -> tuple[peaks.Extraction, DataFrame]:
        df = fs / taper.nfft(fs)
        f0 = float(signals.frequencies(fs, taper)[0])
        step = max(1, round(taper.step * fs)) / fs
        out = peaks.extract(px, step, df, taper.window / 2, f0, keep(spark, baseline(px), "baseline"), max(2, round(s.segment_seconds / step)), s.duration, s.bandwidth, s.frequency, s.least_db, threshold=s.threshold, keep=s.keep_volume, stride=s.stride)
        return out, px

    one = keep(spark, _pass(samples, s.first, fs, begin), "first")
    first, _ = found(one, s.first)
    kept = keep(spark, first.labels.select("rec", "segment", "t_idx", "f_idx", "label"), "labels")
    labels = one.select("rec", "t", "t_idx", "f_idx").join(kept, ["rec", "t_idx", "f_idx"], "left")
    step = max(1, round(s.first.step * fs)) / fs
    labels = labels.withColumns({"label": F.coalesce("label", F.lit(0)), "segment": F.coalesce("segment", (F.floor(F.col("t_idx") / max(2, round(s.segment_seconds / step))) + 1).cast("int"))})
    ratio = (fs / s.second.nfft(fs)) / (fs / s.first.nfft(fs))
    two = _pass(samples, s.second, fs, begin)
    two = two.withColumn("_own", F.col("f_idx")).withColumn("f_idx", F.round(F.col("f_idx") * ratio).cast("long"))
    two = peaks.mask_second_pass(two, labels).withColumn("f_idx", F.col("_own")).drop("_own")
    second, _ = found(keep(spark, two, "second"), s.second)
    table = keep(spark, quantile._on(second.peaks, begin, ["rec"]).withColumn("peak_time", F.col("peak_time") + F.col("_t0")).drop("_t0"), "peaks")
    around = table.withColumns({"lo": F.col("bbox_f"), "hi": F.col("bbox_f") + F.col("bandwidth")})
    table = signals.refine_peaks(around, samples, ["rec"], fs, s.refine_window).where("keep").withColumn("peak_freq", F.col("refined")).drop("refined", "keep", "lo", "hi")

    power = signals.power_of(signals.spectrogram(samples, ["rec"], fs, s.power_taper), ["rec"], fs / s.power_taper.nfft(fs), s.power_method, stages, samples.join(context.select("rec", "t", "excluded"), ["rec", "t"]), "excluded")
    power = keep(spark, power, "so_power")
    sos = phase_filter(spark, fs, s.phase_band, filters)
    phase = keep(spark, signals.phase_of(samples.join(context.select("rec", "t", "excluded"), ["rec", "t"]), ["rec"], np.asarray(sos), stages, excluded="excluded"), "so_phase")

    at = table.withColumn("t", F.col("peak_time"))
    at = asof.previous(at, stages.select("rec", "t", F.col("stage").cast("double").alias("v")), ["rec"], "stage", 0.0)
    at = asof.linear_padded(at, power.select("rec", "t", F.col("so_power").alias("v")), ["rec"], "so_power")
    at = asof.linear_padded(at, phase.select("rec", "t", F.col("phase").alias("v")), ["rec"], "_phase")
    from ..functions import wrap_to_pi

    table = keep(spark, at.withColumns({"stage": F.col("stage").cast("int"), "so_phase": wrap_to_pi(F.col("_phase"))}).drop("t", "_phase"), "attached")
    valid = F.col("stage").isin(*s.baseline_stages)
    of = lambda c, d: d.select(c.alias("c"), "stage", (valid & c.isNotNull()).alias("valid"), c.isNotNull().alias("valid_all"))
    hist = lambda c, p, d, b: bins.stage_histogram(p.select(F.col(c).alias("c"), F.col("peak_freq").alias("f")), d, b, s.frequency_bins, 1 / fs, least_minutes=s.least_minutes)
    return Night(table, context, hist("so_power", table, of(F.col("so_power"), power), s.power_bins), hist("so_phase", table, of(wrap_to_pi(F.col("phase")), phase), s.phase_bins))


__all__ = ["Night", "Settings", "night"]
