"""Tables of peaks as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import round_sig, time_digits

#: The columns of the file, in order.
COLUMNS = ("PeakTime", "PeakFrequency", "Duration", "Bandwidth", "Height", "Volume", "SegmentNum", "Area", "Peakiness", "bbox_tl_s", "bbox_tl_Hz", "PeakStage", "SOpower", "SOphase")
TIMES, FREQUENCIES = ("PeakTime", "Duration", "bbox_tl_s"), ("PeakFrequency", "Bandwidth", "bbox_tl_Hz", "SOphase")


def formatted(peaks: DataFrame, fs: float) -> DataFrame:
    """The columns of the file at their significant digits; a missing stage is 0, a missing power or phase NaN."""
    digits = {c: time_digits(F.lit(float(fs))) for c in TIMES} | {c: F.lit(4) for c in FREQUENCIES}
    out = []
    for c in COLUMNS:
        if c == "PeakStage":
            out.append(F.coalesce(F.col(c), F.lit(0)).alias(c))
        elif c == "SegmentNum":
            out.append(F.col(c))
        else:
            x = F.coalesce(F.col(c), F.lit(float("nan"))) if c.startswith("SO") else F.col(c)
            out.append(round_sig(x, digits.get(c, F.lit(3))).alias(c))
    return peaks.select(*out)


FORMAT = 3


def preamble(writer: str, writer_version: str, kernel_version: str, semantics: str | None = None, subject: str | None = None) -> list[str]:
    """Lines before the header that tell where a table comes from."""
    out = ["# peaks table", f"# format: {FORMAT}", f"# writer: {writer}", f"# writer_version: {writer_version}", f"# kernel_version: {kernel_version}"]
    out += [f"# semantics: {semantics}"] if semantics else []
    return out + ([f"# subjectID: {subject}"] if subject else [])


def lines(peaks: DataFrame, fs: float, head: list[str] | None = None, order: str = "SegmentNum") -> DataFrame:
    """(n, value): the file's lines in order: the preamble, the names of the columns, a line a peak."""
    table = formatted(peaks, fs)
    text = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in COLUMNS))
    body = table.select((F.row_number().over(Window.orderBy(order, "PeakTime", "PeakFrequency")) + 0).cast("long").alias("n"), text.alias("value"))
    first = [*(head or []), ",".join(COLUMNS)]
    begin = peaks.sparkSession.createDataFrame([(i - len(first) + 1, x) for i, x in enumerate(first)], "n long, value string")
    return begin.unionByName(body)


def write_peaks(peaks: DataFrame, path: str, fs: float, head: list[str] | None = None) -> None:
    """One CSV file (a table of peaks has thousands of rows a night) with the preamble ``head`` before its header; without
    it, files of Spark's CSV writer, as many as the table has partitions."""
    if head is None:
        formatted(peaks, fs).write.option("header", True).csv(path)
    else:
        lines(peaks, fs, head).orderBy("n").coalesce(1).select("value").write.text(path)


def read_peaks(spark: SparkSession, path) -> DataFrame:
    """A table of peaks as written, with or without a preamble."""
    kinds = ", ".join(f"{c} {'int' if c in ('PeakStage', 'SegmentNum') else 'double'}" for c in COLUMNS)
    return spark.read.option("header", True).option("comment", "#").schema(kinds).csv(path)
