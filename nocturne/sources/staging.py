"""Stage files: delimited text of times and stage names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clock_seconds

#: Names of the stages, lower case, and their codes.
STAGES = {
    "art": 6, "artifact": 6, "a": 6, "6": 6,
    "wake": 5, "w": 5, "5": 5,
    "rem": 4, "r": 4, "4": 4,
    "n1": 3, "stage 1": 3, "1": 3,
    "n2": 2, "stage 2": 2, "2": 2,
    "n3": 1, "stage 3": 1, "3": 1,
    "unk": 0, "u": 0, "unknown": 0, "0": 0,
}


def stage_names(custom: dict[int, list[str]] | None = None) -> dict[str, int]:
    """Names to codes: the defaults, or, if all seven codes are given names, those."""
    if custom and set(custom) == set(STAGES.values()):
        return {n.strip().lower(): code for code, names in custom.items() for n in names if n.strip()}
    return STAGES


def read_staging(spark: SparkSession, path, **options) -> DataFrame:
    """parse_staging() of text files."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    return parse_staging(rows, **options)


def parse_staging(lines: DataFrame, time_col: int = 1, stage_col: int = 2, header_lines: int = 0, delimiter: str = ",", epoch_seconds: float = 30.0, start_time: str | None = None, aliases: dict[str, int] | None = None, recording_seconds: float | None = None, names: dict[int, list[str]] | None = None, unique: bool = True) -> DataFrame:
    """lines (path, line from 0, value) -> (path, line, t, stage): t in seconds from the start of the recording.

    Times are numbers if all of them are, else clock strings. Numbers are epochs if they are whole, in order and the upper
    median of their steps is 1, else seconds. Clocks are taken from start_time, or from the first one, a day on where
    they fall back. Names that are no stage drop the line; two stages at one time are an error, or both rows where times need
    not be ``unique``. Fields may be quoted, and hold the delimiter then; quotes and spaces around them are taken off. With start_time, unknown (0) holds from 0 to
    the first stage. A clock that begins before start_time is of the next day; with recording_seconds, if that is past
    the recording's end, ValueError is raised."""
    known = stage_names(names) | {k.lower(): v for k, v in (aliases or {}).items()}
    rows = lines.where((F.col("line") >= header_lines) & (F.trim("value") != ""))
    outside = f'\\Q{delimiter}\\E(?=(?:[^"]*"[^"]*")*[^"]*$)'
    field = lambda i: F.trim(F.regexp_replace(F.get(F.split("value", outside), F.lit(i - 1)), '"', ""))
    code = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    rows = rows.select("path", "line", field(time_col).alias("raw"), F.try_element_at(code, F.lower(field(stage_col))).alias("stage"))
    w = Window.partitionBy("path").orderBy("line")
    rows = rows.withColumn("clock", clock_seconds(F.col("raw"))).withColumn("number", F.col("raw").try_cast("double"))
    begin = F.first("clock", True).over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    if start_time is not None:
        begin = clock_seconds(F.lit(start_time))
    rows = rows.withColumn("begin", begin).withColumn("before", F.coalesce(F.lag("clock").over(w), F.col("begin")))
    days = F.sum(F.when(F.col("clock") < F.col("before"), 86400.0).otherwise(0.0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("elapsed", F.col("clock") + days - F.col("begin"))
    if start_time is not None and recording_seconds is not None:
        first = rows.where("elapsed IS NOT NULL").groupBy("path").agg(F.min_by("elapsed", "line").alias("t")).where(F.col("t") > recording_seconds)
        if (bad := first.limit(1).collect()):
            raise ValueError(f"{bad[0]['path']}: staging begins earlier than the recording start time")
    rows = rows.withColumn("gap", F.col("number") - F.lag("number").over(w))
    facts = rows.groupBy("path").agg(F.every(F.col("number").isNotNull()).alias("numeric"), (F.every(F.col("number") % 1 == 0) & F.every(F.coalesce(F.col("gap"), F.lit(0.0)) >= 0)).alias("whole"))
    ranked = rows.where("gap IS NOT NULL").withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("gap"))).withColumn("n", F.count("*").over(Window.partitionBy("path")))
    middle = ranked.where("k = floor(n / 2) + 1").select("path", F.col("gap").alias("median"))
    rows = rows.join(facts, "path").join(middle, "path", "left")
    number = F.when(F.col("whole") & F.coalesce(F.col("median") == 1, F.lit(False)), F.col("number") * epoch_seconds).otherwise(F.col("number"))
    out = rows.where("stage IS NOT NULL").select("path", "line", F.when(F.col("numeric"), number).otherwise(F.col("elapsed")).alias("t"), "stage").where("t IS NOT NULL")
    if start_time is not None:
        first = out.groupBy("path").agg(F.min_by("t", "line").alias("t")).where("t <> 0")
        out = out.unionByName(first.select("path", F.lit(-1).alias("line"), F.lit(0.0).alias("t"), F.lit(0).alias("stage")))
    if not unique:
        return out
    twice = F.col("t") == F.lag("t").over(Window.partitionBy("path").orderBy("line"))
    return out.withColumn("_twice", F.coalesce(twice, F.lit(False))).withColumn("t", F.when(F.col("_twice"), F.raise_error(F.lit("two stages at one time")).cast("double")).otherwise(F.col("t"))).drop("_twice")
