"""Queries of sources and sinks: files are made of the stand-in tables and read back, and their SQL tells what must come."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .operators import colours
from .plans import channels
from .queries import IMAGE_SQL, S_SQL, R, image, query, samples
from .sources import edf, npy, peaks_csv, staging

# --- recordings -------------------------------------------------------------------------------------------------------

PER_RECORD = {"click": 2, "error": 1, "purchase": 3, "signup": 1, "view": 4}


def _recordings(spark, sf):
    """One recording a user, a channel an event type, its values in order of time, as the bytes of a file."""

    def run(table):
        table = table.sort_by([("t", "ascending"), ("event_id", "ascending")])
        ch, v = np.array(table.column("ch").to_pylist()), table.column("v").to_numpy()
        signals = {c: v[ch == c] for c in sorted(set(ch))}
        content = edf.encode_edf(signals, {c: PER_RECORD.get(c, 1) for c in signals}, (0.0, 500.0), 2.0)
        return pa.table({"path": [f"u{table.column('user_id')[0].as_py()}.edf"], "content": pa.array([content], pa.binary())})

    e = spark.read.parquet(f"{sf}/events.parquet")
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 1e6
    return e.select("user_id", "event_id", F.col("event_type").alias("ch"), t.alias("t"), F.col("value").alias("v")).groupBy("user_id").applyInArrow(run, "path string, content binary")


FILES = f"""WITH e AS (SELECT user_id, event_type AS ch, value AS v, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS i FROM events),
 w AS (SELECT * FROM (VALUES {", ".join(f"('{c}', {n})" for c, n in PER_RECORD.items())}) x(ch, per)), k AS (SELECT user_id, ch, count(*) AS n, coalesce(any_value(per), 1) AS per FROM e LEFT JOIN w USING (ch) GROUP BY ALL),
 r AS (SELECT user_id, max(ceil(n / per))::BIGINT AS records FROM k GROUP BY user_id), g AS (SELECT user_id, ch, per, records, unnest(range(0, per * records)) AS i FROM k JOIN r USING (user_id)),
 x AS (SELECT g.user_id, ch, per, i, round(greatest(0, least(65535, round_even((coalesce(v, 0) - 0) / (500.0::DOUBLE / 65535), 0))) * (500.0::DOUBLE / 65535), 4) + 0.0 AS x FROM g LEFT JOIN e USING (user_id, ch, i))"""


@query(f"{FILES} SELECT 'u' || user_id || '.edf' AS path, ch, records, 2.0 AS duration, per AS per_record, per / 2.0 AS fs, '01.01.24' AS start_date FROM k JOIN r USING (user_id)")
def edf_headers(spark, sf):
    return edf.decode_headers(_recordings(spark, sf)).select("path", "ch", "records", "duration", "per_record", "fs", "start_date")


def _flat(chunks):
    out = chunks.select("path", "ch", "t0", "fs", F.posexplode("x").alias("j", "x"))
    return out.select("path", "ch", (F.round(F.col("t0") * F.col("fs")).cast("long") + F.col("j")).alias("i"), (F.round("x", 4) + 0.0).alias("x"))


@query(f"{FILES} SELECT 'u' || user_id || '.edf' AS path, ch, i, x FROM x")
def edf_samples(spark, sf):
    return _flat(edf.decode_samples(_recordings(spark, sf), chunk_seconds=6.0))


@query(f"{FILES} SELECT 'u' || user_id || '.edf' AS path, ch, i, x FROM x WHERE ch IN ('view', 'click')")
def edf_projected(spark, sf):
    return _flat(edf.decode_samples(_recordings(spark, sf), [" VIEW", "click", "nothing"], 6.0))


# --- stages -----------------------------------------------------------------------------------------------------------

NAMES = ["Wake", "W", "5", "rem", "R", "n1", "stage 1", "N2", "Stage 3", "a", "unk", "movement"]
CODES = [5, 5, 5, 4, 4, 3, 3, 2, 1, 6, 0, None]
CODE_SQL = "[" + ", ".join("NULL" if c is None else str(c) for c in CODES) + "]"
LINES = f"""e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 % 86400 AS clock, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS line, ({CODE_SQL})[event_id % 12 + 1] AS stage FROM events)"""


def _lines(spark, sf, value):
    e = spark.read.parquet(f"{sf}/events.parquet")
    second = F.floor(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 1000000)
    from pyspark.sql import Window

    line = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("event_id") % 12 + 1).cast("int"))
    return e.withColumn("clock", F.pmod(second, F.lit(86400))).withColumn("line", line).select(F.col("user_id").cast("string").alias("path"), "line", value(name).alias("value"))


@query(f"""WITH {LINES}, b AS (SELECT *, first_value(clock) OVER (PARTITION BY user_id ORDER BY line) AS begin, lag(clock) OVER (PARTITION BY user_id ORDER BY line) AS before FROM e),
 d AS (SELECT *, sum(CASE WHEN clock < coalesce(before, begin) THEN 86400.0::DOUBLE ELSE 0 END) OVER (PARTITION BY user_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS days FROM b)
SELECT user_id::VARCHAR AS path, line::INTEGER AS line, clock + days - begin AS t, stage FROM d WHERE stage IS NOT NULL""")
def staging_clock(spark, sf):
    """Clock strings with quoted fields; names in every spelling; two events of one second are two rows."""
    clock = F.format_string("%02d:%02d:%02d", F.floor(F.col("clock") / 3600), F.floor(F.col("clock") % 3600 / 60), F.col("clock") % 60)
    return staging.parse_staging(_lines(spark, sf, lambda name: F.concat(F.lit('"a, b", '), clock, F.lit(' ,"'), name, F.lit('"'))), time_col=2, stage_col=3, unique=False)


@query(f"WITH {LINES} SELECT user_id::VARCHAR AS path, line::INTEGER AS line, (line + 1) * 20.0 AS t, stage FROM e WHERE stage IS NOT NULL AND (SELECT count(*) FROM e x WHERE x.user_id = e.user_id) > 1")
def staging_epochs(spark, sf):
    """Epoch numbers from 1, of 20 seconds."""
    from pyspark.sql import Window

    lines = _lines(spark, sf, lambda name: F.concat((F.col("line") + 1).cast("string"), F.lit(";"), name))
    lines = lines.withColumn("n", F.count("*").over(Window.partitionBy("path"))).where("n > 1").drop("n")
    return staging.parse_staging(lines, delimiter=";", epoch_seconds=20.0)


# --- arrays and tables of peaks ---------------------------------------------------------------------------------------


@query(f"WITH i AS ({IMAGE_SQL}) SELECT (t_idx // 100)::VARCHAR AS path, (t_idx % 100) AS row, f_idx AS col, round(power, 6) + 0.0 AS x FROM i")
def npy_arrays(spark, sf):
    def run(table):
        order = np.argsort(table.column("r").to_numpy())
        a = np.array(table.column("embedding").to_pylist(), float)[order]
        out = io.BytesIO()
        np.save(out, np.exp(10 * a))
        return pa.table({"path": [str(table.column("b")[0].as_py())], "content": pa.array([out.getvalue()], pa.binary())})

    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.floor(F.col("vec_id") / 100).alias("b"), (F.col("vec_id") % 100).alias("r"), "embedding")
    rows = npy.decode_npy(e.groupBy("b").applyInArrow(run, "path string, content binary"))
    return rows.select("path", "row", F.posexplode("x").alias("col", "x")).select("path", "row", "col", R(F.col("x")).alias("x"))


LABELS = f"l AS (SELECT t_idx // 50 AS rec, t_idx % 50 AS t_idx, f_idx, (t_idx * 7 + f_idx) % 6 AS label FROM ({IMAGE_SQL}))"


def _labels(spark, sf):
    return image(spark, sf).select(F.floor(F.col("t_idx") / 50).alias("rec"), (F.col("t_idx") % 50).alias("t_idx"), "f_idx", ((F.col("t_idx") * 7 + F.col("f_idx")) % 6).alias("label"))


@query(f"WITH {LABELS} SELECT rec::VARCHAR AS path, f_idx::BIGINT AS f_idx, t_idx::INTEGER AS t_idx, label::DOUBLE AS label FROM l")
def npy_labels(spark, sf):
    files = npy.encode_labels(_labels(spark, sf)).select(F.col("rec").cast("string").alias("path"), "content")
    return npy.decode_npy(files).select("path", F.col("row").alias("f_idx"), F.posexplode("x").alias("t_idx", "label"))


JET = "CASE WHEN t IS NULL THEN 0 ELSE round(greatest(0.0, least(1.0, 1.5 - abs(4 * (t - {})))) * 255) END::INTEGER"


@query(f"""WITH {LABELS}, k AS (SELECT rec, label, row_number() OVER (PARTITION BY rec ORDER BY label) - 1 AS r, count(*) OVER (PARTITION BY rec) AS n FROM (SELECT DISTINCT rec, label FROM l WHERE label > 0)),
 c AS (SELECT rec, label, CASE WHEN n = 1 THEN 0.5 ELSE (r * 2654435761 % n) / (n - 1)::DOUBLE END AS t FROM k)
SELECT l.rec, t_idx, f_idx, {JET.format(0.75)} AS red, {JET.format(0.5)} AS green, {JET.format(0.25)} AS blue FROM l LEFT JOIN c USING (rec, label)""")
def label_colours(spark, sf):
    return colours.label_colours(_labels(spark, sf), ["rec"]).select("rec", "t_idx", "f_idx", "red", "green", "blue")


def _sig(x: str, digits: str) -> str:
    return f"CASE WHEN {x} = 0 THEN 0 ELSE round({x} * pow(10.0::DOUBLE, {digits} - 1 - floor(log10(abs({x}))))) / pow(10.0::DOUBLE, {digits} - 1 - floor(log10(abs({x})))) END"


@query(f"""WITH p AS (SELECT l_orderkey AS "SegmentNum", l_extendedprice / 7 AS t, l_quantity / 3 AS f, l_tax AS h FROM lineitem)
SELECT "SegmentNum", {_sig('t', '8')} AS "PeakTime", {_sig('f', '4')} AS "PeakFrequency", {_sig('t / 9', '8')} AS "Duration", {_sig('h', '3')} AS "Height", 0 AS "PeakStage", 'NaN'::DOUBLE AS "SOpower", {_sig('h', '4')} AS "SOphase" FROM p""")
def peaks_csv_digits(spark, sf):
    """The columns of the file at their digits for 100 samples a second."""
    l = spark.read.parquet(f"{sf}/lineitem.parquet")
    t, f, h = F.col("l_extendedprice") / 7, F.col("l_quantity") / 3, F.col("l_tax") + 0.0
    values = {"PeakTime": t, "PeakFrequency": f, "Duration": t / 9, "Bandwidth": f, "Height": h, "Volume": h, "SegmentNum": F.col("l_orderkey"), "Area": h, "Peakiness": h, "bbox_tl_s": t, "bbox_tl_Hz": f, "PeakStage": F.lit(None).cast("int"), "SOpower": F.lit(None).cast("double"), "SOphase": h}
    out = peaks_csv.formatted(l.select(*(v.alias(c) for c, v in values.items())), 100.0)
    return out.select("SegmentNum", "PeakTime", "PeakFrequency", "Duration", "Height", "PeakStage", "SOpower", "SOphase")


@query(f"""WITH {S_SQL}, c AS (SELECT user_id, floor(t / 3600) AS h, avg(v) FILTER (WHERE ch = 'view') AS a, avg(v) FILTER (WHERE ch = 'click') AS b, avg(v) FILTER (WHERE ch = 'error') AS e FROM s GROUP BY ALL)
SELECT user_id, h, round(0.5 * a - (b + e) / 2, 6) + 0.0 AS x FROM c WHERE a IS NOT NULL OR b IS NOT NULL OR e IS NOT NULL""")
def channel_expression(spark, sf):
    """0.5 VIEW - R with R = mean(click, error, missing), over hourly means of channels."""
    s = samples(spark, sf).groupBy("user_id", F.floor(F.col("t") / 3600).alias("h"), "ch").agg(F.avg("v").alias("x"))
    weights = channels.select("0.5*view - R", ["view", "click", "error", "purchase"], {"R": "mean(click, error, missing)"})
    return channels.evaluate(s, weights, ["user_id", "h"]).select("user_id", "h", R(F.col("x")).alias("x"))
