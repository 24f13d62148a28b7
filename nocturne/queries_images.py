"""Queries of the operators on images, recordings as spectra, and their SQL.

Images are blocks of 40 columns of the image of embeddings; labels are rectangles in it or what a threshold leaves.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from .kernels import spectra
from .operators import images, peaks, series, signals
from .queries import IMAGE_SQL, R, _spect, hazen_sql, image, query

EIGHT = "(VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) d(df, dt)"
PX = f"px AS (SELECT t_idx // 40 AS rec, f_idx::BIGINT AS f_idx, t_idx % 40 AS t_idx, power FROM ({IMAGE_SQL}))"
#: Rectangles of 4 by 5 pixels with lines of one pixel between them, numbered along the rows; 0 between.
BOX = "CASE WHEN f_idx % 5 < 4 AND t_idx % 6 < 5 THEN f_idx // 5 * 7 + t_idx // 6 + 1 ELSE 0 END"


def blocks(spark, sf):
    return image(spark, sf).select(F.floor(F.col("t_idx") / 40).alias("rec"), "f_idx", (F.col("t_idx") % 40).alias("t_idx"), "power")


def boxes(spark, sf):
    return blocks(spark, sf).withColumn("label", F.expr("CASE WHEN f_idx % 5 < 4 AND t_idx % 6 < 5 THEN f_idx div 5 * 7 + t_idx div 6 + 1 ELSE 0 END"))


@query(f"""WITH RECURSIVE {PX}, on_ AS (SELECT rec, f_idx, t_idx, t_idx * 64 + f_idx AS place FROM px WHERE power > 4),
 reach AS (SELECT rec, place AS root, f_idx, t_idx FROM on_ UNION SELECT r.rec, r.root, o.f_idx, o.t_idx FROM reach r, {EIGHT}, on_ o WHERE o.rec = r.rec AND o.f_idx = r.f_idx + df AND o.t_idx = r.t_idx + dt),
 low AS (SELECT rec, f_idx, t_idx, min(root) AS root FROM reach GROUP BY ALL), n AS (SELECT *, dense_rank() OVER (PARTITION BY rec ORDER BY root) AS label FROM low)
SELECT px.rec, f_idx, t_idx, coalesce(label, 0) AS label FROM px LEFT JOIN n USING (rec, f_idx, t_idx)""")
def image_components(spark, sf):
    return images.components(blocks(spark, sf).withColumn("on", F.col("power") > 4), "on")


FLOORS = "fl AS (SELECT rec, f_idx, t_idx, floor(power) AS v, t_idx * 64 + f_idx AS place FROM px)"


@query(f"""WITH RECURSIVE {PX}, {FLOORS}, low AS (SELECT a.rec, a.place FROM fl a, {EIGHT}, fl b WHERE b.rec = a.rec AND b.f_idx = a.f_idx + df AND b.t_idx = a.t_idx + dt AND b.v < a.v GROUP BY ALL),
 bad AS (SELECT rec, place FROM low UNION SELECT b.rec, b.place FROM bad JOIN fl a ON a.rec = bad.rec AND a.place = bad.place, {EIGHT}, fl b WHERE b.rec = a.rec AND b.f_idx = a.f_idx + df AND b.t_idx = a.t_idx + dt AND b.v = a.v)
SELECT fl.rec, f_idx, t_idx, bad.place IS NULL AS minimum FROM fl LEFT JOIN bad ON bad.rec = fl.rec AND bad.place = fl.place""")
def image_minima(spark, sf):
    """Minima of the image in whole steps, so plateaus are many."""
    return images.minima(blocks(spark, sf).withColumn("v", F.floor("power").cast("double")), "v")


@query(f"""WITH {PX}, l AS (SELECT rec, f_idx, t_idx, CASE WHEN power > 4 THEN f_idx // 4 * 10 + t_idx // 4 + 1 ELSE 0 END AS label FROM px), k AS (SELECT rec, label, row_number() OVER (PARTITION BY rec ORDER BY label) AS r FROM (SELECT DISTINCT rec, label FROM l WHERE label > 0)),
 n AS (SELECT rec, f_idx, t_idx, coalesce(r, 0) AS r FROM l LEFT JOIN k USING (rec, label)) SELECT a.rec, a.f_idx, a.t_idx, greatest(a.r, coalesce(max(b.r), 0)) AS label FROM n a LEFT JOIN (SELECT rec, f_idx + df AS f_idx, t_idx + dt AS t_idx, r FROM n, {EIGHT}) b USING (rec, f_idx, t_idx) GROUP BY a.rec, a.f_idx, a.t_idx, a.r""")
def image_paint(spark, sf):
    label = F.expr("CASE WHEN power > 4 THEN f_idx div 4 * 10 + t_idx div 4 + 1 ELSE 0 END")
    return images.paint(blocks(spark, sf).withColumn("label", label))


@query(f"""WITH {PX}, l AS (SELECT rec, f_idx, t_idx, {BOX} AS label FROM px), s AS (SELECT rec, max(t_idx) + 1 AS w FROM px GROUP BY rec),
 g AS (SELECT rec, f, t, least(greatest(floor((f + 1) / (100.0::DOUBLE / 64) + 0.5 * (1 - 1 / (100.0::DOUBLE / 64)) + 0.5), 1), 64) - 1 AS f_idx, least(greatest(floor((t + 1) / (90.0::DOUBLE / w) + 0.5 * (1 - 1 / (90.0::DOUBLE / w)) + 0.5), 1), w) - 1 AS t_idx FROM s, range(100) x(f), range(90) y(t))
SELECT g.rec, f AS f_idx, t AS t_idx, label FROM g JOIN l USING (rec, f_idx, t_idx)""")
def image_resize(spark, sf):
    return images.resize(boxes(spark, sf), 100, 90)


@query(f"""WITH {PX}, l AS (SELECT rec, f_idx, t_idx, {BOX} AS label, f_idx % 5 AS y, t_idx % 6 AS x FROM px), e AS (SELECT rec, label, max(t_idx) AS t1, max(f_idx) AS f1 FROM l WHERE label > 0 GROUP BY ALL)
SELECT l.rec, f_idx, t_idx, l.label > 0 AND (y = 0 OR x = 0 OR f_idx = f1 OR t_idx = t1) AS contour FROM l LEFT JOIN e ON e.rec = l.rec AND e.label = l.label""")
def image_contours(spark, sf):
    return images.contours(boxes(spark, sf))


@query(f"""WITH {PX}, l AS (SELECT rec, f_idx, t_idx, {BOX} AS label FROM px), b AS (SELECT DISTINCT a.rec, a.label, o.f_idx, o.t_idx FROM l a, {EIGHT}, l o WHERE a.label > 0 AND o.rec = a.rec AND o.f_idx = a.f_idx + df AND o.t_idx = a.t_idx + dt AND o.label <> a.label),
 q AS (SELECT DISTINCT a.rec, a.label, o.label AS other FROM l a, (SELECT i - 2 AS df, j - 2 AS dt FROM range(5) x(i), range(5) y(j)) d, l o WHERE a.label > 0 AND o.label > 0 AND o.rec = a.rec AND o.f_idx = a.f_idx + df AND o.t_idx = a.t_idx + dt AND o.label <> a.label)
SELECT rec, label, (SELECT count(*) FROM l x WHERE x.rec = i.rec AND x.label = i.label) AS inside, (SELECT count(*) FROM b WHERE b.rec = i.rec AND b.label = i.label) AS border, (SELECT count(*) FROM q WHERE q.rec = i.rec AND q.label = i.label) AS near FROM (SELECT DISTINCT rec, label FROM l WHERE label > 0) i""")
def region_graph(spark, sf):
    return images.regions_of_graph(boxes(spark, sf))


@query(f"""WITH {PX}, l AS (SELECT rec, f_idx, t_idx, power, {BOX} AS label FROM px), b AS MATERIALIZED (SELECT DISTINCT a.rec, a.label, o.f_idx, o.t_idx, o.power FROM l a, {EIGHT}, l o WHERE a.label > 0 AND o.rec = a.rec AND o.f_idx = a.f_idx + df AND o.t_idx = a.t_idx + dt AND o.label <> a.label),
 m AS MATERIALIZED (SELECT rec, label, min(power) AS low FROM b GROUP BY ALL), h AS MATERIALIZED (SELECT rec, label, max(power) AS top FROM (SELECT rec, label, power FROM b UNION ALL SELECT rec, label, power FROM l WHERE label > 0) GROUP BY ALL),
 s AS (SELECT x.rec, x.label AS a, y.label AS b, max(x.power) AS shared FROM b x JOIN b y ON x.rec = y.rec AND x.f_idx = y.f_idx AND x.t_idx = y.t_idx AND x.label < y.label GROUP BY ALL)
SELECT s.rec, a, b, round(2 * shared + greatest(-ma.low - hb.top, -mb.low - ha.top), 6) + 0.0 AS weight FROM s JOIN m ma ON ma.rec = s.rec AND ma.label = a JOIN m mb ON mb.rec = s.rec AND mb.label = b JOIN h ha ON ha.rec = s.rec AND ha.label = a JOIN h hb ON hb.rec = s.rec AND hb.label = b""")
def edge_weights(spark, sf):
    return images.adjacency(boxes(spark, sf), value="power").select("rec", "a", "b", R(F.col("weight")).alias("weight"))


W1, W2 = ([math.exp(-0.5 * (i / s) ** 2) for i in range(-math.ceil(2 * s), math.ceil(2 * s) + 1)] for s in (1.0, 1.5))


def _weights(w) -> str:
    return "(VALUES " + ", ".join(f"({i - len(w) // 2}, {x / sum(w)!r}::DOUBLE)" for i, x in enumerate(w)) + ")"


@query(f"""WITH {PX}, s AS (SELECT rec, max(t_idx) AS last FROM px GROUP BY rec), r AS (SELECT a.rec, a.f_idx, a.t_idx, sum(w * b.power) AS v FROM px a, {_weights(W1)} k(d, w), px b WHERE b.rec = a.rec AND b.t_idx = a.t_idx AND b.f_idx = least(greatest(a.f_idx + d, 0), 63) GROUP BY ALL)
SELECT a.rec, a.f_idx, a.t_idx, round(sum(w * b.v), 6) + 0.0 AS value FROM r a JOIN s USING (rec), {_weights(W2)} k(d, w), r b WHERE b.rec = a.rec AND b.f_idx = a.f_idx AND b.t_idx = least(greatest(a.t_idx + d, 0), last) GROUP BY ALL""")
def image_smooth(spark, sf):
    return images.smooth(blocks(spark, sf), 1.0, 1.5, "power").select("rec", "f_idx", "t_idx", R(F.col("value")).alias("value"))


@query(f"""WITH {PX}, l AS (SELECT rec, f_idx, t_idx, {BOX} AS label, f_idx % 5 AS y, t_idx % 6 AS x FROM px), e AS (SELECT rec, label, max(t_idx) AS t1, max(f_idx) AS f1 FROM l WHERE label > 0 GROUP BY ALL),
 i AS (SELECT l.rec, f_idx, t_idx FROM l JOIN e ON e.rec = l.rec AND e.label = l.label WHERE NOT (y = 0 OR x = 0 OR f_idx = f1 OR t_idx = t1)), c AS (SELECT rec, max(t_idx) AS last FROM px GROUP BY rec)
SELECT px.rec, px.t_idx + 0.6 AS t, px.f_idx, round(CASE WHEN i.rec IS NOT NULL THEN power ELSE 0 END, 6) + 0.0 AS power FROM px JOIN c ON c.rec = px.rec LEFT JOIN i ON i.rec = px.rec AND i.f_idx = px.f_idx AND i.t_idx = least(px.t_idx + 1, last)""")
def second_pass_mask(spark, sf):
    """A second spectrogram whose columns lie 0.6 after those of the first."""
    b = boxes(spark, sf)
    first = b.select("rec", F.col("t_idx").cast("double").alias("t"), "f_idx", "t_idx", F.lit(1).alias("segment"), "label")
    second = b.select("rec", (F.col("t_idx") + 0.6).alias("t"), F.col("f_idx").cast("long").alias("f_idx"), "power")
    return peaks.mask_second_pass(second, first).select("rec", "t", "f_idx", R(F.col("power")).alias("power"))


@query(f"""WITH {PX}, l AS (SELECT rec, f_idx, t_idx, {BOX} AS label FROM px), n AS (SELECT a.rec, a.f_idx, a.t_idx, min(b.label) AS label FROM l a JOIN (SELECT rec, f_idx + df AS f_idx, t_idx + dt AS t_idx, label FROM l, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) d(df, dt) WHERE label > 0) b USING (rec, f_idx, t_idx) WHERE a.label = 0 GROUP BY ALL)
SELECT l.rec, l.f_idx, l.t_idx, coalesce(n.label, l.label) AS label FROM l LEFT JOIN n USING (rec, f_idx, t_idx)""")
def image_grow(spark, sf):
    return images.grow(boxes(spark, sf), 1)


# --- recordings as spectra --------------------------------------------------------------------------------------------

TAPER = signals.Taper(16.0, 4.0, 2.0, 3, (0.0, 0.5), spacing=1.0)
TAPERS = "(VALUES " + ", ".join(f"({k}, {j}, {float(x)!r}::DOUBLE)" for k, row in enumerate(spectra.dpss(16, 2.0, 3)) for j, x in enumerate(row)) + ")"
NUMBERED = "s AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"


def _even(spark, sf):
    """The samples of each recording as if one second apart."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf}/events.parquet")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select("user_id", i.cast("double").alias("t"), F.col("value").alias("v"))


@query(f"""WITH {NUMBERED}, n AS (SELECT user_id, count(*) AS n FROM s GROUP BY user_id), w AS (SELECT user_id, unnest(range(0, (n - 16) // 4 + 1)) AS k FROM n WHERE n >= 16),
 x AS (SELECT w.user_id, k, i - 4 * k AS j, v - avg(v) OVER (PARTITION BY w.user_id, k) AS v FROM w JOIN s ON s.user_id = w.user_id AND i >= 4 * k AND i < 4 * k + 16),
 c AS (SELECT user_id, k, tap, f, sum(v * h * cos(2 * pi() * f * j / 16)) AS re, sum(v * h * sin(2 * pi() * f * j / 16)) AS im FROM x JOIN {TAPERS} p(tap, jj, h) ON jj = j, range(9) y(f) GROUP BY ALL)
SELECT user_id, k AS t_idx, f AS f_idx, round(avg((re * re + im * im) * CASE WHEN f IN (0, 8) THEN 1 ELSE 2 END), 4) + 0.0 AS power FROM c GROUP BY user_id, k, f""")
def spectrogram(spark, sf):
    """Multitaper powers of windows of 16 samples, 4 apart."""
    out = signals.long_form(signals.spectrogram(_even(spark, sf), ["user_id"], 1.0, TAPER))
    return out.select("user_id", "t_idx", "f_idx", (F.round("power", 4) + 0.0).alias("power"))


@query(f"""WITH {NUMBERED}, n AS (SELECT user_id, count(*) AS n FROM s GROUP BY user_id), c AS (SELECT s.user_id, f, n, sum(v * cos(2 * pi() * f * i / n)) AS re, -sum(v * sin(2 * pi() * f * i / n)) AS im FROM s JOIN n USING (user_id), range(400) y(f) WHERE f < n GROUP BY ALL),
 h AS (SELECT *, CASE WHEN f = 0 OR 2 * f = n THEN 1 WHEN 2 * f < n THEN 2 ELSE 0 END AS w FROM c)
SELECT s.user_id, s.i, round(sqrt(pow(sum(w * (re * cos(2 * pi() * f * s.i / n) - im * sin(2 * pi() * f * s.i / n))) / n, 2) + pow(sum(w * (re * sin(2 * pi() * f * s.i / n) + im * cos(2 * pi() * f * s.i / n))) / n, 2)), 4) + 0.0 AS amplitude FROM s JOIN h USING (user_id) GROUP BY s.user_id, s.i, n""")
def analytic_amplitude(spark, sf):
    """Amplitude of the analytic signal of each recording."""
    import pyarrow as pa

    from .kernels.filters import analytic

    def run(table):
        table = table.sort_by("t")
        return table.append_column("amplitude", pa.array(np.abs(analytic(table.column("v").to_numpy()))))

    out = _even(spark, sf).groupBy("user_id").applyInArrow(run, "user_id long, t double, v double, amplitude double")
    return out.select("user_id", F.col("t").cast("long").alias("i"), (F.round("amplitude", 4) + 0.0).alias("amplitude"))


ST = "st AS (SELECT rec, k * 17 AS t, k % 6 AS stage FROM (SELECT DISTINCT t_idx // 100 AS rec FROM p), range(5) r(k))"


@query(f"""WITH i AS ({IMAGE_SQL}), p AS (SELECT t_idx, 10 * log10(sum(power) * 0.5) AS db FROM i GROUP BY t_idx), {ST}, d AS (SELECT t_idx // 100 AS rec, t_idx % 100 AS t, db FROM p),
 j AS (SELECT d.*, s.stage AS s FROM d ASOF LEFT JOIN st s ON d.rec = s.rec AND d.t >= s.t), a AS (SELECT *, CASE WHEN t > 68 THEN 0 ELSE coalesce(s, 0) END AS stage FROM j),
 z AS (SELECT *, CASE WHEN abs((db - avg(db) OVER (PARTITION BY rec)) / stddev_samp(db) OVER (PARTITION BY rec)) >= 3 THEN NULL ELSE db END AS so FROM a), g AS (SELECT * FROM z WHERE stage IN (1, 2, 3, 4) AND so IS NOT NULL), h AS ({hazen_sql('g', 'rec', 'so', 0.02)})
SELECT z.rec, z.t::DOUBLE AS t, stage::INTEGER AS stage, round(so - pct, 6) + 0.0 AS so_power FROM z LEFT JOIN h ON h.rec = z.rec""")
def so_power_of_spectrogram(spark, sf):
    s = _spect(spark, sf).select(F.floor(F.col("t_idx") / 100).alias("rec"), (F.col("t_idx") % 100).cast("double").alias("t"), "power")
    stages = s.select("rec").distinct().select("rec", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).select("rec", (F.col("k") * 17.0).alias("t"), (F.col("k") % 6).alias("stage"))
    out = signals.power_of(s, ["rec"], 0.5, stages=stages)
    return out.select("rec", "t", "stage", R(F.col("so_power")).alias("so_power"))


@query(f"""WITH i AS ({IMAGE_SQL}), l AS (SELECT t_idx // 12 AS a, f_idx // 9 AS b, t_idx, f_idx FROM i WHERE power > 3), s AS (SELECT a, b, (max(t_idx) - min(t_idx) + 1) * 0.5 AS d, (max(f_idx) - min(f_idx) + 1) * 0.25 AS w, (max(t_idx) - min(t_idx)) * 0.5 AS d0, (max(f_idx) - min(f_idx)) * 0.25 AS w0 FROM l GROUP BY ALL)
SELECT a, b, d > 2.5 AND w > 1 AS wide, d0 > 2.5 AND w0 > 1 AS apart FROM s""")
def extent_cuts(spark, sf):
    """Regions by their extents in pixels, and by the distance of their first and last pixel."""
    px = image(spark, sf).where("power > 3").select(F.floor(F.col("t_idx") / 12).alias("a"), F.floor(F.col("f_idx") / 9).alias("b"), "t_idx", "f_idx")
    return series.extent_cut(px, ["a", "b"], "t_idx", "f_idx", (0.5, 0.25), (2.5, 1.0))



# --- zero-phase filters -----------------------------------------------------------------------------------------------


def _sections(sos: np.ndarray) -> str:
    """SQL of the zero-phase filter over s (user_id, i, v): forward and backward through each section as recursions over
    the samples, after odd reflection; the last table is y<number of sections>."""
    from .kernels.filters import steady_state

    order = sum(2 if r[2] or r[5] else 1 for r in sos)
    out = ["n AS (SELECT user_id, count(*) AS n, least(greatest(1, 3 * {0}), count(*) - 1) AS pad FROM s GROUP BY user_id HAVING count(*) > 1)".format(order), "y0 AS (SELECT user_id, i, v FROM s JOIN n USING (user_id))"]
    for k, r in enumerate(sos, 1):
        b, a = (r[:3] / r[3]).tolist(), (r[3:] / r[3]).tolist()
        zi = steady_state(np.array(b), np.array(a)).tolist()
        step = lambda x, z1, z2: f"{b[0]!r} * {x} + {z1} AS y, {b[1]!r} * {x} - {a[1]!r} * ({b[0]!r} * {x} + {z1}) + {z2} AS z1, {b[2]!r} * {x} - {a[2]!r} * ({b[0]!r} * {x} + {z1}) AS z2"  # noqa: B023, E731
        first = lambda x: step(x, f"{zi[0]!r} * {x}", f"{zi[1]!r} * {x}")  # noqa: B023, E731
        p = f"y{k - 1}"
        out += [
            f"e{k} AS MATERIALIZED (SELECT user_id, i AS j, v AS x FROM {p} UNION ALL SELECT a.user_id, -a.i, 2 * b.v - a.v FROM {p} a JOIN n USING (user_id) JOIN {p} b ON b.user_id = a.user_id AND b.i = 0 WHERE a.i BETWEEN 1 AND pad UNION ALL SELECT a.user_id, 2 * (n - 1) - a.i, 2 * b.v - a.v FROM {p} a JOIN n USING (user_id) JOIN {p} b ON b.user_id = a.user_id AND b.i = n - 1 WHERE a.i BETWEEN n - 1 - pad AND n - 2)",
            f"f{k} AS (SELECT e.user_id, j, {first('x')} FROM e{k} e JOIN n ON n.user_id = e.user_id AND j = -pad UNION ALL SELECT e.user_id, e.j, {step('x', 'f.z1', 'f.z2')} FROM f{k} f JOIN e{k} e ON e.user_id = f.user_id AND e.j = f.j + 1)",
            f"m{k} AS MATERIALIZED (SELECT user_id, j, y AS x FROM f{k})",
            f"g{k} AS (SELECT e.user_id, j, {first('x')} FROM m{k} e JOIN n ON n.user_id = e.user_id AND j = n.n - 1 + pad UNION ALL SELECT e.user_id, e.j, {step('x', 'g.z1', 'g.z2')} FROM g{k} g JOIN m{k} e ON e.user_id = g.user_id AND e.j = g.j - 1)",
            f"y{k} AS MATERIALIZED (SELECT g.user_id, j AS i, y AS v FROM g{k} g JOIN n ON n.user_id = g.user_id AND j BETWEEN 0 AND n.n - 1)",
        ]
    return ",\n ".join(out)


def _band():
    from .kernels.filters import cheby1_sos

    return cheby1_sos(2, 0.2, (0.1, 0.4), 2.0, "bandpass")


@query(f"WITH RECURSIVE {NUMBERED}, {_sections(_band())} SELECT user_id, i, round(v, 4) + 0.0 AS filtered FROM y{len(_band())}")
def zero_phase_filter(spark, sf):
    """The samples of each recording, band-passed forward and backward; recordings of one sample are left out."""
    import pyarrow as pa

    from .kernels.filters import sosfiltfilt

    def run(table):
        table = table.sort_by("t")
        return table.append_column("y", pa.array(sosfiltfilt(_band(), table.column("v").to_numpy()))).slice(0, None if table.num_rows > 1 else 0)

    out = _even(spark, sf).groupBy("user_id").applyInArrow(run, "user_id long, t double, v double, y double")
    return out.select("user_id", F.col("t").cast("long").alias("i"), (F.round("y", 4) + 0.0).alias("filtered"))


@query(f"""WITH RECURSIVE {NUMBERED}, {_sections(_band())}, z AS MATERIALIZED (SELECT y.user_id, i, v, n.n FROM y{len(_band())} y JOIN n ON n.user_id = y.user_id), c AS (SELECT user_id, f, n, sum(v * cos(2 * pi() * f * i / n)) AS re, -sum(v * sin(2 * pi() * f * i / n)) AS im FROM z, range(400) q(f) WHERE f < n GROUP BY ALL),
 h AS MATERIALIZED (SELECT *, CASE WHEN f = 0 OR 2 * f = n THEN 1 WHEN 2 * f < n THEN 2 ELSE 0 END AS w FROM c)
SELECT z.user_id, z.i, round(v, 4) + 0.0 AS filtered, round(sqrt(pow(sum(w * (re * cos(2 * pi() * f * z.i / z.n) - im * sin(2 * pi() * f * z.i / z.n))) / z.n, 2) + pow(sum(w * (re * sin(2 * pi() * f * z.i / z.n) + im * cos(2 * pi() * f * z.i / z.n))) / z.n, 2)), 4) + 0.0 AS amplitude FROM z JOIN h ON h.user_id = z.user_id GROUP BY z.user_id, z.i, z.v, z.n""")
def band_envelope(spark, sf):
    """The samples of each recording, band-passed with zero phase, and the amplitude of their analytic signal."""
    import pyarrow as pa

    from .kernels.filters import analytic, sosfiltfilt

    def run(table):
        table = table.sort_by("t")
        y = sosfiltfilt(_band(), table.column("v").to_numpy())
        out = table.append_column("y", pa.array(y)).append_column("a", pa.array(np.abs(analytic(y))))
        return out.slice(0, None if table.num_rows > 1 else 0)

    out = _even(spark, sf).groupBy("user_id").applyInArrow(run, "user_id long, t double, v double, y double, a double")
    return out.select("user_id", F.col("t").cast("long").alias("i"), (F.round("y", 4) + 0.0).alias("filtered"), (F.round("a", 4) + 0.0).alias("amplitude"))


@query(f"""WITH RECURSIVE {NUMBERED}, r AS (SELECT user_id, i, v AS lo, v AS hi, 0 AS run FROM s WHERE i = 0 UNION ALL SELECT s.user_id, s.i, CASE WHEN greatest(hi, v) - least(lo, v) <= 120 THEN least(lo, v) ELSE v END, CASE WHEN greatest(hi, v) - least(lo, v) <= 120 THEN greatest(hi, v) ELSE v END, CASE WHEN greatest(hi, v) - least(lo, v) <= 120 THEN run ELSE run + 1 END FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1)
SELECT user_id, i, count(*) OVER (PARTITION BY user_id, run) >= 3 AS flat FROM r""")
def flat_runs_within(spark, sf):
    """Runs of at least 3 samples that grow while they span at most 120."""
    import pyarrow as pa

    from .kernels.artifacts import flat_runs

    def run(table):
        table = table.sort_by("t")
        return table.append_column("flat", pa.array(flat_runs(table.column("v").to_numpy(), 3, 120.0)))

    out = _even(spark, sf).groupBy("user_id").applyInArrow(run, "user_id long, t double, v double, flat boolean")
    return out.select("user_id", F.col("t").cast("long").alias("i"), "flat")
