"""Queries of histograms by stage and of group comparisons, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import asof, bins, quantile, stats
from .queries import C_BINS, CELLS, F_BINS, IMAGE_SQL, P_SQL, S_SQL, R, _edges, cells, hazen_sql, image, peaks, query, samples, stage_of

# --- histograms by stage ----------------------------------------------------------------------------------------------


def _histogram(spark, sf, **options):
    l = spark.read.parquet(f"{sf}/lineitem.parquet")
    s = l.select((F.col("l_discount") + 0.0).alias("c"), F.col("l_linenumber").alias("stage"), (F.col("l_quantity") > 10).alias("valid"), (F.col("l_quantity") > 5).alias("valid_all"))
    return bins.stage_histogram(peaks(spark, sf), s, C_BINS, F_BINS, 30.0, **options)


HIST = f"""{P_SQL}, cb AS ({_edges(C_BINS)}), fb AS ({_edges(F_BINS)}),
 w AS (SELECT bin, count(*) FILTER (WHERE l_quantity > 5) * 0.5 AS whole FROM lineitem JOIN cb ON lo <= l_discount + 0.0 AND l_discount + 0.0 < lo + {C_BINS.width!r} GROUP BY bin),
 k AS (SELECT bin, l_linenumber AS stage, count(*) * 0.5 AS minutes FROM lineitem JOIN cb ON lo <= l_discount + 0.0 AND l_discount + 0.0 < lo + {C_BINS.width!r} WHERE l_quantity > 10 AND l_linenumber <= 5 GROUP BY ALL),
 tm AS (SELECT cb.bin AS c_bin, s.stage, coalesce(minutes, 0) AS minutes, CASE WHEN whole > 0 THEN coalesce(minutes, 0) / whole ELSE 0 END AS share FROM cb CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS stage) s LEFT JOIN k ON k.bin = cb.bin AND k.stage = s.stage LEFT JOIN w ON w.bin = cb.bin),
 pf AS (SELECT fb.bin AS f_bin, count(f) AS n FROM fb LEFT JOIN p ON fb.lo <= f AND f < fb.lo + {F_BINS.width!r} GROUP BY fb.bin),
 n AS (SELECT cb.bin AS c_bin, fb.bin AS f_bin, count(*) AS n FROM p JOIN cb ON cb.lo <= c AND c < cb.lo + {C_BINS.width!r} JOIN fb ON fb.lo <= f AND f < fb.lo + {F_BINS.width!r} GROUP BY ALL),
 m AS (SELECT c_bin, sum(minutes) AS m FROM tm GROUP BY c_bin),
 g AS (SELECT c_bin, f_bin, coalesce(n.n, 0) AS n, m, pf.n AS peaks FROM m CROSS JOIN pf LEFT JOIN n USING (c_bin, f_bin))"""


@query(f"WITH {HIST} SELECT c_bin, stage, round(minutes, 6) + 0.0 AS minutes, round(share, 6) + 0.0 AS share FROM tm")
def histogram_stage_minutes(spark, sf):
    return _histogram(spark, sf).time.select("c_bin", "stage", R(F.col("minutes")).alias("minutes"), R(F.col("share")).alias("share"))


@query(f"WITH {HIST} SELECT f_bin, n FROM pf")
def histogram_peaks_at_freq(spark, sf):
    return _histogram(spark, sf).peaks


@query(f"WITH {HIST}, v AS (SELECT *, CASE WHEN m >= 1 AND peaks >= (SELECT median(n) FROM pf) THEN CASE WHEN m > 0 THEN n / m ELSE n END END AS v FROM g) SELECT c_bin, f_bin, n, round(v, 6) + 0.0 AS value FROM v")
def histogram_guards(spark, sf):
    h = _histogram(spark, sf)
    least = int(-(-h.peaks.agg(F.expr("median(n)")).first()[0] // 1))
    out = _histogram(spark, sf, least_minutes=1.0, least_peaks=least).cells
    return out.select("c_bin", "f_bin", "n", R(F.col("value")).alias("value"))


@query(f"WITH {HIST}, v AS (SELECT *, CASE WHEN m > 0 THEN n / m ELSE n::DOUBLE END AS v FROM g) SELECT c_bin, f_bin, round(v / CASE WHEN sum(v) OVER (PARTITION BY f_bin) = 0 THEN 1 ELSE sum(v) OVER (PARTITION BY f_bin) END, 6) + 0.0 AS value FROM v")
def histogram_norm_freq(spark, sf):
    return _histogram(spark, sf, norm="f_bin").cells.select("c_bin", "f_bin", R(F.col("value")).alias("value"))


@query(f"WITH {HIST}, v AS (SELECT *, n::DOUBLE AS v FROM g) SELECT c_bin, f_bin, round(v / CASE WHEN sum(v) OVER (PARTITION BY c_bin) = 0 THEN 1 ELSE sum(v) OVER (PARTITION BY c_bin) END, 6) + 0.0 AS value FROM v")
def histogram_norm_context(spark, sf):
    return _histogram(spark, sf, norm="c_bin", rate=False).cells.select("c_bin", "f_bin", R(F.col("value")).alias("value"))


# --- context of samples and peaks -------------------------------------------------------------------------------------

NEAR = f"""WITH {S_SQL}, l AS (SELECT * FROM s WHERE ch <> 'click'), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i FROM s WHERE ch = 'click'),
 a AS (SELECT l.*, p.t AS pt, p.i AS pi_, p.v AS pv FROM l ASOF LEFT JOIN r p ON l.user_id = p.user_id AND l.t >= p.t), b AS (SELECT a.*, n.t AS nt, n.i AS ni, n.v AS nv FROM a ASOF LEFT JOIN r n ON a.user_id = n.user_id AND a.t <= n.t)"""


@query(f"{NEAR} SELECT user_id, t, ch, CASE WHEN nt IS NOT NULL AND (pt IS NULL OR nt - t <= t - pt) THEN ni ELSE pi_ END AS i FROM b")
def nearest_index(spark, sf):
    s = samples(spark, sf)
    r = asof.numbered(s.where("ch = 'click'"), ["user_id"], "t", "i").withColumn("i", F.col("i") - 1)
    return asof.nearest_index(s.where("ch <> 'click'"), r, ["user_id"], "i").select("user_id", "t", "ch", "i")


@query(f"{NEAR} SELECT user_id, t, ch, CASE WHEN pt IS NULL OR nt IS NULL THEN true WHEN nt - t <= t - pt THEN nv > 300 ELSE pv > 300 END AS flagged FROM b")
def nearest_flag_spread(spark, sf):
    """A flag of windows at the samples nearest to their centres; true before the first and after the last one."""
    s = samples(spark, sf)
    r = s.where("ch = 'click'").withColumn("v", (F.col("v") > 300).cast("double"))
    return asof.nearest(s.where("ch <> 'click'"), r, ["user_id"], "x", outside=1.0).select("user_id", "t", "ch", (F.col("x") > 0.5).alias("flagged"))


@query(f"WITH i AS ({IMAGE_SQL}), g AS (SELECT * FROM i WHERE t_idx % 7 NOT IN (0, 3) AND t_idx >= 10 AND t_idx <= 400 AND power <> 0), h AS ({hazen_sql('g', 'f_idx', 'power', 0.02)}) SELECT f_idx, round(pct, 6) + 0.0 AS pct, n FROM h")
def baseline_valid(spark, sf):
    """Baseline over the columns that are in range and whose nearest sample is not excluded."""
    px = image(spark, sf)
    columns = px.select("t_idx").distinct().select("t_idx", F.col("t_idx").cast("double").alias("t"), F.lit(1).alias("k"))
    excluded = spark.range(0, 411).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("t"), F.col("id").isin([i for i in range(411) if i % 7 in (0, 3)]).cast("double").alias("v"))
    near = asof.nearest(columns, excluded, ["k"], "x").select("t_idx", ((F.col("x") < 0.5) & F.col("t").between(10, 400)).alias("valid"))
    return quantile.baseline(px.join(near, "t_idx"), ["f_idx"], "power", 0.02, "valid").select("f_idx", R(F.col("pct")).alias("pct"), "n")


@query(f"WITH {S_SQL} SELECT user_id, t, ch FROM s WHERE (floor(t / 21600)::BIGINT % 7)::INTEGER IN (2, 3)")
def stage_membership(spark, sf):
    from .operators.series import in_stages

    return samples(spark, sf).withColumn("stage", stage_of(F.col("t"))).where(in_stages("stage", (2, 3))).select("user_id", "t", "ch")


# --- group comparisons ------------------------------------------------------------------------------------------------

#: erf(x) as a sum of positive terms, for x up to about 8.
ERFC = """greatest(0.0::DOUBLE, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 250), lambda i: exp(-({x}) * ({x}) + i * ln(2.0::DOUBLE) + (2 * i + 1) * ln(greatest({x}, 1e-300::DOUBLE)) - (lgamma(2 * i + 2.0::DOUBLE) - i * ln(2.0::DOUBLE) - lgamma(i + 1.0::DOUBLE))))))"""
#: Exact two-sided rank-sum p of the bins under 20 values: ways to choose n1 of the doubled ranks by their sum.
EXACT = """sm AS (SELECT bin, (2 * r)::INTEGER AS w, row_number() OVER (PARTITION BY bin ORDER BY r, grp) AS i FROM r WHERE bin IN (SELECT bin FROM t WHERE exact)),
 ways AS (SELECT bin, 0 AS i, 0 AS k, 0 AS s, 1.0::DOUBLE AS c FROM (SELECT DISTINCT bin FROM sm) UNION ALL
  SELECT bin, i, k, s, sum(c)::DOUBLE FROM (SELECT y.bin, y.i + 1 AS i, y.k + j AS k, y.s + j * sm.w AS s, y.c FROM ways y JOIN sm ON sm.bin = y.bin AND sm.i = y.i + 1, (SELECT unnest([0, 1]) AS j) q) GROUP BY bin, i, k, s),
 ex AS (SELECT t.bin, least(1.0, 2 * least(sum(c) FILTER (WHERE s <= round(2 * w)), sum(c) FILTER (WHERE s >= round(2 * w))) / sum(c)) AS p FROM t JOIN ways ON ways.bin = t.bin AND ways.k = t.n1 AND ways.i = t.n1 + t.n2 GROUP BY t.bin)"""
RANKSUM = f"""WITH RECURSIVE {CELLS}, {EXACT}, pv AS (SELECT t.bin, CASE WHEN t.exact THEN ex.p ELSE coalesce(least(1.0, {ERFC.format(x='abs(z) / sqrt(2.0::DOUBLE)')}), 1.0) END AS p FROM t LEFT JOIN ex ON ex.bin = t.bin)"""


@query(f"{RANKSUM} SELECT bin, round(p, 6) + 0.0 AS p FROM pv")
def ranksum_p(spark, sf):
    return stats.ranksum_p(cells(spark, sf), ["bin"], "grp", "v").select("bin", R(F.col("p")).alias("p"))


@query(f"""{RANKSUM}, gb AS (SELECT DISTINCT bin FROM g), k AS (SELECT bin, p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM pv), q AS (SELECT *, (SELECT sum(1.0::DOUBLE / k) FROM k) * m * p / k AS raw FROM k),
 a2 AS (SELECT bin, p, min(raw) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS adj FROM q) SELECT gb.bin, round(p, 6) + 0.0 AS p, round(adj, 5) + 0.0 AS p_adj, coalesce(adj <= 0.5, false) AS significant FROM gb LEFT JOIN a2 USING (bin)""")
def fdr_grid(spark, sf):
    out = stats.fdr_grid(cells(spark, sf), ["bin"], "grp", "v", 0.5, "dep")
    return out.select("bin", R(F.col("p")).alias("p"), (F.round("p_adj", 5) + 0.0).alias("p_adj"), "significant")


@query(f"""WITH {CELLS}, p AS (SELECT 1 AS family, 1 / (1 + z * z) AS p FROM t WHERE z IS NOT NULL), k AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM p)
SELECT family, max(m) AS m, round(coalesce(max(p) FILTER (WHERE p <= k * 0.9 / m), 0), 6) + 0.0 AS crit_p FROM k GROUP BY family""")
def fdr_critical(spark, sf):
    z = stats.rank_sums(cells(spark, sf), ["bin"], "grp", "v").select(F.lit(1).alias("family"), (1 / (1 + F.col("z") * F.col("z"))).alias("p"))
    return stats.fdr_critical(z, ["family"], "p", 0.9).select("family", "m", R(F.col("crit_p")).alias("crit_p"))


def _pairs(spark, sf):
    """Extended price of lines 1 and 2 of an order, in thousands, by the order's remainder."""
    l = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_linenumber <= 2")
    l = l.groupBy("l_orderkey", "l_linenumber").agg(F.floor(F.min("l_extendedprice") / 1000).alias("v"))
    return stats.paired(l.withColumn("bin", F.col("l_orderkey") % 23), ["bin"], "l_orderkey", "l_linenumber", "v")


PAIRS = """pr AS (SELECT l_orderkey % 23 AS bin, l_orderkey, floor(min(l_extendedprice) FILTER (WHERE l_linenumber = 1) / 1000) AS x, floor(min(l_extendedprice) FILTER (WHERE l_linenumber = 2) / 1000) AS y FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL HAVING x IS NOT NULL AND y IS NOT NULL)"""


@query(f"WITH {PAIRS} SELECT bin, l_orderkey, x, y FROM pr")
def paired_samples(spark, sf):
    return _pairs(spark, sf).select("bin", "l_orderkey", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


@query(f"""WITH RECURSIVE {PAIRS}, d AS (SELECT bin, x - y AS d FROM pr WHERE x <> y), r AS (SELECT bin, d, rank() OVER (PARTITION BY bin ORDER BY abs(d)) + (count(*) OVER (PARTITION BY bin, abs(d)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY bin, abs(d)) AS k FROM d),
 a AS (SELECT bin, count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS w, sum(k * k - 1.0::DOUBLE) AS ties FROM r GROUP BY bin), m AS (SELECT *, least(w, n * (n + 1) / 2 - w) AS lo FROM a),
 sm AS (SELECT r.bin, (2 * r)::INTEGER AS w, row_number() OVER (PARTITION BY r.bin ORDER BY r) AS i FROM r JOIN m ON m.bin = r.bin AND n <= 15),
 ways AS (SELECT bin, 0 AS i, 0 AS s, 1.0::DOUBLE AS c FROM (SELECT DISTINCT bin FROM sm) UNION ALL SELECT bin, i, s, sum(c)::DOUBLE FROM (SELECT y.bin, y.i + 1 AS i, y.s + j * sm.w AS s, y.c FROM ways y JOIN sm ON sm.bin = y.bin AND sm.i = y.i + 1, (SELECT unnest([0, 1]) AS j) q) GROUP BY bin, i, s),
 ex AS (SELECT m.bin, least(1.0, 2 * sum(c) FILTER (WHERE s <= round(2 * lo)) / sum(c)) AS p FROM m JOIN ways ON ways.bin = m.bin AND ways.i = m.n GROUP BY m.bin),
 z AS (SELECT bin, abs(lo - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48) AS z FROM m)
SELECT m.bin, round(CASE WHEN n <= 15 THEN ex.p ELSE least(1.0, {ERFC.format(x='z / sqrt(2.0::DOUBLE)')}) END, 6) + 0.0 AS p FROM m LEFT JOIN ex ON ex.bin = m.bin LEFT JOIN z ON z.bin = m.bin""")
def signrank_p(spark, sf):
    return stats.signrank_p(_pairs(spark, sf), ["bin"], "x", "y").where("p IS NOT NULL").select("bin", R(F.col("p")).alias("p"))


@query()
def permutation_grid(spark, sf):
    """Counts of events by type of two groups of users."""
    e = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    e = e.withColumn("grp", F.col("user_id") % 2 + 1).withColumn("grid", F.lit(1))
    return stats.permutation_grid(e, ["grid"], "event_type", "user_id", "grp", "v", n=1000)
