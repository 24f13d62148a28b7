"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic). Each sweep scales the cells so that the marginal of one dimension
after the other meets its targets; the sums are taken from factors of the three dimensions, which stay small tables of
their own. Documents of a cell are then kept with the cell's calibrated probability, decided by a hash of doc_id.
Nothing is collected: cells and marginals are DataFrames of any size, aggregated with partial sums.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, fresh

DIMENSIONS = ("source", "lang", "topic")
#: Shares of tokens. A category that is not named shares, with the others not named, what the named ones leave, in
#: proportion to its own tokens; None: all categories of the dimension alike.
TARGETS = {"source": None, "lang": {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.1}, "topic": {"prose": 0.8, "table": 0.1, "licence": 0.1}}
SWEEPS, RATE = 6, 0.5
TOPIC_SQL = "CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, 'License') THEN 'licence' ELSE 'prose' END"
NONE = "(none)"


def tokens(text) -> F.Column:
    r"""Words ``[^\x20\x09-\x0D]+`` of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _goal(cells: DataFrame, dim: str, target: dict | None) -> DataFrame:
    """(dim, goal): shares of the categories that have tokens, summing to 1."""
    have = cells.groupBy(dim).agg(F.sum("t").alias("t"))
    if target is None:
        return have.crossJoin(F.broadcast(have.agg(F.count("*").alias("n")))).select(dim, (F.lit(1.0) / F.col("n")).alias("goal"))
    named = F.lit(None).cast("double")
    for k, v in target.items():
        named = F.when(F.col(dim) == k, F.lit(float(v))).otherwise(named)
    have = have.withColumn("named", named)
    rest = have.agg(F.sum(F.when(F.col("named").isNull(), F.col("t"))).cast("double").alias("rest"), F.coalesce(F.sum("named"), F.lit(0.0)).alias("given"))
    raw = F.coalesce("named", F.greatest(F.lit(1.0) - F.col("given"), F.lit(0.0)) * F.col("t") / F.col("rest"))
    total = F.when(F.col("rest").isNull(), F.col("given")).otherwise(F.greatest("given", F.lit(1.0)))
    return have.crossJoin(F.broadcast(rest)).select(dim, (raw / total).alias("goal"))


def rake(cells: DataFrame, targets: dict, sweeps: int, scratch: Scratch) -> DataFrame:
    """cells (*dims, t) -> cells with w: weights in proportion to t times one factor a category, that sum to 1."""
    factors = {d: scratch.save(_goal(cells, d, targets.get(d)).withColumn(f"f_{d}", F.lit(1.0)), "goal") for d in targets}
    for _ in range(sweeps):
        for d in targets:
            wide = cells
            for other in targets:
                if other != d:
                    wide = wide.join(factors[other].select(other, f"f_{other}"), other)
            product = F.col("t").cast("double")
            for other in targets:
                if other != d:
                    product = product * F.col(f"f_{other}")
            mass = wide.groupBy(d).agg(F.sum(product).alias("mass"))
            factors[d] = scratch.save(factors[d].select(d, "goal").join(mass, d).select(d, "goal", F.when(F.col("mass") > 0, F.col("goal") / F.col("mass")).otherwise(0.0).alias(f"f_{d}")), "factor")
    out = cells
    w = F.col("t").cast("double")
    for d in targets:
        out = out.join(factors[d].select(d, f"f_{d}"), d)
        w = w * F.col(f"f_{d}")
    out = scratch.save(out.select(*targets, "t", w.alias("raw")), "raked")
    return out.crossJoin(F.broadcast(out.agg(F.sum("raw").alias("all"), F.sum("t").alias("tokens")))).select(*targets, "t", (F.col("raw") / F.col("all")).alias("w"), "tokens")


def _placed(docs: DataFrame, topic: str, names: list[str]) -> DataFrame:
    """docs with source, language, topic and tokens as columns of the given names."""
    dims = [F.coalesce(F.col(c).cast("string"), F.lit(NONE)) for c in ("source", "lang")]
    return docs.select("*", *(x.alias(n) for x, n in zip((*dims, F.expr(topic), tokens(F.col("text"))), names, strict=True)))


def calibrated(docs: DataFrame, targets: dict, rate: float, sweeps: int, topic: str, meet: bool = True) -> DataFrame:
    """(source, lang, topic, p): the probability of each cell, rounded to 9 digits."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = _placed(docs.select("text", "source", "lang"), topic, ["_source", "_lang", "_topic", "_tokens"]).where("_tokens > 0")
    cells = scratch.save(rows.groupBy(*(F.col(f"_{d}").alias(d) for d in DIMENSIONS)).agg(F.sum("_tokens").alias("t")), "cells")
    raked, at = rake(cells, targets, sweeps, scratch), F.lit(float(rate))
    if meet:
        raked = scratch.save(raked, "weights")
        most = raked.agg(F.max(F.col("tokens") * F.col("w") / F.col("t")).alias("most"))
        raked, at = raked.crossJoin(F.broadcast(most)), F.least(at, F.lit(1.0) / F.col("most"))
    p = F.round(F.least(F.lit(1.0), at * F.col("tokens") * F.col("w") / F.col("t")), 9)
    return scratch.save(raked.select(*DIMENSIONS, "t", p.alias("p")), "p")


def _decided(docs: DataFrame, targets: dict | None, rate: float, sweeps: int, topic: str, meet: bool) -> tuple[DataFrame, list[str]]:
    """docs with tokens, probability and decision, and the names of these columns, which none of docs has."""
    found = calibrated(docs, TARGETS if targets is None else targets, rate, sweeps, topic, meet).drop("t")
    names = fresh(docs.columns, "_source", "_lang", "_topic", "_tokens", "_p", "_prob", "_kept")
    tokens_, p, prob, kept = names[3:]
    found = found.toDF(*names[:3], p)
    chance = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0
    out = _placed(docs, topic, names[:4]).join(found, names[:3], "left").withColumn(prob, F.when(F.col(tokens_) > 0, F.col(p)).otherwise(F.lit(float(rate))))
    return out.withColumn(kept, F.coalesce(chance < F.col(prob), F.lit(False))), [tokens_, prob, kept]


def mix(docs: DataFrame, targets: dict | None = None, rate: float = RATE, sweeps: int = SWEEPS, topic: str = TOPIC_SQL, meet: bool = True) -> DataFrame:
    """docs (doc_id, text, source, lang) -> doc_id, tokens, prob, kept.

    A cell's tokens are to be ``rate`` of all tokens times the cell's raked share; its documents are kept with
    probability ``prob`` = that over the cell's tokens, rounded to 9 digits. The rate is lowered to the largest at which
    no cell needs more than it has, so that the targets hold; without ``meet`` it stays, probabilities are cut at 1 and
    what is cut off misses the targets: see missed(). A null category is a category. A document without tokens adds
    nothing to a mixture and is kept with probability ``rate``. The decision depends on doc_id alone, so repeated rows
    are kept or dropped together; a null doc_id is dropped. An empty table gives none; extra columns are ignored.
    """
    out, (tokens_, prob, kept) = _decided(docs.select("doc_id", "text", "source", "lang"), targets, rate, sweeps, topic, meet)
    return out.select("doc_id", F.col(tokens_).alias("tokens"), F.col(prob).alias("prob"), F.col(kept).alias("kept"))


def sample(docs: DataFrame, targets: dict | None = None, rate: float = RATE, sweeps: int = SWEEPS, topic: str = TOPIC_SQL, meet: bool = True) -> DataFrame:
    """The rows of docs that mix() keeps, with all their columns. Cells are joined to the rows; texts are not moved
    where the table of cells is small enough for the optimiser to send it round."""
    out, names = _decided(docs, targets, rate, sweeps, topic, meet)
    return out.where(F.col(names[-1])).select(*(docs[c] if docs.columns.count(c) == 1 else c for c in docs.columns))


def missed(docs: DataFrame, targets: dict | None = None, rate: float = RATE, sweeps: int = SWEEPS, topic: str = TOPIC_SQL, meet: bool = True) -> DataFrame:
    """(dimension, category, goal, share, residual): the share of tokens that each category of each dimension is expected
    to have in the sample, and by how much its target is missed, be it for want of sweeps or of tokens."""
    targets = TARGETS if targets is None else targets
    found = calibrated(docs, targets, rate, sweeps, topic, meet)
    kept = F.col("t") * F.col("p")
    total = found.agg(F.sum(kept).alias("all"))
    parts = []
    for d in targets:
        share = found.groupBy(d).agg(F.sum(kept).alias("k")).crossJoin(F.broadcast(total)).select(d, (F.col("k") / F.col("all")).alias("share"))
        parts.append(_goal(found, d, targets[d]).join(share, d).select(F.lit(d).alias("dimension"), F.col(d).alias("category"), "goal", "share", (F.col("share") - F.col("goal")).alias("residual")))
    return functools.reduce(DataFrame.unionByName, parts)


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang"))


def _sql() -> str:
    def goal(d: str) -> str:
        target = TARGETS[d]
        if target is None:
            return f"g_{d} AS MATERIALIZED (SELECT {d}, 1.0::DOUBLE / count(*) OVER () AS goal FROM (SELECT DISTINCT {d} FROM cells))"
        named = "CASE " + " ".join(f"WHEN {d} = '{k}' THEN {v}::DOUBLE" for k, v in target.items()) + " END"
        return f"""h_{d} AS (SELECT {d}, sum(t) AS t, {named} AS named FROM cells GROUP BY {d}),
 g_{d} AS MATERIALIZED (SELECT {d}, coalesce(named, greatest(1.0::DOUBLE - given, 0.0::DOUBLE) * t / rest) / CASE WHEN rest IS NULL THEN given ELSE greatest(given, 1.0::DOUBLE) END AS goal
  FROM h_{d}, (SELECT sum(t) FILTER (WHERE named IS NULL)::DOUBLE AS rest, coalesce(sum(named), 0.0::DOUBLE) AS given FROM h_{d}))"""

    parts = [
        f"""rows_ AS MATERIALIZED (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, {TOPIC_SQL} AS topic,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens FROM documents)""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS t FROM rows_ WHERE tokens > 0 GROUP BY ALL)",
        *(goal(d) for d in DIMENSIONS),
        *(f"f_{d}_0 AS (SELECT {d}, 1.0::DOUBLE AS f FROM g_{d})" for d in DIMENSIONS),
    ]
    now = {d: f"f_{d}_0" for d in DIMENSIONS}
    for i in range(1, SWEEPS + 1):
        for d in DIMENSIONS:
            a, b = (x for x in DIMENSIONS if x != d)
            parts.append(f"f_{d}_{i} AS MATERIALIZED (SELECT {d}, goal / sum(t::DOUBLE * x.f * y.f) AS f FROM cells JOIN {now[a]} x USING ({a}) JOIN {now[b]} y USING ({b}) JOIN g_{d} USING ({d}) GROUP BY {d}, goal)")
            now[d] = f"f_{d}_{i}"
    s, l, t = (now[d] for d in DIMENSIONS)
    parts.append(f"raked AS MATERIALIZED (SELECT source, lang, topic, t, t::DOUBLE * a.f * b.f * c.f AS raw FROM cells JOIN {s} a USING (source) JOIN {l} b USING (lang) JOIN {t} c USING (topic))")
    parts.append("need AS MATERIALIZED (SELECT *, (SELECT sum(t) FROM raked) * (raw / (SELECT sum(raw) FROM raked)) / t AS need FROM raked)")
    parts.append(f"p AS (SELECT source, lang, topic, round(least(1.0::DOUBLE, least({RATE}::DOUBLE, 1.0::DOUBLE / (SELECT max(need) FROM need)) * need), 9) AS p FROM need)")
    body = ",\n ".join(parts)
    return f"""WITH {body}
SELECT doc_id, tokens, prob, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE < prob AS kept
FROM (SELECT doc_id, tokens, CASE WHEN tokens > 0 THEN p ELSE {RATE}::DOUBLE END AS prob FROM rows_ LEFT JOIN p USING (source, lang, topic))"""


OP4_SQL = _sql()
