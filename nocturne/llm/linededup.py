"""Line removal by site-relative frequency, in DataFrame functions only.

A line is boilerplate of its host if the share of the host's pages that contain it is at least ``ratio``. Every page
counts a line once. Only hashes of lines are shuffled, after a count on the map side, so a host with a third of all
pages is a few partial counts and not a group. The boilerplate of a host holds at most (distinct lines of its mean
page) / ratio lines, one row per host; it is joined to the pages as a broadcast only where its measured size is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, fresh

RATIO, MIN_PAGES = 0.1, 5
BROADCAST_BYTES = 16 << 20


def boilerplate(docs: DataFrame, host: str, text: str, ratio: float, min_pages: int) -> DataFrame:
    """(host, lines ARRAY<BIGINT>): hashes of the lines that a host repeats."""
    pages = docs.where(F.col(host).isNotNull()).select(F.col(host).alias("host"), F.col(text).alias("text"))
    total = pages.groupBy("host").agg(F.count("*").alias("pages"))
    lines = pages.select("host", F.explode(F.array_distinct(F.transform(F.split("text", "\n", -1), lambda x: F.when(F.trim(x) != "", F.xxhash64(x))))).alias("line"))
    seen = lines.where("line IS NOT NULL").groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return seen.join(total, "host").where(F.col("n") >= F.lit(ratio) * F.col("pages")).groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with boilerplate lines taken out of ``text``, plus n_lines and n_dropped.

    Lines end at ``\\n``; the kept ones are joined by ``\\n`` again. Blank lines are never boilerplate. A line needs
    ``min_pages`` pages of its host at least, so small hosts lose nothing by chance. A null host belongs to no site and
    its text stays; a null text stays null with 0 lines; an empty text is one blank line. Repeated rows count as pages
    of their own. Columns of docs named n_lines or n_dropped are replaced; all others, of any name, stay as they are.
    """
    spark = docs.sparkSession
    found = Scratch(spark, "lines").save(boilerplate(docs, host, text, ratio, min_pages), "boilerplate")
    size = found.agg(F.coalesce(F.sum(F.size("lines") * 8 + F.length(F.col("host").cast("string")) + 32), F.lit(0))).first()[0]
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    at, lines, all_, left = fresh(docs.columns, "_host", "_lines", "_all", "_left")
    side = found.select(F.col("host").alias(at), F.col("lines").alias(lines))
    out = docs.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, docs[host] == side[at], "left")
    out = out.withColumn(all_, F.split(docs[text], "\n", -1))
    out = out.withColumn(left, F.when(F.col(lines).isNull(), F.col(all_)).otherwise(F.filter(all_, lambda x: (F.trim(x) == "") | ~F.array_contains(lines, F.xxhash64(x)))))
    size_of = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    kept = F.when(size_of(left) == size_of(all_), docs[text]).otherwise(F.array_join(left, "\n"))
    return out.select(*[kept.alias(c) if c == text else docs[c] for c in names], F.greatest(size_of(all_), F.lit(0)).alias("n_lines"), F.greatest(size_of(all_) - size_of(left), F.lit(0)).alias("n_dropped"))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = drop_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


OP5_SQL = f"""
WITH lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
 pages AS (SELECT source, count(*) AS pages FROM documents WHERE source IS NOT NULL GROUP BY source),
 seen AS (SELECT source, line, count(DISTINCT doc_id) AS n FROM lines WHERE trim(line) <> '' AND source IS NOT NULL GROUP BY source, line),
 bad AS (SELECT source, line FROM seen JOIN pages USING (source) WHERE n >= {MIN_PAGES} AND n >= {RATIO}::DOUBLE * pages),
 kept AS (SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE b.line IS NOT NULL) AS n_dropped,
   coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE b.line IS NULL), '') AS body
   FROM lines l LEFT JOIN bad b ON l.source = b.source AND l.line = b.line GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped, md5(coalesce(k.body, '')) AS kept_md5
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
