"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _star(edges: DataFrame, scratch: Scratch, large: bool) -> DataFrame:
    """edges (u, v). Large: every larger neighbour of u is tied to the least of u and its neighbours. Small: every
    smaller neighbour, and u itself, is tied to the least one. The minima are a table of their own, so that a vertex
    with very many neighbours is a skewed join that can be split and not one group in one task."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = scratch.save(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        out = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Is every id tied to one centre, and no centre tied to another?"""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.where("up > 1 OR up = 1 AND down = 1").agg(F.count("*")).first()[0] == 0


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) links between ids -> (id, component): component is the least id that links reach, for every id that has
    a link. Repeated links, links in both directions and links of an id to itself change nothing; null ids are dropped;
    no links give an empty table. Number of rounds: the logarithm of the largest component, in practice 1 to 3."""
    edges = scratch.save(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _is_stars(edges):
        edges = scratch.save(_star(edges, scratch, large=True), "large")
        edges = scratch.save(_star(edges, scratch, large=False), "small")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
