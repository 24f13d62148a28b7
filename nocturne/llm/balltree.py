"""Exact top-k inner products by ball-tree branch and bound.

Candidates are dealt by place into cells around the centres of a bounded sample, at most CELLS; each cell is a ball whose
radius is measured over all of its vectors, and is dealt into shards of about SHARD. A first look at SEEDS candidates
gives each query the k-th best score that it has for certain. It then goes to cells in two waves: to the FIRST whose
balls have the greatest upper bounds q.c + |q| r, and, with the k-th score that all shards have given it by then, to
those others whose bound reaches that score, and to no more. In a task a ball tree is built over the shard; nodes are
visited in the order of their upper bounds, and a query follows only where the bound reaches its k-th best score so far.
Queries of a shard are dealt over blocks of about BLOCK, so no task grows with either table. Scores are integers and
exact in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

SHARD, BLOCK, LEAF, SEEDS, CELLS, FIRST = 16_384, 2_048, 128, 1_024, 256, 2
BOUND_SLACK = 1e-9


class Ball:
    """A node over rows lo..hi of the reordered points."""

    __slots__ = ("lo", "hi", "center", "radius", "children")

    def __init__(self, points: np.ndarray, order: np.ndarray, lo: int, hi: int):
        self.lo, self.hi = lo, hi
        own = points[order[lo:hi]]
        self.center = own.mean(axis=0)
        self.radius = float(np.sqrt(((own - self.center) ** 2).sum(axis=1).max()))
        self.children = []
        if hi - lo > LEAF and self.radius > 0:
            a = own[((own - self.center) ** 2).sum(axis=1).argmax()]
            b = own[((own - a) ** 2).sum(axis=1).argmax()]
            side = own @ (a - b)
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(side, mid)]
            self.children = [Ball(points, order, lo, lo + mid), Ball(points, order, lo + mid, hi)]


class Best:
    """The k best (score, id) of each query so far: greater scores first, then smaller ids."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        self.floor = floor

    def bar(self, q: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[q, -1], self.floor[q])

    def add(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        take = min(self.k, scores.shape[1])
        if scores.shape[1] > 4 * self.k:  # all scores that reach the k-th best, ties included
            enough = np.partition(scores, scores.shape[1] - take, axis=1)[:, scores.shape[1] - take]
            cols = np.flatnonzero((scores >= np.maximum(enough, self.bar(q))[:, None]).any(axis=0))
            if not len(cols):
                return
            scores, ids = scores[:, cols], ids[cols]
        s = np.concatenate([self.score[q], scores], axis=1)
        i = np.concatenate([self.id[q], np.broadcast_to(ids, scores.shape)], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[q], self.id[q] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def search(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> Best:
    """Exact top k of every query among points whose id is not the query's own."""
    best = Best(len(queries), k, floor)
    if not len(points) or not len(queries):
        return best
    order = np.arange(len(points))
    root = Ball(points, order, 0, len(points))
    points, ids = points[order], ids[order]
    norm = np.sqrt((queries**2).sum(axis=1))
    bound = lambda node, q: (queries[q] @ node.center + norm[q] * node.radius) * (1 + BOUND_SLACK) + BOUND_SLACK + np.abs(queries[q] @ node.center) * 2 * BOUND_SLACK
    stack = [(root, np.arange(len(queries)))]
    while stack:
        node, q = stack.pop()
        q = q[bound(node, q) >= best.bar(q)]
        if not len(q):
            continue
        if node.children:
            # each query goes first where its own bound is greater
            a, b = node.children
            left = bound(a, q) >= bound(b, q)
            for near, far, some in ((a, b, q[left]), (b, a, q[~left])):
                if len(some):
                    stack += [(far, some), (near, some)]
        else:
            scores = queries[q] @ points[node.lo : node.hi].T
            scores[own[q][:, None] == ids[None, node.lo : node.hi]] = -np.inf
            best.add(q, scores, ids[node.lo : node.hi])
    return best


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        order = np.argsort(right.column("vec_id").to_numpy(), kind="stable")
        points, ids = _matrix(right.column("v"))[order], right.column("vec_id").to_numpy()[order]
        q = left.column("vec_id").to_numpy()
        best = search(points, ids, _matrix(left.column("v")), q, k, left.column("floor").to_numpy())
        there = np.isfinite(best.score)
        return pa.table({"query_id": np.repeat(q, k)[there.ravel()], "vec_id": best.id[there], "score": best.score[there].astype(np.int64)})

    return run


def nearest(table, centers: np.ndarray) -> np.ndarray:
    """The nearest centre of every vector."""
    x = _matrix(table.column("v"))
    return ((centers**2).sum(axis=1)[None, :] - 2 * x @ centers.T).argmin(axis=1)


def _place(shared):
    """The cell of every row."""

    def run(batches):
        centers = shared.value
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("cell", pa.array(nearest(batch, centers).astype(np.int32)))

    return run


def _reach(shared):
    """For the rows of a batch, by cell: greatest distance from the cell's centre."""

    def run(batches):
        centers = shared.value
        for batch in batches:
            if batch.num_rows:
                x, cell = _matrix(batch.column("v")), batch.column("cell").to_numpy()
                most = np.zeros(len(centers))
                np.maximum.at(most, cell, np.sqrt(((x - centers[cell]) ** 2).sum(axis=1)))
                met = np.unique(cell)
                yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(most[met])], ["cell", "radius"])

    return run


def _route(shared, first: bool):
    """Each query with every cell that it has to see in this wave."""

    def run(batches):
        centers, radius, cells = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            q, floor = _matrix(batch.column("v")), batch.column("floor").to_numpy()
            bound = q @ centers.T + np.sqrt((q**2).sum(axis=1))[:, None] * radius[None, :]
            bound += np.abs(bound) * 1e-9 + 1e-6
            take = min(FIRST, len(cells)) - 1
            seen = bound >= -np.partition(-bound, take, axis=1)[:, take][:, None]
            rows, at = np.nonzero((seen if first else ~seen) & (bound >= floor[:, None]))
            yield batch.take(pa.array(rows)).append_column("cell", pa.array(cells[at]))

    return run


def _usable(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id and v = floor(scale * x) of the vectors that can take part."""
    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(ok & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("v"))


def top_k(vectors: DataFrame, queries, k: int = 5, scale: float = 256.0) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank, vec_id, score: for each row that the condition ``queries`` picks,
    the k rows of other vec_id with the greatest inner product of floor(scale * x), ties to the smaller vec_id; all of
    them where there are fewer than k.

    Vectors that are null, empty or hold null or non-finite components take no part; vectors of different lengths raise
    ValueError. vec_id is taken as a key: of repeated rows with one vec_id the least vector is used. Extra columns are
    ignored; an empty table gives no rows.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "topk")
    rows = scratch.save(_usable(vectors, scale).groupBy("vec_id").agg(F.min("v").alias("v")), "rows")
    lengths = [r[0] for r in rows.select(F.size("v")).distinct().limit(2).collect()]
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(lengths)} and perhaps others")
    n = rows.count()
    seeds = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEEDS).toArrow()
    sample, ids = _matrix(seeds.column("v")), seeds.column("vec_id").to_numpy()
    cells = min(CELLS, max(1, n // SHARD))
    centers = sample[np.random.default_rng(7).permutation(len(sample))[:cells]] if len(sample) else np.zeros((1, 0))
    for _ in range(8 if cells > 1 else 0):  # k-means of the sample
        of = ((centers**2).sum(axis=1)[None, :] - 2 * sample @ centers.T).argmin(axis=1)
        some = np.flatnonzero(np.bincount(of, minlength=cells))
        centers[some] = [sample[of == c].mean(axis=0) for c in some]
    shared = spark.sparkContext.broadcast(centers)
    placed = scratch.save(rows.mapInArrow(_place(shared), "vec_id long, v array<double>, cell int"), "placed")
    each = placed.groupBy("cell").agg(F.ceil(F.count("*") / SHARD).cast("long").alias("parts"))
    each = scratch.save(each.join(placed.mapInArrow(_reach(shared), "cell int, radius double").groupBy("cell").agg(F.max("radius").alias("radius")), "cell"), "cells")
    balls = each.toArrow()  # at most CELLS rows, as is every broadcast of cells
    met = balls.column("cell").to_numpy()
    many = spark.sparkContext.broadcast((centers[met], balls.column("radius").to_numpy(), met))
    each = F.broadcast(each.select("cell", "parts"))
    number = lambda part: (F.col("cell").cast("long") * (1 << 32) + part).alias("shard")
    placed = placed.join(each, "cell").select("vec_id", "v", number(F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.col("parts"))))
    first = spark.sparkContext.broadcast((sample, ids))

    def floors(batches):
        points, own = first.value
        for batch in batches:
            if not batch.num_rows:
                continue
            q = batch.column("vec_id").to_numpy()
            best = search(points, own, _matrix(batch.column("v")), q, k, np.full(len(q), -np.inf))
            yield batch.append_column("floor", pa.array(best.score[:, -1]))

    asked = scratch.save(rows.where(queries).mapInArrow(floors, "vec_id long, v array<double>, floor double"), "queries")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    found = None
    for wave in (True, False):
        if not wave:  # the k-th score so far is shared by all shards that are left
            kth = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("kth"))
            asked = asked.join(kth, "vec_id", "left").select("vec_id", "v", F.greatest("floor", F.coalesce("kth", "floor")).alias("floor"))
        routed = asked.mapInArrow(_route(many, wave), "vec_id long, v array<double>, floor double, cell int").join(each, "cell")
        left = scratch.save(routed.select("vec_id", "v", "floor", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).select("vec_id", "v", "floor", number(F.col("part"))), "routed")
        blocks = left.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        blocks = F.broadcast(blocks)  # one row of a few bytes for SHARD vectors
        left = left.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")
        right = placed.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        new = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
        new = new if found is None else new.unionByName(found.drop("rank"))
        found = scratch.save(new.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "found")
    return found


def op3_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256.0 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
 r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
