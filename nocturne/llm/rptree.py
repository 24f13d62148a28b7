"""Near-duplicate vectors by a forest of random-projection trees with spill.

1. Equal vectors of a label are one class; its least vec_id goes on with the class's size.
2. Each of TREES trees splits the unit vectors of a label at the median of random projections; vectors within MARGIN
   of a cut go to both sides. Trees grow in rounds: every bucket that is counted at more than BUCKET vectors is cut on,
   down to about BUCKET, by medians of at most SAMPLE of its own vectors, so buckets are of that size however large the
   table or small the label. Buckets move between rounds as ids; a round reads the vectors of large buckets alone. In
   the bucket the tree goes on with true medians down to leaves of LEAF. Every row is indexed. A crowd of near copies
   that no cut parts stays one bucket: its vectors are first compared with one of them, and those that are not linked
   with it, which are few or the crowd would have been cut, with all, in blocks.
3. Within a leaf all cosines are taken in double precision; a leaf gives one row for each linked vector, its least
   partner by links in the leaf. The union over trees goes through connected components.
4. Links exist inside components only, so exact link counts come from comparing each component with itself, in blocks
   of BLOCK by BLOCK; only counts leave a block.

A pair at cosine 0.98 has projections that differ by 0.025 (one standard deviation); a tree parts it only if they lie
beyond the margin on both sides of a median, which happens to about 2 % of pairs a tree and so to fewer than 1e-9 in all.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch
from .text import whole_groups

COSINE, TREES, MARGIN, LEAF, BUCKET, SAMPLE, BLOCK = 0.98, 6, 0.02, 256, 8_192, 32_768, 256


def unit(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def direction(dim: int, *seed: int) -> np.ndarray:
    v = np.random.default_rng(list(seed)).standard_normal(dim)
    return v / np.sqrt(v @ v)


def leaves(x: np.ndarray, rows: np.ndarray, rng: np.random.Generator):
    """Row numbers of each leaf of a tree over x[rows]."""
    stack = [rows]
    while stack:
        rows = stack.pop()
        parts = None
        for _ in range(3 if len(rows) > LEAF else 0):
            p = x[rows] @ direction(x.shape[1], int(rng.integers(1 << 62)))
            mid = np.median(p)
            left, right = p <= mid + MARGIN, p >= mid - MARGIN
            if max(left.sum(), right.sum()) <= 0.8 * len(rows):
                parts = rows[left], rows[right]
                break
        if parts:
            stack += parts
        else:
            yield rows


def least_linked(x: np.ndarray, ids: np.ndarray, cosine: float) -> np.ndarray:
    """For each row of a leaf, the least id that links within the leaf reach. Components are found one after another from
    a row outwards, so a crowd around one row costs its size and not the square of it."""
    low, left = ids.copy(), np.arange(len(x))
    while len(left):
        found, front, left = [left[:1]], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for i in range(0, len(front), 1024):
                near |= (x[front[i : i + 1024]] @ x[left].T >= cosine).any(axis=0)
            front, left = left[near], left[~near]
            found.append(front)
        own = np.concatenate(found)
        low[own] = ids[own].min()
    return low


def cuts_of(x: np.ndarray, tree: int, node: int, size: int) -> list[tuple[int, float]]:
    """Cuts (node, projection) below a node of ``size`` vectors, of which x is a sample, down to BUCKET or to where the
    sample is down to 64. Node n has children 2n and 2n + 1; the direction of a cut follows from tree and depth."""
    out, stack = [], [(node, np.arange(len(x)))]
    while stack:
        node, rows = stack.pop()
        if len(rows) < 64 or len(rows) * size <= BUCKET * len(x) or node >= 1 << 60:
            continue
        p = x[rows] @ direction(x.shape[1], tree, node.bit_length())
        mid = float(np.median(p))
        left, right = p <= mid + MARGIN, p >= mid - MARGIN
        if max(left.sum(), right.sum()) <= 0.8 * len(rows):
            out.append((node, mid))
            stack += [(2 * node, rows[left]), (2 * node + 1, rows[right])]
    return out


def _fit(key, table):
    tree, node = key[0].as_py(), key[3].as_py()
    cuts = cuts_of(unit(table.column("embedding")), tree, node, int(table.column("size")[0].as_py()))
    names = {"tree": pa.int32(), "label": pa.int64(), "dim": pa.int32(), "node": pa.int64(), "at": pa.list_(pa.int64()), "mid": pa.list_(pa.float64())}
    row = (tree, key[1].as_py(), key[2].as_py(), node, [n for n, _ in cuts], [m for _, m in cuts])
    return pa.table({k: pa.array([v], t) for (k, t), v in zip(names.items(), row, strict=True)})


def _descend(batches):
    """Rows of a bucket with its cuts -> the buckets below in which each row is."""
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, node, dim = (batch.column(c).to_numpy() for c in ("tree", "node", "dim"))
        rows, nodes = [], []
        tag = batch.column("label").to_numpy()
        key = np.stack([tree.astype(np.int64), tag, dim.astype(np.int64), node], axis=1)
        _, first, of = np.unique(key, axis=0, return_index=True, return_inverse=True)
        for i, f in enumerate(first.tolist()):
            own = np.flatnonzero(of == i)
            cuts = dict(zip(batch.column("at")[f].as_py(), batch.column("mid")[f].as_py(), strict=True))
            x = unit(batch.column("embedding").take(pa.array(own)))
            todo = [(int(node[f]), np.arange(len(own)))]
            while todo:
                n, at = todo.pop()
                if n in cuts:
                    p = x[at] @ direction(x.shape[1], int(tree[f]), n.bit_length())
                    todo += [(2 * n, at[p <= cuts[n] + MARGIN]), (2 * n + 1, at[p >= cuts[n] - MARGIN])]
                elif len(at):
                    rows.append(own[at])
                    nodes.append(np.full(len(at), n, np.int64))
        yield batch.select(["id", "label", "dim", "tree"]).take(pa.array(np.concatenate(rows))).append_column("node", pa.array(np.concatenate(nodes)))


BUCKET_KEY = ["tree", "label", "dim", "node"]


def _forest(classes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, label, dim, tree, node) of buckets of bounded size, and of crowds that no cut parts."""
    now = classes.select("id", "label", "dim", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), F.lit(1).cast("long").alias("node"))
    done, crowds, tried = [], [], None
    while True:
        now = scratch.save(now, "nodes")
        sizes = now.groupBy(*BUCKET_KEY).agg(F.count("*").alias("size"))
        if tried is not None:  # a bucket that was cut has other nodes now; one that no cut parted is a crowd
            sizes = sizes.join(tried, BUCKET_KEY, "left")
        sizes = sizes.withColumn("crowd", F.lit(False) if tried is None else F.col("uncut").isNotNull())
        large = scratch.save(sizes.where(F.col("size") > BUCKET).select(*BUCKET_KEY, "size", "crowd"), "large")
        small = now.join(large, BUCKET_KEY, "left_anti")
        done.append(small)
        crowds.append(now.join(large.where("crowd"), BUCKET_KEY, "left_semi"))
        large = large.where("NOT crowd").drop("crowd")
        if large.limit(1).count() == 0:
            break
        inside = now.join(large, BUCKET_KEY).join(classes.select("id", "embedding"), "id")
        share = F.pmod(F.xxhash64("id", "tree"), F.lit(1 << 30)) < F.lit(float(SAMPLE << 30)) / F.col("size")
        cuts = scratch.save(inside.where(share).groupBy(*BUCKET_KEY).applyInArrow(_fit, "tree int, label long, dim int, node long, at array<long>, mid array<double>"), "cuts")
        tried = cuts.where("size(at) = 0").select(*BUCKET_KEY, F.lit(True).alias("uncut"))
        now = inside.join(cuts, BUCKET_KEY).select("id", "label", "dim", "tree", "node", "embedding", "at", "mid").mapInArrow(_descend, "id long, label long, dim int, tree int, node long")
    join = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    return join(done), join(crowds)


def _near_pivot(cosine: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                near = (unit(batch.column("embedding")) * unit(batch.column("pivot"))).sum(axis=1) >= cosine
                yield batch.select(["id", "label", "dim", "tree", "node", "pivot_id"]).append_column("near", pa.array(near))

    return run


def _crowd_edges(crowds: DataFrame, classes: DataFrame, cosine: float, scratch: Scratch) -> DataFrame:
    """Links that tie together what is linked in each crowd: with one of its vectors, and of those that are not linked
    with that one, the least partner on every block of the crowd."""
    whole = scratch.save(crowds.join(classes.select("id", "embedding"), "id"), "crowds")
    pivots = whole.groupBy(*BUCKET_KEY).agg(F.min_by("embedding", "id").alias("pivot"), F.min("id").alias("pivot_id"), F.count("*").alias("size"))
    told = scratch.save(whole.join(pivots, BUCKET_KEY).mapInArrow(_near_pivot(cosine), "id long, label long, dim int, tree int, node long, pivot_id long, near boolean"), "told")
    ties = told.where("near AND id <> pivot_id").select(F.col("id").alias("u"), F.col("pivot_id").alias("v"))
    rest = told.where("NOT near")
    counts = rest.groupBy(*BUCKET_KEY).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("kl")).join(pivots.select(*BUCKET_KEY, F.ceil(F.col("size") / BLOCK).cast("int").alias("kr")), BUCKET_KEY)
    counts = scratch.save(counts, "rest")
    home = lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("int")
    spread = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    cell = F.xxhash64(*BUCKET_KEY).alias("component")
    left = whole.join(rest.select("id", *BUCKET_KEY), ["id", *BUCKET_KEY], "left_semi").join(counts, BUCKET_KEY).select(cell, "id", "embedding", F.lit(True).alias("left"), home("kl").alias("i"), spread("kr").alias("j"))
    right = whole.join(counts, BUCKET_KEY).select(cell, "id", "embedding", F.lit(False).alias("left"), spread("kl").alias("i"), home("kr").alias("j"))
    cells = left.unionByName(right).repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return ties.unionByName(cells.mapInArrow(_block_ties(cosine), "u long, v long"))


def _block_ties(cosine: float):
    """Of a block, a link of each left vector to one right vector of every component of the right ones within reach."""

    def run(batches):
        for t, cuts in whole_groups(batches, ["component", "i", "j"]):
            ids, left = t.column("id").to_numpy(), t.column("left").to_numpy()
            u, v = [], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                x = unit(t.column("embedding").slice(lo, hi - lo))
                own = ids[lo:hi]
                low = least_linked(x, own, cosine)
                tied = low != own
                u.append(own[tied])
                v.append(low[tied])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    return run


def _compare(cosine: float):
    def run(key, table):
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        ids = table.column("id").to_numpy()[order]
        x = unit(table.column("embedding"))[order]
        u, v = [], []
        for rows in leaves(x, np.arange(len(ids)), np.random.default_rng([int(key[0].as_py()), 11])):
            low = least_linked(x[rows], ids[rows], cosine)
            linked = low != ids[rows]
            u.append(ids[rows][linked])
            v.append(low[linked])
        pairs = np.unique(np.stack([np.concatenate(u), np.concatenate(v)]), axis=1) if u else np.zeros((2, 0), np.int64)
        return pa.table({"u": pairs[0], "v": pairs[1]})

    return run


def _count(cosine: float):
    """Links of each left row to the right rows of its block, each as many as its class has members."""

    def run(batches):
        for t, cuts in whole_groups(batches, ["component", "i", "j"]):
            ids, left, n = t.column("id").to_numpy(), t.column("left").to_numpy(), t.column("n").to_numpy()
            got_id, got = [], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                x = unit(t.column("embedding").slice(lo, hi - lo))
                l, r = left[lo:hi], ~left[lo:hi]
                near = (x[l] @ x[r].T >= cosine) & (ids[lo:hi][l][:, None] != ids[lo:hi][r][None, :])
                got_id.append(ids[lo:hi][l])
                got.append(near @ n[lo:hi][r])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got_id)), pa.array(np.concatenate(got).astype(np.int64))], ["id", "links"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vectors (vec_id, embedding, label) -> vec_id, n_links, component_id, kept; vectors of one label are linked if
    their cosine is at least ``cosine``.

    Vectors whose label is null or that are null, empty, zero or hold null or non-finite components link with nothing:
    0 links, a component of their own. Vectors of different lengths do not link. Rows that repeat a vec_id count as
    one vector. Extra columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "rptree")
    everyone = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    sound = F.size("embedding") > 0
    sound &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = everyone.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound & F.col("vec_id").isNotNull())
    classes = scratch.save(usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("n")).select("id", "n", "label", F.size("embedding").alias("dim"), "embedding"), "classes")
    member = scratch.save(usable.join(classes.select("label", "embedding", "id"), ["label", "embedding"]).select("vec_id", "id").distinct(), "member")
    dealt, crowds = _forest(classes, scratch)
    edges = dealt.join(classes.select("id", "embedding"), "id").groupBy(*BUCKET_KEY).applyInArrow(_compare(cosine), "u long, v long")
    edges = edges.unionByName(_crowd_edges(crowds, classes, cosine, scratch))
    comps = scratch.save(connected_components(edges, scratch), "components")
    inside = scratch.save(classes.select("id", "n", "embedding").join(comps, "id"), "inside")
    blocks = scratch.save(inside.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k")), "blocks")
    inside = inside.join(blocks, "component")
    home, spread = F.pmod(F.xxhash64("id"), F.col("k")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    cells = inside.select("component", "id", "n", "embedding", F.lit(True).alias("left"), home.alias("i"), spread.alias("j"))
    cells = cells.unionByName(inside.select("component", "id", "n", "embedding", F.lit(False).alias("left"), spread.alias("i"), home.alias("j")))
    cells = cells.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    links = cells.mapInArrow(_count(cosine), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    facts = scratch.save(classes.select("id", "n").join(comps, "id", "left").join(links, "id", "left").select("id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "facts")
    known = member.join(facts, "id").select("vec_id", "n_links", "component_id")
    out = everyone.select("vec_id").join(known, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op2_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
