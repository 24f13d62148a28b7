"""Near-duplicate documents by MinHash, banding, verification on full shingle sets and star components.

1. One pass over the texts gives each document the hash of its shingle set and ``BANDS * ROWS`` minima of universal
   hashes a*x+b. Documents with equal sets are one class; the least doc_id of each goes on.
2. Bands of minima are bucket keys. First each document is verified against one bucket minimum, that with which it
   shares most bands: one pair a document at most, whatever the bucket sizes.
3. In buckets whose members are not yet in one component, the members outside the largest one are compared with all
   others, in blocks of about ``BLOCK`` by ``BLOCK``, on their sets of 32-bit shingle hashes; a block gives each member
   its most similar partner of every other component within reach of the threshold. These are verified on full sets of 128-bit
   identities, two independent 64-bit hashes of the words.
   So every pair that shares a bucket is verified, inside one component, or compared in a block; no group is expanded
   into its pairs.

With 6 rows in 24 bands a pair at similarity 0.85 shares no band with probability 1.1e-5, at 0.8 with 6.6e-4.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch
from .text import LOWER, Ranges, U, runs, sized, utf8, whole_groups, word_hashes

BANDS, ROWS, BLOCK = 24, 6, 128
HASHES = BANDS * ROWS
_rng = np.random.default_rng(20240607)
A = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def signature(shingle_hashes: np.ndarray) -> np.ndarray:
    """Minima of all universal hashes over a set, 4096 elements at a time."""
    x = (shingle_hashes >> U(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        y = A[:, None] * x[None, i : i + 4096]
        y += B[:, None]
        np.minimum(out, y.min(axis=1), out=out)
    return out


def identities(one: np.ndarray, two: np.ndarray, k: int) -> np.ndarray:
    """The distinct runs of k words of one text as sorted rows of 128 bits; one, two: hashes of its words by two seeds."""
    a, b = runs(one, k), runs(two, k)
    order = np.argsort(a)
    a, b = a[order], b[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():  # different runs of one 64-bit hash
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.stack([a[new], b[new]], axis=1)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sets of identities()."""
    if all(len(x) < 2 or (x[1:, 0] != x[:-1, 0]).all() for x in (a, b)):
        _, i, j = np.intersect1d(a[:, 0], b[:, 0], assume_unique=True, return_indices=True)
        return int((a[i, 1] == b[j, 1]).sum())
    return len(set(map(tuple, a.tolist())) & set(map(tuple, b.tolist())))


def _per_text(batches, words: int):
    """Ids of a slice and the identities of each text's shingles."""
    for batch in sized(batches, "text"):
        data, offsets = utf8(batch.column("text"))
        h, row, start, end = word_hashes(data, offsets)
        g = Ranges(LOWER[data], 1)(start, end)
        cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
        yield batch.column("doc_id"), [identities(h[i:j], g[i:j], words) for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _sketch(words: int):
    def run(batches):
        for ids, sets in _per_text(batches, words):
            n = np.array([len(s) for s in sets], np.int64)
            h1 = np.array([np.bitwise_xor.reduce(s[:, 0]) if len(s) else 0 for s in sets], U).view(np.int64)
            h2 = np.array([s[:, 1].sum(dtype=U) if len(s) else 0 for s in sets], U).view(np.int64)
            sig = [signature(s[:, 0]).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(h1), pa.array(h2), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "h1", "h2", "sig"])

    return run


def _sets(words: int):
    def run(batches):
        for ids, sets in _per_text(batches, words):
            yield pa.RecordBatch.from_arrays([ids, pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "shingles"])

    return run


def _confirm(percent: int):
    """Of pairs with their full sets, those that reach the threshold."""

    def run(batches):
        for batch in batches:
            sets = ([np.frombuffer(x.as_buffer(), U).reshape(-1, 2) for x in batch.column(c)] for c in ("sa", "sb"))
            both = np.array([(common(x, y), len(x) + len(y)) for x, y in zip(*sets, strict=True)], np.int64).reshape(-1, 2)
            linked = pa.array(100 * both[:, 0] >= percent * (both[:, 1] - both[:, 0]))
            yield batch.select(["a", "b"]).filter(linked)

    return run


def _small_sets(words: int):
    def run(batches):
        for ids, sets in _per_text(batches, words):
            yield pa.RecordBatch.from_arrays([ids, pa.array([np.unique((s[:, 0] >> U(32)).astype(np.uint32)).tobytes() for s in sets], pa.binary())], ["id", "small"])

    return run


def _bands(batches):
    for batch in batches:
        n = batch.num_rows
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(n, BANDS, ROWS).astype(U)
        key = np.zeros((n, BANDS), U)
        for r in range(ROWS):
            key = (key ^ sig[:, :, r]) * U(0x9FB21C651E98DF25)
            key ^= key >> U(29)
        key = (key + np.arange(BANDS, dtype=U)) * U(0xD6E8FEB86659FD93)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column("doc_id").to_numpy(), BANDS))], ["key", "id"])


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    needed = scratch.save(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "needed")
    sets = scratch.save(docs.join(needed, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_sets(words), "doc_id long, shingles binary"), "sets")
    one = lambda c: sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"s{c}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b")
    out = scratch.save(both.select("a", "b", "sa", "sb").mapInArrow(_confirm(percent), "a long, b long"), "links")
    scratch.drop(needed, sets)
    return out


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of left and right sets, by the product of their incidence matrices."""
    n = np.array([len(s) for s in sets])
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), n)
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    for lo in range(0, at[-1] + 1, 8192):  # columns of the matrices, so many at a time
        a, b = np.searchsorted(at, [lo, lo + 8192])
        both = np.zeros((len(sets), 8192), np.float32)
        both[row[a:b], at[a:b] - lo] = 1
        out += both[left] @ both[right].T
    return out


def _propose(percent: int):
    """For each member on the left of a block, its most similar partner of each other component on the right."""

    def run(batches):
        for t, cuts in whole_groups(batches, ["key", "i", "j"]):
            ids, comp, left = (t.column(c).to_numpy() for c in ("id", "comp", "left"))
            column = t.column("small")
            a, b = [], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                l, r = np.flatnonzero(left[lo:hi]), np.flatnonzero(~left[lo:hi])
                if not len(l) or not len(r):
                    continue
                sets = [np.frombuffer(x.as_py(), np.uint32) for x in column.slice(lo, hi - lo)]
                size = np.array([len(s) for s in sets], np.float64)
                common = _overlaps(sets, l, r).astype(np.float64)
                # two of the 32-bit hashes may be equal by chance, so one element more or less is allowed for
                fits = 100 * (common + 1) >= percent * (size[l][:, None] + size[r][None, :] - common - 1)
                fits &= comp[lo:hi][l][:, None] != comp[lo:hi][r][None, :]
                x, y = np.nonzero(fits)
                if not len(x):
                    continue
                near = common[x, y] / (size[l[x]] + size[r[y]] - common[x, y])
                order = np.lexsort((-near, comp[lo:hi][r[y]], x))
                x, y = x[order], y[order]
                c = comp[lo:hi][r[y]]
                first = np.ones(len(x), bool)
                first[1:] = (x[1:] != x[:-1]) | (c[1:] != c[:-1])
                p, q = ids[lo:hi][l[x[first]]], ids[lo:hi][r[y[first]]]
                a.append(np.minimum(p, q))
                b.append(np.maximum(p, q))
            both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1) if a else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered. A text with fewer words than ``words`` is one shingle; null,
    empty and blank texts have none, link with nothing and are their own component. Equal sets are linked. Rows that
    repeat a doc_id give repeated rows of one component. Extra columns are ignored. An empty table gives none. doc_id
    must not be null: rows with a null doc_id are returned with a null component and are kept.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = scratch.save(docs.mapInArrow(_sketch(words), "doc_id long, n_shingles long, h1 long, h2 long, sig binary"), "sketch")
    full = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = scratch.save(full.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    member = scratch.save(full.select("doc_id", "h1", "h2", "n_shingles").join(classes, ["h1", "h2", "n_shingles"]).select("doc_id", "rep"), "member")
    reps = full.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "sig").dropDuplicates(["doc_id"])
    bands = scratch.save(reps.mapInArrow(_bands, "key long, id long"), "bands")
    buckets = scratch.save(bands.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1"), "buckets")
    shared = scratch.save(bands.join(buckets.select("key", "least"), "key"), "shared")
    scratch.drop(bands, buckets)
    near = shared.where("id != least").groupBy("id", "least").agg(F.count("*").alias("n"))
    best = near.groupBy("id").agg(F.max_by("least", F.struct("n", -F.col("least"))).alias("least"))
    pairs = scratch.save(best.select(F.col("least").alias("a"), F.col("id").alias("b")), "pairs")
    links = _verified(pairs, docs, words, percent, scratch)
    comps = scratch.save(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch), "comps")
    more = _cross_links(shared, comps, docs, words, percent, scratch)
    links = links.unionByName(_verified(more, docs, words, percent, scratch))
    comps = scratch.save(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch), "comps")
    of = member.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id")).distinct()
    out = sketch.select("doc_id", "n_shingles").join(of, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def _cross_links(shared: DataFrame, comps: DataFrame, docs: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs of different components that share a bucket and are alike on 32-bit hashes; see step 3 above."""
    now = scratch.save(shared.select("key", "id").join(comps, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp")), "now")
    per = now.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top"))
    per = per.where("c > 1").select("key", F.col("top.comp").alias("main"), F.ceil(F.col("n") / BLOCK).cast("int").alias("kr"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("kl"))
    rows = scratch.save(now.join(scratch.save(per, "split"), "key"), "rows")
    needed = scratch.save(rows.select(F.col("id").alias("doc_id")).distinct(), "needed")
    small = scratch.save(docs.join(needed, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_small_sets(words), "id long, small binary"), "small")
    spread = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    home = lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("int")
    left = rows.where("comp != main").select("key", "id", "comp", F.lit(True).alias("left"), home("kl").alias("i"), spread("kr").alias("j"))
    right = rows.select("key", "id", "comp", F.lit(False).alias("left"), spread("kl").alias("i"), home("kr").alias("j"))
    wide = left.unionByName(right).join(small, "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = scratch.save(wide.mapInArrow(_propose(percent), "a long, b long").distinct(), "proposed")
    scratch.drop(now, rows, needed, small)
    return found


def op10_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), words=3, percent=85)
