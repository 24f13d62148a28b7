"""Operators on vectors against brute force, with odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nocturne.llm import balltree, rptree


def vectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        v = rng.standard_normal(16)
        if i % 4 == 1:
            v = np.array(rows[-1][1]) * 2
        elif i % 4 == 2:
            v = np.array(rows[-1][1]) + rng.standard_normal(16) * 0.12
        rows.append((i, [float(x) for x in v], i // 4 % 3, "x", 1))
    rows += [(400, None, 1, "x", 1), (401, [], 1, "x", 1), (402, [0.0] * 16, 1, "x", 1), (403, [float("nan")] * 16, 1, "x", 1), (404, [None] * 16, 1, "x", 1), (405, rows[0][1], None, "x", 1), (406, rows[0][1], 0, "x", 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links string, rank int")


@pytest.mark.parametrize("bucket", [8_192, 48])
def test_near_vectors(spark, monkeypatch, bucket):
    monkeypatch.setattr(rptree, "BUCKET", bucket)  # with 48 the forest is grown over several rounds
    monkeypatch.setattr(rptree, "SAMPLE", 100 if bucket == 48 else rptree.SAMPLE)
    monkeypatch.setattr(rptree, "LEAF", 24 if bucket == 48 else rptree.LEAF)
    rows, df = vectors(spark)
    fine = [i for i, r in enumerate(rows) if r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    x = np.array([rows[i][1] for i in fine])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([rows[i][2] for i in fine])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    low = np.array(fine)
    while True:
        new = np.where(near, low[None, :], 10**9).min(axis=1)
        if (new == low).all():
            break
        low = new
    links, comp = {i: int(n) - 1 for i, n in zip(fine, near.sum(axis=1), strict=True)}, dict(zip(fine, low.tolist(), strict=True))
    assert sum(links.values()) > 100
    got = rptree.near_vectors(df).collect()
    assert len(got) == len(rows)
    for r in got:
        c = comp.get(r.vec_id, r.vec_id)
        assert (r.n_links, r.component_id, r.kept) == (links.get(r.vec_id, 0), c, c == r.vec_id)
    assert rptree.near_vectors(df.limit(0)).count() == 0


def test_top_k(spark):
    rows, df = vectors(spark)
    fine = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    v = {r[0]: np.floor(256 * np.array(r[1])) for r in fine}
    expected = set()
    for q in (i for i in v if i % 50 == 0):
        best = sorted((-int(v[q] @ v[i]), i) for i in v if i != q)[:5]
        expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in balltree.top_k(df, F.col("vec_id") % 50 == 0).collect()}
    assert got == expected
    few = df.where("vec_id < 3")
    assert balltree.top_k(few, F.col("vec_id") == 0).count() == 2
    assert balltree.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_ball_tree_visits_in_bounds():
    rng = np.random.default_rng(3)
    points, queries = np.floor(rng.standard_normal((3000, 8)) * 50), np.floor(rng.standard_normal((40, 8)) * 50)
    best = balltree.search(points, np.arange(3000), queries, np.full(40, -1), 5, np.full(40, -np.inf))
    for q in range(40):
        s = points @ queries[q]
        order = np.lexsort((np.arange(3000), -s))[:5]
        assert best.id[q].tolist() == order.tolist() and best.score[q].tolist() == s[order].tolist()


def linked_by_force(x, cosine=0.98):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    return u @ u.T >= cosine


def test_forest_finds_every_link_beyond_its_buckets(spark, monkeypatch):
    """4 000 vectors of one label in buckets of 200: pairs just within the threshold, and a crowd that no cut parts."""
    monkeypatch.setattr(rptree, "BUCKET", 200)
    monkeypatch.setattr(rptree, "SAMPLE", 400)
    monkeypatch.setattr(rptree, "LEAF", 50)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((1600, 32))
    pairs = base + rng.standard_normal(base.shape) * 0.19  # cosines around 0.98
    crowd = rng.standard_normal(32) + rng.standard_normal((800, 32)) * 0.11
    x = np.concatenate([base, pairs, crowd])
    near = linked_by_force(x)
    near &= ~np.eye(len(x), dtype=bool)
    assert 400 < near[:1600, 1600:3200].diagonal().sum() < 1500
    low = np.arange(len(x))
    while True:
        new = np.minimum(low, np.where(near, low[None, :], len(x)).min(axis=1))
        if (new == low).all():
            break
        low = new
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in rptree.near_vectors(df).collect()}
    assert [got[i].n_links for i in range(len(x))] == near.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(len(x))] == low.tolist()


def test_crowds_are_compared_in_blocks(spark):
    """Vectors that are all near one but a few: the crowd's links by force, in components."""
    from nocturne.llm.components import connected_components
    from nocturne.llm.scratch import Scratch

    rng = np.random.default_rng(6)
    center = rng.standard_normal(16)
    far = rng.standard_normal((50, 16)) * 2
    x = np.concatenate([center + rng.standard_normal((600, 16)) * 0.16, far, far + rng.standard_normal((50, 16)) * 0.1])
    df = spark.createDataFrame([(i, v.tolist(), 1, 16) for i, v in enumerate(x)], "id long, embedding array<double>, label long, dim int")
    crowd = df.select("id", "label", "dim", F.lit(0).alias("tree"), F.lit(1).cast("long").alias("node"))
    scratch = Scratch(spark, "t")
    ties = rptree._crowd_edges(crowd, df, 0.98, scratch)
    got = {r.id: r.component for r in connected_components(ties, scratch).collect()}
    near, low = linked_by_force(x), np.arange(700)
    while True:
        new = np.where(near, low[None, :], 700).min(axis=1)
        if (new == low).all():
            break
        low = new
    assert len(set(low.tolist())) > 1
    assert [got.get(i, i) for i in range(700)] == low.tolist()


def test_least_linked_by_force():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = rng.permutation(1000)[:300]
    low = ids.copy()
    while True:
        new = np.where(x @ x.T >= 0.98, low[None, :], 10**9).min(axis=1)
        if (new == low).all():
            break
        low = new
    assert rptree.least_linked(x, ids, 0.98).tolist() == low.tolist()


def test_top_k_over_cells_and_shards(spark, monkeypatch):
    for name, value in (("SHARD", 60), ("BLOCK", 5), ("SEEDS", 40), ("CELLS", 6), ("LEAF", 16)):
        monkeypatch.setattr(balltree, name, value)
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.standard_normal((500, 6)) + c for c in rng.standard_normal((4, 6)) * 4])
    x[700:720] = x[3]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[5].tolist())], "vec_id long, embedding array<double>")
    v = np.floor(256 * x)
    expected = set()
    for q in range(0, len(x), 50):
        s = v @ v[q]
        s[q] = -np.inf
        expected |= {(q, k + 1, int(i), int(s[i])) for k, i in enumerate(np.lexsort((np.arange(len(x)), -s))[:5])}
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in balltree.top_k(df, F.col("vec_id") % 50 == 0).collect()}
    assert got == expected


def test_ragged_vectors_raise(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="different lengths"):
        balltree.top_k(df, F.col("vec_id") == 0)
