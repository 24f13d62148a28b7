"""Segmentation kernels on small images."""

import numpy as np

from nocturne.kernels import watershed as ws


def hill(shape, *peaks):
    r, c = np.mgrid[: shape[0], : shape[1]]
    return sum(h * np.exp(-((r - a) ** 2 + (c - b) ** 2) / (2 * s**2)) for a, b, s, h in peaks)


def test_components_down_the_columns():
    m = np.array([[0, 0, 1], [1, 0, 0], [0, 0, 1]], bool)
    assert ws.components(m).tolist() == [[0, 0, 2], [1, 0, 0], [0, 0, 3]]
    assert ws.components(np.eye(5, dtype=bool)).max() == 1


def test_minima_of_plateaus():
    x = np.array([[3.0, 3, 3, 3], [3, 1, 1, 3], [3, 3, 2, 2], [3, 3, 2, 0]])
    m = ws.minima(x)
    assert m.sum() == 3 and m[1, 1] and m[1, 2] and m[3, 3]
    assert ws.minima(np.array([[np.nan, 1.0], [2.0, 3.0]])).tolist() == [[False, True], [False, False]]


def test_two_basins_and_their_line():
    x = np.abs(np.arange(7.0) - 3)[None, :].repeat(3, 0) * -1
    out = ws.watershed(x)
    assert (out[:, :3] == 1).all() and (out[:, 3] == 0).all() and (out[:, 4:] == 2).all()


def test_merging():
    height = hill((20, 40), (10, 10, 4, 10.0), (10, 20, 4, 10.0), (10, 33, 2.5, 9.0))
    label = ws.basins(-height)
    assert label.max() == 3
    names = lambda x: set(np.unique(x).tolist()) - {0}
    assert len(names(ws.merge(label, height, 1e9))) == 3
    assert len(names(ws.merge(label, height, -1e9))) == 1
    # the third hill's only neighbour is the survivor of the first merge, so it is taken in at any weight
    assert len(names(ws.merge(label, height, 0.0))) == 1
    four = hill((20, 52), (10, 10, 4, 10.0), (10, 20, 4, 10.0), (10, 33, 2.5, 9.0), (10, 45, 3, 9.0))
    merged = ws.merge(ws.basins(-four), four, 0.0)
    assert len(names(merged)) == 3 and merged[10, 10] == merged[10, 20] != merged[10, 33]
    assert names(ws.paint(merged)) == {1, 2, 3}


def test_outline():
    m = np.zeros((5, 5), bool)
    m[1:4, 1:4] = True
    line = ws.outline(m)
    assert line[0] == line[-1] == (1, 1) and len(line) == 9 and len(set(line)) == 8 and line[1] == (1, 2)
    assert ws.outline(np.eye(3, dtype=bool) & False) == []
    one = np.zeros((3, 3), bool)
    one[1, 1] = True
    assert ws.outline(one) == [(1, 1)]


def test_resize_is_aligned():
    from nocturne.kernels import regions

    line = lambda n, m: regions.resize(np.arange(1, n + 1)[None, :], (1, m))[0].tolist()
    assert line(4, 7) == [1, 1, 2, 3, 3, 4, 4]
    assert line(6, 11) == [1, 1, 2, 2, 3, 4, 4, 5, 5, 6, 6]
    assert sum(line(286, 571)) == 81939 and line(12, 23)[11] == 6


def test_grow_trim_and_mask():
    from nocturne.kernels import regions

    label = np.zeros((3, 7), int)
    label[1, 1], label[1, 5] = 2, 1
    assert regions.grow(label, 2)[1].tolist() == [2, 2, 2, 1, 1, 1, 1]
    value = hill((21, 21), (10, 10, 4, 10.0))
    whole = np.ones((21, 21), int)
    cut = regions.trim(whole, value, 0.8, 0.0)
    share = value[cut > 0].sum() / value.sum()
    assert 0.8 <= share < 0.85 and cut[10, 10] == 1 and cut[0, 0] == 0
    ring = np.ones((5, 5))
    ring[2, 2] = 0.0
    ring[0, 0] = 0.1
    assert regions.trim(np.ones((5, 5), int), ring, 0.9, 0.0)[2, 2] == 1
    label = np.zeros((5, 5), int)
    label[1:4, 1:4] = 1
    out = regions.second_pass(np.ones((5, 5)), np.arange(5.0), label, np.arange(5.0))
    assert out.sum() == 1 and out[2, 2] == 1
    assert np.allclose(regions.blur(np.full((6, 6), 3.0), 1.5), 3.0)


def test_so_phase():
    from nocturne.kernels import filters, regions

    t = np.arange(40_000) / 100
    phase = regions.so_phase(np.cos(2 * np.pi * 0.8 * t), filters.cheby1_sos(4, 0.2, (0.3, 1.5), 100.0, "bandpass"))
    middle = phase[15_000:-15_000]  # away from the ends, where each section reflects anew
    assert abs(np.diff(middle).mean() - 2 * np.pi * 0.008) < 1e-4


def ring(columns=13):
    """Two halves of a ring, 1 and 2, around 3; 4 borders the ring, 5 borders 4 alone."""
    rows = ["1110222044055", "1100022044055", "1003002044055", "1100022044055", "1110222044055"]
    label = np.array([[int(x) for x in r] for r in rows])
    value = np.where(label > 0, 10.0, 0.5)
    value[:, 7] = value[:, 10] = 0.2
    value[[0, 4], 3] = 9.0
    value[2, 3] = 1.0
    return label[:, :columns], value[:, :columns]


def test_a_merge_takes_in_what_has_no_other_neighbour():
    label, value = ring()
    one = ws.merged(label, value, 0.0, 1)
    assert sorted(one) == [1, 4, 5] and 2 + 3 * 5 in one[1].inside
    assert sorted(ws.merged(*ring(10), 0.0, 1)) == [1]  # at the edge, 4 has no other neighbour either
    assert sorted(ws.merged(label, value, 0.0, 1, absorb=False)) == [1, 3, 4, 5]


def test_an_edge_at_the_threshold():
    label = np.array([[1, 1, 0, 2, 2]] * 2)
    value = np.array([[10.0, 10, 5, 10, 10]] * 2)
    assert len(ws.merged(label, value, -5.0)) == 2
    assert len(ws.merged(label, value, -5.0, absorb=False)) == 1
    assert ws.merge(label, value, 100.0, view="border").tolist() == [[1, 1, 2, 2, 2]] * 2
    assert ws.merge(label, value, -6.0, view="every").tolist() == [[1, 1, 1, 1, 1]] * 2
    assert ws.merge(label, value, -6.0).tolist() == [[1, 1, 0, 1, 1]] * 2


def test_regions_of_a_segment():
    from nocturne.operators.peaks import regions_of, wide_enough

    image = hill((20, 60), (10, 12, 4, 10.0), (10, 45, 4, 10.0))
    label = regions_of(image)
    assert set(np.unique(label)) == {0, 1, 2} and label[10, 12] != label[10, 45]
    small = regions_of(image, stride=(2, 2), reach=3)
    assert small.shape == image.shape and len(np.unique(small)) == 3
    assert regions_of(image, least=(1000.0, 0.0)).max() == 0
    assert regions_of(image[:1]).max() == 0
    assert wide_enough(np.array([[1, 1, 0, 2]]), (1.5, 0.5), (1.0, 1.0)) == [1]


def test_extraction(spark):
    from nocturne.operators.peaks import extract, mask_second_pass
    from pyspark.sql import functions as F

    image = hill((16, 90), (8, 12, 3, 10.0), (8, 40, 3, 8.0), (8, 70, 3, 6.0)) + 0.01
    rows = [("a", int(t), int(f), float(2 * image[f, t])) for f in range(16) for t in range(90)]
    px = spark.createDataFrame(rows, "rec string, t_idx long, f_idx long, power double")
    base = spark.createDataFrame([("a", f, 2.0) for f in range(16)], "rec string, f_idx long, pct double")
    out = extract(px, 0.5, 0.25, t0=100.0, baseline=base, longest=30, duration=(0.6, 100.0), bandwidth=(0.3, 10.0))
    peaks = out.peaks.orderBy("peak_id").collect()
    assert [r.peak_id for r in peaks] == list(range(1, len(peaks) + 1)) and {r.segment for r in peaks} == {1, 2, 3}
    tall = sorted((r for r in peaks if r.height > 2), key=lambda r: r.peak_time)
    assert [round(r.peak_time) for r in tall][0] == 106 and abs(tall[0].peak_freq - 2.0) < 0.2
    assert out.labels.select("peak_id").distinct().count() == len(peaks)
    labels = px.join(out.labels.select("rec", "t_idx", "f_idx", "segment", "label"), ["rec", "t_idx", "f_idx"], "left")
    labels = labels.select("rec", (F.col("t_idx") * 0.5).alias("t"), "t_idx", "f_idx", F.coalesce("segment", (F.floor(F.col("t_idx") / 30) + 1).cast("int")).alias("segment"), F.coalesce("label", F.lit(0)).alias("label"))
    second = px.select("rec", (F.col("t_idx") * 0.5 + 0.1).alias("t"), "f_idx", "power")
    kept = mask_second_pass(second, labels)
    assert kept.count() == 16 * 90
    inside = kept.where("power > 0").count()
    assert 0 < inside < out.labels.count()


def test_extraction_equals_the_entry_point_on_arrays(spark):
    from nocturne import arrays
    from nocturne.operators.peaks import extract

    rng = np.random.default_rng(5)
    image = hill((20, 100), (8, 15, 3, 10.0), (12, 50, 3, 8.0), (8, 85, 3, 6.0)) + 0.2 * rng.random((20, 100))
    rows, labels = arrays.extract_peaks(image, 7 + 0.5 * np.arange(100), 2 + 0.25 * np.arange(20), None, 17.0, (0.6, 50.0), (0.3, 10.0), threshold=4.0, stride=(1, 1))
    px = spark.createDataFrame([("a", t, f, float(image[f, t])) for f in range(20) for t in range(100)], "rec string, t_idx long, f_idx long, power double")
    out = extract(px, 0.5, 0.25, 7.0, 2.0, None, 34, (0.6, 50.0), (0.3, 10.0), threshold=4.0)
    got = out.peaks.orderBy("peak_id").collect()
    assert len(got) == len(rows) > 3
    for r, e in zip(got, rows, strict=True):
        for c in ("peak_time", "peak_freq", "duration", "bandwidth", "height", "volume", "area", "bbox_t", "bbox_f"):
            assert abs(r[c] - e[c]) < 1e-9, c
    assert {(r.f_idx, r.t_idx, r.peak_id) for r in out.labels.collect()} == {(int(f), int(t), int(labels[f, t])) for f, t in zip(*np.nonzero(labels), strict=True)}


def test_labels_of_an_extraction_are_found_once(spark):
    from nocturne.operators.peaks import extract

    px = spark.createDataFrame([("a", t, f, float(t % 7 + f % 3)) for f in range(8) for t in range(20)], "rec string, t_idx long, f_idx long, power double")
    plan = extract(px, 0.5, 0.25, longest=10).peaks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1


def test_small_images_are_labelled_like_large_ones(monkeypatch):
    from nocturne.kernels import regions

    rng = np.random.default_rng(8)
    masks = [rng.random((rng.integers(1, 12), rng.integers(1, 12))) < x for x in np.linspace(0, 1, 60)]
    walked = [(ws.components(m), regions._filled(m)) for m in masks]
    monkeypatch.setattr(ws, "SMALL", -1)
    monkeypatch.setattr(regions, "SMALL", -1)
    for m, (parts, filled) in zip(masks, walked, strict=True):
        assert (ws.components(m) == parts).all() and (regions._filled(m) == filled).all()
