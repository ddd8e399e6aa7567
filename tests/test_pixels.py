"""Blur on images of several tiles, clusters and thresholds against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidegrid.operators import overlap, pixels

H, W = 70, 133


def image(seed, h=H, w=W):
    return np.random.default_rng(seed).random((h, w))


def frame(spark, images):
    rows = [(k, x, y, float(v[y, x])) for k, v in images.items() for y in range(v.shape[0]) for x in range(v.shape[1])]
    return spark.createDataFrame(rows, "img long, x int, y int, gray double")


def back(df, key):
    return {(r.y, r.x): r.gray for r in df.collect() if r.img == key}


def plain_blur(v, sigma):
    k = pixels.gaussian_kernel(sigma)
    r = len(k) // 2
    down = np.array([sum(k[i] * v[min(max(y + i - r, 0), v.shape[0] - 1)] for i in range(len(k))) for y in range(v.shape[0])])
    return np.array([sum(k[i] * down[:, min(max(x + i - r, 0), v.shape[1] - 1)] for i in range(len(k))) for x in range(v.shape[1])]).T


def plain_laplace(v):
    m = np.pad(v, 1, mode="symmetric")
    return 4 * v - m[:-2, 1:-1] - m[2:, 1:-1] - m[1:-1, :-2] - m[1:-1, 2:]


@pytest.mark.parametrize("sigma", [1.0, 6.0])
def test_blur_over_tiles(spark, sigma):
    images = {1: image(1), 2: image(2)}
    got = pixels.gaussian_blur(frame(spark, images).repartition(5), "img", sigma, W, H)
    for k, v in images.items():
        want, have = plain_blur(v, sigma), back(got, k)
        assert len(have) == v.size and all(abs(have[y, x] - want[y, x]) < 1e-9 for y in range(H) for x in range(W))


def test_edges_and_scores_over_tiles(spark):
    images = {1: image(3), 2: image(4) * 0.1}
    df = frame(spark, images)
    edge = back(pixels.laplace(df, "img", W, H), 1)
    want = plain_laplace(images[1])
    assert all(abs(edge[y, x] - want[y, x]) < 1e-9 for y in range(H) for x in range(W))
    for r in pixels.blur_scores(df, "img", W, H, 1.5, 0.3, 0.5).collect():
        soft = plain_blur(np.abs(plain_laplace(images[r.img])), 1.5)
        assert abs(r.sharp - soft.mean()) < 1e-9 and abs(r.blur - (soft <= 0.3).mean()) < 1e-9 and r.passed == (r.blur <= 0.5)


def test_images_with_missing_pixels_and_none(spark):
    df = frame(spark, {1: image(5, 3, 3)}).filter("NOT (x = 1 AND y = 1)")
    assert pixels.gaussian_blur(df, "img", 1.0, 3, 3).count() == 8
    assert pixels.blur_scores(df.limit(0), "img", 3, 3).collect() == []
    assert pixels.otsu(df.limit(0), "img").collect() == []


def plain_density(points, eps, min_pts, min_size):
    near = {i: [j for j, q in points.items() if (p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]) <= eps * eps] for i, p in points.items()}
    core = {i for i, n in near.items() if len(n) >= min_pts}
    root = {}
    for i in sorted(core):
        todo = [i] if i not in root else []
        while todo:
            j = todo.pop()
            if j not in root:
                root[j] = i
                todo += [m for m in near[j] if m in core]
    named = {i: root[i] if i in core else root[min(j for j in near[i] if j in core)] for i in points if core.intersection(near[i])}
    size = {c: sum(x == c for x in named.values()) for c in named.values()}
    return {i: named[i] if i in named and size[named[i]] >= min_size else -1 for i in points}


def test_density_clusters(spark):
    rng = random.Random(2)
    groups = {}
    for g in range(3):
        spots = [(rng.uniform(0, 4), rng.uniform(-4, 0), rng.choice([0.02, 0.1, 0.4])) for _ in range(6)]
        pts = [(rng.gauss(x, s), rng.gauss(y, s)) for x, y, s in spots for _ in range(40)] + [(rng.uniform(-1, 5), rng.uniform(-5, 1)) for _ in range(40)]
        groups[g] = {i * 3 + g: p for i, p in enumerate(pts + pts[:9])}
    # two dense lines at about eps, which only their nearest points can tell
    groups[3] = {1000 + i: (i * 0.01, 0.0) for i in range(60)} | {1100 + i: (i * 0.01 + 0.003, 0.2) for i in range(60)}
    groups[4] = {1200 + i: (i * 0.01, 0.0) for i in range(60)} | {1300 + i: (i * 0.01, 0.2) for i in range(60)}
    df = spark.createDataFrame([(g, i, *p) for g, own in groups.items() for i, p in own.items()], "g long, i long, x double, y double")
    for eps, min_pts, min_size in ((0.2, 4, 5), (0.05, 1, 1), (0.3, 12, 20)):
        got = {(r.g, r.i): r.cluster for r in pixels.density_clusters(df, ["g"], "i", eps, min_pts, min_size).collect()}
        assert got == {(g, i): c for g, own in groups.items() for i, c in plain_density(own, eps, min_pts, min_size).items()}


def test_largest_cluster_of_noise(spark):
    df = spark.createDataFrame([("a", -1), ("a", -1), ("b", -1), ("b", 3), ("b", 1), ("c", None)], "g string, label int")
    assert sorted((r.g, r.label, r.n) for r in pixels.largest_cluster(df.filter("g < 'c'"), ["g"]).collect() if r.label) == [("b", 1, 1)]
    assert {r.g: r.n for r in pixels.largest_cluster(df, ["g"]).collect()} == {"a": 0, "b": 1, "c": 0}
    with pytest.raises(Exception, match="noise only"):
        pixels.largest_cluster(df, ["g"], strict=True).collect()
    assert [tuple(r) for r in pixels.largest_cluster(df.drop("g"), []).collect()] == [(1, 1)]
    assert pixels.largest_cluster(df.limit(0), ["g"]).collect() == [] == pixels.largest_cluster(df.limit(0).drop("g"), []).collect()


def test_every_k_in_one_pass_is_each_k_alone(spark):
    rng = random.Random(5)
    pts = [(g, rng.gauss(3 * (i % 3), 0.3), rng.gauss(2 * (i % 3), 0.3)) for g in (1, 2) for i in range(60)] + [(3, 1.0, 1.0)] * 4
    df = spark.createDataFrame(pts, "g long, x double, y double")
    both = pixels.lloyd(df, ["g"], ["x", "y"], [2, 3], 4)
    for k in (2, 3):
        one = pixels.kmeans_groups(df, ["g"], ["x", "y"], k, 4)
        assert sorted(map(tuple, both.filter(F.col("k") == k).drop("k").collect())) == sorted(map(tuple, one.collect()))
    assert {r.g: r.k for r in pixels.auto_k(df, ["g"], ["x", "y"], range(2, 5), 4).collect()} == {1: 3, 2: 3, 3: 2}


def test_prefix_columns_and_ratios(spark):
    rng = random.Random(6)
    rows, cols = 90, 37
    masks = {1: {(rng.randrange(rows), rng.randrange(cols)) for _ in range(700)}, 2: {(rows - 1, cols - 1)}, 3: {(0, 0), (-1, 5), (rows, 2), (4, cols)}}
    cells = spark.createDataFrame([(s, r, c) for s, own in masks.items() for r, c in own], "slide long, r int, c int")
    table = {(r.slide, r.c): r.sums for r in overlap.prefix_columns(cells, ["slide"], rows, cols).collect()}
    for s, own in masks.items():
        for c in (1, 5, 20, cols):
            for r in (0, 1, 44, rows):
                assert (table[s, c][r] if (s, c) in table else 0) == sum(0 <= y < r and 0 <= x < c for y, x in own)
    boxes = []
    for i in range(300):
        x, y = rng.randint(-20, 500), rng.randint(-20, 1000)
        boxes.append((rng.choice([1, 2, 3, 4]), i, x, y, x + rng.randint(-3, 200), y + rng.randint(-3, 400)))
    got = overlap.foreground_ratio(spark.createDataFrame(boxes, "slide long, p long, px1 int, py1 int, px2 int, py2 int"), cells, 0.1, ["slide"], rows, cols)
    assert got.count() == len(boxes)
    for r in got.collect():
        r1, r2, c1, c2 = (max(0, min(n, f(v * 0.1))) for v, n, f in ((r.py1, rows, int), (r.py2, rows, math.ceil), (r.px1, cols, int), (r.px2, cols, math.ceil)))
        inside = sum(r1 <= y < r2 and c1 <= x < c2 for y, x in masks.get(r.slide, ()))
        assert r.fg_ratio == pytest.approx(inside / ((r2 - r1) * (c2 - c1)) if r2 > r1 and c2 > c1 else 0.0)
