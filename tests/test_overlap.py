"""Spatial joins and merging against plain versions, inside tasks and by the rounds of joins."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidegrid.operators import overlap


def frame(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"slide long, rot int, idx long, x1 {kind}, y1 {kind}, x2 {kind}, y2 {kind}")


def some(seed, n, slides=3, span=400, sides=(0, 60), giants=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = [rng.randrange(*sides) for _ in "xy"] if i >= giants else [rng.randrange(span // 2, span) for _ in "xy"]
        x, y = (rng.randrange(-50, span) for _ in "xy")
        rows.append((i % slides, rng.choice([0, 90]), i, x, y, x + w[0], y + w[1]))
    return rows


def meet(p, q):
    return min(p[2], q[2]) > max(p[0], q[0]) and min(p[3], q[3]) > max(p[1], q[1])


def plain_any(rows):
    """(slide, idx, box) of the only fixpoint."""
    out = []
    for s in {r[0] for r in rows}:
        left = [(r[2], r[3:]) for r in rows if r[0] == s]
        while True:
            pair = next(((a, b) for a, b in itertools.combinations(left, 2) if meet(a[1], b[1])), None)
            if not pair:
                break
            (i, p), (j, q) = pair
            left = [x for x in left if x not in pair] + [(min(i, j), (min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3])))]
        out += [(s, i, *b) for i, b in left]
    return sorted(out)


def plain_order(rows, threshold):
    """(slide, box) of the threshold rule, by scanning every later box."""
    out = []
    for s in {r[0] for r in rows}:
        now = [r[3:] for r in sorted(rows, key=lambda r: (r[1], r[2])) if r[0] == s]
        while True:
            hulls, rest = [], now
            while rest:
                hull, passed = rest[0], []
                for b in rest[1:]:
                    w, h = min(hull[2], b[2]) - max(hull[0], b[0]), min(hull[3], b[3]) - max(hull[1], b[1])
                    least = min((hull[2] - hull[0]) * (hull[3] - hull[1]), (b[2] - b[0]) * (b[3] - b[1]))
                    if w > 0 and h > 0 and least > 0 and w * h / least >= threshold:
                        hull = (min(hull[0], b[0]), min(hull[1], b[1]), max(hull[2], b[2]), max(hull[3], b[3]))
                    else:
                        passed.append(b)
                hulls.append(hull)
                rest = passed
            if len(hulls) == len(now):
                break
            now = hulls
        out += [(s, *b) for b in now]
    return sorted(out)


_PARTS = [some(1, 150), some(2, 90, 1, 2_000, (0, 200), 3), some(3, 120, 2, 150, (1, 12)), some(4, 60, 1, 90_000, (1, 40_000))]
#: All cases on one table, each with slides of its own.
ROWS = [(r[0] + 10 * k, *r[1:]) for k, part in enumerate(_PARTS) for r in part]


@pytest.mark.parametrize("rows", [ROWS, []])
def test_pairs(spark, rows):
    want = sorted((r[0], r[2], q[2]) for r in rows for q in rows if r[0] == q[0] and r[2] < q[2] and meet(r[3:], q[3:]))
    assert sorted((r.slide, r.a, r.b) for r in overlap.overlap_pairs(frame(spark, rows)).collect()) == want
    both = overlap.range_join(frame(spark, rows), frame(spark, rows), ["slide"]).select("slide", "idx", "r_idx").collect()
    assert sorted((r.slide, r.idx, r.r_idx) for r in both) == sorted((r[0], r[2], q[2]) for r in rows for q in rows if r[0] == q[0] and meet(r[3:], q[3:]))


@pytest.mark.parametrize(("rows", "local"), [(ROWS, overlap.LOCAL), (ROWS, 30), (ROWS, 2), ([], overlap.LOCAL)])
def test_any_overlap(spark, rows, local):
    got = sorted(tuple(r) for r in overlap.merge_boxes_any(frame(spark, rows), local=local).select("slide", "idx", *overlap.BOX).collect())
    assert got == plain_any(rows)


@pytest.mark.parametrize(("threshold", "local"), [(0.0, overlap.LOCAL), (0.2, overlap.LOCAL), (0.7, overlap.LOCAL), (0.2, 30)])
def test_threshold_in_order(spark, threshold, local):
    got = sorted(tuple(r) for r in overlap.merge_boxes(frame(spark, ROWS), threshold, local=local).collect())
    assert got == plain_order(ROWS, threshold)


def test_order_and_partitions_do_not_matter(spark):
    rows = list(_PARTS[0])
    random.Random(9).shuffle(rows)
    for n in (1, 7):
        df = frame(spark, rows).repartition(n)
        assert sorted(tuple(r) for r in overlap.merge_boxes_any(df).collect()) == plain_any(rows)


def test_rows_that_cannot_overlap_stay(spark):
    odd = [(1, 0, 1, 0, 0, 10, 10), (1, 0, 2, 5, 5, 5, 9), (1, 0, 3, 9, 0, 2, 4), (1, 0, 4, None, 0, 5, 5), (None, 0, 5, 0, 0, 9, 9), (None, 0, 6, 0, 0, 9, 9), (1, 0, None, 0, 0, 9, 9), (1, 0, 7, 2, 2, 3, 3)]
    got = overlap.merge_boxes_any(frame(spark, odd)).collect()
    assert sorted(repr((r.slide, r.idx, r.x1, r.x2)) for r in got) == sorted(map(repr, [(1, 1, 0, 10), (1, 2, 5, 5), (1, 3, 9, 2), (1, 4, None, 5), (None, 5, 0, 9), (None, 6, 0, 9), (1, None, 0, 9)]))
    assert overlap.merge_boxes(frame(spark, odd), 0.2).count() == 7


def test_doubles_and_names_of_columns(spark):
    df = frame(spark, [(1, 0, 1, 0.5, 0.5, 2.5, 2.5), (1, 0, 2, 2.25, 2.25, 3.0, 3.0)], "double").withColumnsRenamed({"slide": "s", "idx": "i"}).withColumn("extra", F.lit("x"))
    assert [tuple(r) for r in overlap.merge_boxes_any(df, "s", "i").collect()] == [(1, 1, 0.5, 0.5, 3.0, 3.0)]
    assert [tuple(r) for r in overlap.merge_boxes(df, 0.01, "s", ("rot", "i"), "i").collect()] == [(1, 0.5, 0.5, 3.0, 3.0)]


def test_merge_in_order_takes_long_chains(spark):
    chain = [(i, 0, i + 2, 2) for i in range(3000)]
    assert overlap.merge_in_order(chain, 0.1) == [(0, 0, 3001, 2)]


def test_crop_takes_boxes_of_any_size(spark):
    rng = random.Random(11)
    pixels = [(i % 2, rng.randrange(-100, 5000), rng.randrange(5000), i) for i in range(400)]
    boxes = [(i % 2, i, x, y, x + w, y + h) for i in range(60) for x, y, w, h in [(rng.randrange(-50, 4000), rng.randrange(4000), rng.choice([0, 1, 5, 90, 4096, 100_000]), rng.choice([2, 64, 700, 90_000]))]]
    df = spark.createDataFrame(pixels, "img long, x long, y long, v long").withColumn("extra", F.lit(1))
    got = overlap.crop_pixels(df, spark.createDataFrame(boxes, "img long, box long, x1 long, y1 long, x2 long, y2 long"))
    assert got.columns == ["img", "box", "x", "y", "v", "extra"]
    want = [(k, b, x - x1, y - y1, v) for k, x, y, v in pixels for g, b, x1, y1, x2, y2 in boxes if g == k and x1 <= x < x2 and y1 <= y < y2]
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(want)
    none = spark.createDataFrame([], "img long, box long, x1 long, y1 long, x2 long, y2 long")
    assert overlap.crop_pixels(df, none).collect() == []


@pytest.mark.parametrize("kind", [np.int64, np.float64])
def test_groups_side_by_side_give_what_each_gives_alone(kind):
    rng = np.random.default_rng(5)
    sizes = [1, 2, 3, 40, 90, 128, 128, 129]
    inside = np.arange(max(sizes)) < np.array(sizes)[:, None]
    x1, y1 = (rng.integers(0, 300, inside.shape).astype(kind) for _ in range(2))
    x2, y2 = x1 + rng.integers(5, 40, inside.shape), y1 + rng.integers(5, 40, inside.shape)
    ident = rng.permutation(inside.size).reshape(inside.shape)
    who, *got = overlap.hulls_side_by_side(x1, y1, x2, y2, ident, inside)
    for i, n in enumerate(sizes):
        want = overlap._hulls_of(*(v[i, :n] for v in (x1, y1, x2, y2, ident)))
        assert sorted(zip(*(v[who == i].tolist() for v in got), strict=True)) == sorted(zip(*(v.tolist() for v in want), strict=True))
    for threshold in (0.0, 0.2, 0.5, 1.1):
        who, *got = overlap.merge_side_by_side(x1, y1, x2, y2, inside, threshold)
        for i, n in enumerate(sizes):
            want = overlap.merge_in_order(list(zip(*(v[i, :n].tolist() for v in (x1, y1, x2, y2)), strict=True)), threshold)
            assert list(zip(*(v[who == i].tolist() for v in got), strict=True)) == want


def test_numbers_that_stay_exact_side_by_side():
    assert overlap._side_by_side([np.array([1, 2])] * 5)
    assert not overlap._side_by_side([np.array([1, 1 << 40])] * 5)
    assert not overlap._side_by_side([np.array([1.0, np.inf])] * 4)
    assert not overlap._side_by_side([*[np.array([1, 2])] * 4, np.array(["a", "b"], dtype=object)])
