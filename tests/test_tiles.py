"""Cell masks larger than a tile against flood fill and plain windows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidegrid.operators import mask
from slidegrid.plans import tiles

FOUR, EIGHT = [(0, 1), (1, 0), (0, -1), (-1, 0)], [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def flood(cells, connectivity):
    """{cell: least cell of its component}."""
    root = {}
    for cell in sorted(cells):
        if cell in root:
            continue
        todo = [cell]
        root[cell] = cell
        while todo:
            r, c = todo.pop()
            for a, b in FOUR if connectivity == 4 else EIGHT:
                near = (r + a, c + b)
                if near in cells and near not in root:
                    root[near] = cell
                    todo.append(near)
    return root


def plain_close(cells, rows, cols, k):
    p = (k if k % 2 else k + 1) // 2
    grid = np.zeros((rows, cols), bool)
    for r, c in cells:
        grid[r, c] = True
    near = lambda r, c: not (p <= r < rows - p and p <= c < cols - p)
    window = lambda r, c: [(y, x) for y in range(max(0, r - p), min(rows, r + p + 1)) for x in range(max(0, c - p), min(cols, c + p + 1))]
    on = {(r, c) for r in range(rows) for c in range(cols) if near(r, c) or any(grid[q] for q in window(r, c))}
    return {(r, c) for r in range(rows) for c in range(cols) if all(q in on for q in window(r, c))}


def plain_fill(cells, rows, cols, n, connectivity):
    root = flood({(r, c) for r in range(rows) for c in range(cols)} - cells, connectivity)
    groups = {}
    for cell, x in root.items():
        groups.setdefault(x, set()).add(cell)
    out = set(cells)
    for g in groups.values():
        if not any(r in (0, rows - 1) or c in (0, cols - 1) for r, c in g) and (n <= 0 or len(g) <= n):
            out |= g
    return out


def frame(spark, groups):
    rows = [(s, r, c) for s, cells in groups.items() for r, c in cells]
    return spark.createDataFrame(rows + rows[:20], "slide long, r int, c int")


def noise(seed, rows, cols, share):
    rng = random.Random(seed)
    return {(r, c) for r in range(rows) for c in range(cols) if rng.random() < share}


def rings(rows, cols, step):
    """Closed loops, one in the other, with holes of many sizes; they cross many tiles."""
    return {(r, c) for r in range(rows) for c in range(cols) if min(r, c, rows - 1 - r, cols - 1 - c) % step == step - 1}


def snake(rows, cols, step):
    """One component that winds through the grid."""
    return {(r, c) for r in range(rows) for c in range(cols) if r % step == 0 or (c == (cols - 1 if r // step % 2 == 0 else 0))}


ROWS, COLS = 100, 150
GROUPS = {1: noise(1, ROWS, COLS, 0.45), 2: noise(2, ROWS, COLS, 0.62), 3: rings(ROWS, COLS, 4), 4: snake(ROWS, COLS, 3), 5: {(63, 63), (64, 64), (64, 63), (0, 0)}, 6: rings(ROWS, COLS, 30)}


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_and_small_ones(spark, connectivity):
    df = frame(spark, GROUPS)
    want = {s: flood(cells, connectivity) for s, cells in GROUPS.items()}
    got = mask.components(df, ["slide"], connectivity).collect()
    assert sorted((r.slide, r.r, r.c, r.root) for r in got) == sorted((s, *cell, x[0] * (1 << 32) + x[1]) for s, w in want.items() for cell, x in w.items())
    size = {(s, x): sum(y == x for y in w.values()) for s, w in want.items() for x in set(w.values())}
    kept = mask.remove_small(df, ["slide"], 5, connectivity).collect()
    assert sorted(map(tuple, kept)) == sorted((s, *cell) for s, w in want.items() for cell, x in w.items() if size[s, x] >= 5)
    gone = {r.slide: (r.removed_components, r.removed_cells) for r in mask.removed_small(df, ["slide"], 5, connectivity).collect()}
    for s in GROUPS:
        small = [n for (t, _), n in size.items() if t == s and n < 5]
        assert gone.get(s, (0, 0)) == (len(small), sum(small))


@pytest.mark.parametrize("k", [3, 4])
def test_closing(spark, k):
    got = {}
    for r in mask.close_mask(frame(spark, GROUPS), ["slide"], ROWS, COLS, k).collect():
        got.setdefault(r.slide, []).append((r.r, r.c))
    for s, cells in GROUPS.items():
        assert sorted(got[s]) == sorted(plain_close(cells, ROWS, COLS, k))


@pytest.mark.parametrize(("n", "connectivity"), [(10, 4), (0, 8), (200, 4), (5_000, 4)])
def test_holes(spark, n, connectivity):
    got = {}
    df = frame(spark, GROUPS)
    for r in mask.fill_holes(df.distinct(), ["slide"], ROWS, COLS, n, connectivity).collect():
        got.setdefault(r.slide, []).append((r.r, r.c))
    for s, cells in GROUPS.items():
        assert sorted(got[s]) == sorted(plain_fill(cells, ROWS, COLS, n, connectivity)), s


def test_several_levels_of_blocks(spark):
    """A loop round a grid of more than GROUP tiles to the side, and a few cells apart from it."""
    n = tiles.SIDE * tiles.GROUP + 80
    loop = {(r, c) for r in range(n) for c in (3, n - 4)} | {(r, c) for r in (3, n - 4) for c in range(n)}
    cells = {s: loop - gap | {(500, 500)} for s, gap in {1: set(), 2: {(3, 700), (n - 4, 80)}}.items()}
    got = mask.component_summary(mask.components(frame(spark, cells), ["slide"]), ["slide"]).collect()
    assert {r.slide: (r.n_components, r.n_cells) for r in got} == {s: (len(set(flood(x, 4).values())), len(x)) for s, x in cells.items()}


def test_small_grids_and_odd_rows(spark):
    for rows, cols in ((1, 1), (2, 5), (3, 3), (4, 70)):
        cells = {1: {(0, 0)}, 2: noise(rows, rows, cols, 0.5) | {(0, 0)}}
        got = {(r.slide, r.r, r.c) for r in mask.close_mask(frame(spark, cells), ["slide"], rows, cols, 3).collect()}
        assert got == {(s, *x) for s, own in cells.items() for x in plain_close(own, rows, cols, 3)}
        got = {(r.slide, r.r, r.c) for r in mask.fill_holes(frame(spark, cells), ["slide"], rows, cols, 0).collect()}
        assert got == {(s, *x) for s, own in cells.items() for x in plain_fill(own, rows, cols, 0, 4)}
    odd = spark.createDataFrame([(1, None, 3), (1, 2, None), (1, 2, 2), (1, 2, 2)], "slide long, r int, c int").withColumn("piece", F.lit("x"))
    assert [tuple(r)[:3] for r in mask.components(odd, ["slide"]).collect()] == [(1, 2, 2)]
    none = odd.limit(0)
    for made in (mask.components(none, ["slide"]), mask.remove_small(none, ["slide"]), mask.close_mask(none, ["slide"], 5, 5), mask.fill_holes(none, ["slide"], 5, 5)):
        assert made.collect() == []
