"""Grids of cells in square tiles, each worked on as one array in a task.

A tile holds at most ``SIDE * SIDE`` cells, whatever a grid's size. What spans
tiles is settled on a far smaller graph of pieces that touch across a border,
in blocks of tiles that grow by ``GROUP`` a level, so the number of rounds
follows the logarithm of a grid's extent and no join is keyed by a component.
Cells without r or c are left out. A grid's rows and columns are numbers, or
names of two of the key columns where grids differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixpoint import cut

#: Cells of a tile's side, and blocks of a level along the side of one of the next.
SIDE, GROUP = 64, 16
#: Tiles that are worked on at once.
AT_ONCE = 64
_FOUR, _EIGHT = ((0, 1), (1, 0)), ((0, 1), (1, 0), (1, 1), (1, -1))
_HIGH = 1 << 32


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of 0..n-1 that each of them reaches by the edges between ``a`` and ``b``."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = low < high
        if not apart.any():
            return label
        np.minimum.at(label, high[apart], low[apart])
        a, b = a[apart], b[apart]
        while True:
            on = label[label]
            if (on == label).all():
                break
            label = on


def named(r: Column, c: Column) -> Column:
    """A cell's place as one number."""
    return (r.cast("long") * F.lit(_HIGH) + c.cast("long")).cast("long")


def _tile(c: str, side: int = SIDE) -> Column:
    return F.floor(F.col(c) / side)


def tiles(cells: DataFrame, keys: list[str], halo: int = 0, every: DataFrame | None = None) -> DataFrame:
    """(keys, tr, tc, cells): the cells of each tile, and of ``halo`` rows and columns round it, each once.

    ``every`` names tiles (keys, tr, tc) that are there even without a cell.
    """
    at = cells.select(*keys, F.struct(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).alias("cell")).filter("cell.r IS NOT NULL AND cell.c IS NOT NULL")
    span = lambda c: F.sequence(F.floor((F.col(f"cell.{c}") - halo) / SIDE), F.floor((F.col(f"cell.{c}") + halo) / SIDE))
    at = at.withColumn("tr", F.explode(span("r"))).withColumn("tc", F.explode(span("c")))
    if every is not None:
        at = at.unionByName(every.withColumn("cell", F.lit(None).cast("struct<r:bigint,c:bigint>")))
    return at.groupBy(*keys, "tr", "tc").agg(F.collect_set("cell").alias("cells"))


def size_of(n: int | str) -> Column:
    return F.col(n) if isinstance(n, str) else F.lit(n)


def every_tile(groups: DataFrame, rows: int | str, cols: int | str) -> DataFrame:
    """All tiles of a grid for each row of ``groups``."""
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.floor((size_of(n) - 1) / SIDE)))
    return groups.filter((size_of(rows) > 0) & (size_of(cols) > 0)).withColumn("tr", upto(rows)).withColumn("tc", upto(cols))


def _mapped(rows: DataFrame, keys: list[str], out: str, work: Callable[..., tuple[np.ndarray, dict[str, np.ndarray]]], *sizes: int | str) -> DataFrame:
    """(keys, out): ``work`` applied to tile corners, to each cell's tile and place, and to ``sizes`` a tile; gives the tile of each new row, and its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(begin, AT_ONCE)
                lists = b.column(b.num_columns - 1)
                cells, size = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
                tr, tc = (b.column(len(keys) + i).to_numpy(zero_copy_only=False) * SIDE for i in (0, 1))
                r, c = (cells.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                given = [b.column(keys.index(n)).to_numpy(zero_copy_only=False) if isinstance(n, str) else np.full(len(tr), n) for n in sizes]
                tile, made = work(tr, tc, np.repeat(np.arange(len(size)), size), r, c, *given)
                if len(tile):
                    at = pa.array(tile)
                    yield pa.record_batch([*[b.column(i).take(at) for i in range(len(keys))], *map(pa.array, made.values())], [*keys, *made])

    schema = T.StructType([rows.schema[k] for k in keys] + T.StructType.fromDDL(out).fields)
    return rows.select(*keys, "tr", "tc", "cells").mapInArrow(run, schema)


def _pieces(tile: np.ndarray, r: np.ndarray, c: np.ndarray, tr: np.ndarray, tc: np.ndarray, steps: tuple) -> np.ndarray:
    """For cells sorted by tile, row and column: the first cell of each one's connected piece within its tile."""
    wide = SIDE + 2
    place = (tile * wide + (r - tr[tile] + 1)) * wide + (c - tc[tile] + 1)
    ends = []
    for dr, dc in steps:
        want = place + dr * wide + dc
        at = np.minimum(np.searchsorted(place, want), max(len(place) - 1, 0))
        hit = np.flatnonzero(place[at] == want) if len(place) else at
        ends.append((hit, at[hit]))
    return least_labels(len(place), *(np.concatenate(x) for x in zip(*ends, strict=True)))


def pieces(cells: DataFrame, keys: list[str], connectivity: int = 4) -> DataFrame:
    """(keys, r, c, piece, n_piece): each cell with the least cell of its piece within a tile, and the piece's size."""
    steps = _FOUR if connectivity == 4 else _EIGHT

    def work(tr, tc, tile, r, c):
        order = np.lexsort((c, r, tile))
        tile, r, c = tile[order], r[order], c[order]
        first = _pieces(tile, r, c, tr, tc, steps)
        return tile, {"r": r, "c": c, "piece": r[first] * _HIGH + c[first], "n_piece": np.bincount(first, minlength=len(first))[first]}

    return _mapped(tiles(cells, keys), keys, "r long, c long, piece long, n_piece long", work)


def gaps(cells: DataFrame, keys: list[str], rows: int | str, cols: int | str, least: int, connectivity: int = 4) -> DataFrame:
    """(keys, r, c, piece, n_piece, open): pieces of cells that are not set, on a grid of each key that has one.

    A piece is ``open`` if it touches the grid's edge or has ``least`` cells or
    more (0: no such bound). Of open pieces only cells at a tile's border are
    given, those that other tiles' pieces may touch.
    """
    steps = _FOUR if connectivity == 4 else _EIGHT

    def work(tr, tc, tile, r, c, rows, cols):
        free = (tr[:, None] + np.arange(SIDE) < rows[:, None])[:, :, None] & (tc[:, None] + np.arange(SIDE) < cols[:, None])[:, None, :]
        inside = (r >= 0) & (r < rows[tile]) & (c >= 0) & (c < cols[tile])
        free[tile[inside], (r - tr[tile])[inside], (c - tc[tile])[inside]] = False
        tile, r, c = np.nonzero(free)
        at_border = (r == 0) | (r == SIDE - 1) | (c == 0) | (c == SIDE - 1)
        r, c = r + tr[tile], c + tc[tile]
        first = _pieces(tile, r, c, tr, tc, steps)
        n = np.bincount(first, minlength=len(first))[first] if len(first) else first
        is_open = np.zeros(len(first), dtype=bool)
        np.logical_or.at(is_open, first, (r == 0) | (r == rows[tile] - 1) | (c == 0) | (c == cols[tile] - 1))
        is_open = is_open[first] | ((n >= least) if least > 0 else False)
        some = ~is_open | at_border
        return tile[some], {"r": r[some], "c": c[some], "piece": (r[first] * _HIGH + c[first])[some], "n_piece": n[some], "open": is_open[some]}

    of = tiles(cells, keys, every=every_tile(cells.select(*keys).distinct(), rows, cols))
    return _mapped(of, keys, "r long, c long, piece long, n_piece long, open boolean", work, rows, cols)


def closed(cells: DataFrame, keys: list[str], rows: int | str, cols: int | str, p: int) -> DataFrame:
    """(keys, r, c): binary closing with a window of ``p`` cells to each side; outside the grid, and near its edge, counts as set."""
    halo = 2 * p
    wide = SIDE + 2 * halo

    def spread(x: np.ndarray, axis: int, join: np.ufunc) -> np.ndarray:
        """Each place joined with those up to ``p`` before and after it; the outer ``p`` fall away."""
        n = x.shape[axis] - 2 * p
        out = x.take(range(n), axis=axis)
        for k in range(1, 2 * p + 1):
            join(out, x.take(range(k, k + n), axis=axis), out=out)
        return out

    def work(tr, tc, tile, r, c, rows, cols):
        on = np.zeros((len(tr), wide, wide), dtype=bool)
        inside = (r >= 0) & (r < rows[tile]) & (c >= 0) & (c < cols[tile])
        on[tile[inside], (r - tr[tile] + halo)[inside], (c - tc[tile] + halo)[inside]] = True
        on = spread(spread(on, 1, np.logical_or), 2, np.logical_or)
        y, x = tr[:, None] + np.arange(-p, SIDE + p), tc[:, None] + np.arange(-p, SIDE + p)
        on |= ((y < p) | (y >= rows[:, None] - p))[:, :, None] | ((x < p) | (x >= cols[:, None] - p))[:, None, :]
        on = spread(spread(on, 1, np.logical_and), 2, np.logical_and)
        tile, r, c = np.nonzero(on)
        r, c = r + tr[tile], c + tc[tile]
        some = (r < rows[tile]) & (c < cols[tile]) & (r >= 0) & (c >= 0)
        return tile[some], {"r": r[some], "c": c[some]}

    # a grid of at most 2p rows or columns is all near its edge
    thin = (size_of(rows) <= 2 * p) | (size_of(cols) <= 2 * p)
    every = every_tile(cells.select(*keys).distinct().filter(thin), rows, cols)
    return _mapped(tiles(cells, keys, halo, every), keys, "r long, c long", work, rows, cols)


def _touching(cells: DataFrame, keys: list[str], connectivity: int) -> DataFrame:
    """(keys, a, b): pieces of different tiles that touch, from cells with their piece."""
    last = lambda c: F.pmod(F.col(c), F.lit(SIDE)).isin(0, SIDE - 1)
    edge = cells.filter(last("r") | last("c")).select(*keys, "r", "c", "piece")
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (_FOUR if connectivity == 4 else _EIGHT)]))
    on = edge.withColumn("_o", step).withColumns({"_r": F.col("r") + F.col("_o.a"), "_c": F.col("c") + F.col("_o.b")})
    on = on.filter((_tile("_r") != _tile("r")) | (_tile("_c") != _tile("c"))).select(*keys, F.col("_r").alias("r"), F.col("_c").alias("c"), F.col("piece").alias("a"))
    return on.join(edge.withColumnRenamed("piece", "b"), [*keys, "r", "c"]).select(*keys, "a", "b").distinct()


def _joined(edges: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """(keys, node, root): least node that each reaches by the edges of its group."""
    lists = edges.groupBy(*keys, *by).agg(F.collect_set(F.struct("a", "b")).alias("edges")).select(*keys, "edges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs, size = b.column(len(keys)).flatten(), b.column(len(keys)).value_lengths().to_numpy(zero_copy_only=False)
            x, y = (pairs.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, (z, n) in enumerate(zip(np.cumsum(size), size, strict=True)):
                node, at = np.unique(np.concatenate((x[z - n : z], y[z - n : z])), return_inverse=True)
                root = node[least_labels(len(node), at[:n], at[n:])]
                whose = pa.array(np.full(len(node), i))
                yield pa.record_batch([*[b.column(k).take(whose) for k in range(len(keys))], pa.array(node), pa.array(root)], [*keys, "node", "root"])

    schema = T.StructType([edges.schema[k] for k in keys] + T.StructType.fromDDL("node long, root long").fields)
    return lists.mapInArrow(run, schema)


def extent(cells: DataFrame) -> int:
    """Rows or columns, whichever are more, counted from 0."""
    most = cells.agg(F.max(F.greatest("r", "c"))).first()[0]
    return 0 if most is None else int(most) + 1


def roots(cells: DataFrame, keys: list[str], connectivity: int, size: int) -> DataFrame:
    """(keys, piece, root): what pieces at a tile's border belong to, on grids of at most ``size`` rows and columns.

    ``cells`` have their piece. On each level pieces within one block are
    joined, and edges between blocks go on with what their ends have become.
    """
    edges = cut(_touching(cells, keys, connectivity))
    out = edges.select(*keys, F.explode(F.array("a", "b")).alias("piece")).distinct().withColumn("root", F.col("piece"))
    side = SIDE
    while side < size:
        side *= GROUP
        block = lambda e: (F.floor(F.col(e) / _HIGH / side), F.floor(F.pmod(F.col(e), F.lit(_HIGH)) / side))  # noqa: B023, E731
        at = edges.withColumns(dict(zip(("_r", "_c"), block("a"), strict=True)))
        (r, c), within = block("b"), ["_r", "_c"]
        same = (F.col("_r") == r) & (F.col("_c") == c)
        step = cut(_joined(at.filter(same), keys, within))
        new = lambda e: step.select(*keys, F.col("node").alias(e), F.col("root").alias(f"_{e}"))  # noqa: B023, E731
        out = out.join(new("root"), [*keys, "root"], "left").select(*keys, "piece", F.coalesce("_root", "root").alias("root"))
        edges = at.filter(~same).drop(*within)
        if side < size:
            for e in ("a", "b"):
                edges = edges.join(new(e), [*keys, e], "left").withColumn(e, F.coalesce(f"_{e}", e)).drop(f"_{e}")
            edges = cut(edges.distinct())
    return out
