"""Sparse cell masks: neighbours, components, cleaning, assembly.

A mask is a table of set cells (keys, r, c). The extent (rows, cols) of a
region, where a rule needs it, is given with the call or as columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import tiles as T
from ..plans.fixpoint import cut

FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]
EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def square(k: int) -> list[tuple[int, int]]:
    """Offsets of a k x k footprint; even k count as k + 1."""
    p = (k if k % 2 else k + 1) // 2
    return [(a, b) for a in range(-p, p + 1) for b in range(-p, p + 1)]


def _shifted(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each cell once for every offset, as nr, nc."""
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets]))
    return cells.withColumn("_o", o).withColumns({"nr": F.col("r") + F.col("_o.a"), "nc": F.col("c") + F.col("_o.b")}).drop("_o")


def neighbors(cells: DataFrame, keys: list[str], offsets: list[tuple[int, int]]) -> DataFrame:
    """(cells, nr, nc): set neighbours of each set cell, by equi-join."""
    other = cells.select(*keys, F.col("r").alias("nr"), F.col("c").alias("nc"))
    return _shifted(cells, offsets).join(other, [*keys, "nr", "nc"])


def _placed(df: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, r, c) with the types of ``cells``."""
    return df.select(*keys, *[F.col(c).cast(cells.schema[c].dataType).alias(c) for c in ("r", "c")])


def _labelled(cells: DataFrame, keys: list[str], connectivity: int, size: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Cells with their pieces within tiles, and the roots of pieces that touch other tiles; none where a grid fits a tile."""
    size = T.extent(cells) if size is None else size
    if size <= T.SIDE:
        return T.pieces(cells, keys, connectivity), None
    named = cut(T.pieces(cells, keys, connectivity))
    return named, cut(T.roots(named, keys, connectivity, size))


def _rooted(named: DataFrame, roots: DataFrame | None, keys: list[str]) -> DataFrame:
    if roots is None:
        return named.withColumn("root", F.col("piece"))
    return named.join(roots, [*keys, "piece"], "left").withColumn("root", F.coalesce("root", "piece"))


def _totals(named: DataFrame, roots: DataFrame | None, keys: list[str], *more: Column) -> DataFrame:
    """(keys, root, n) of each component, from one row a piece."""
    one = named.filter(F.col("piece") == T.named(F.col("r"), F.col("c")))
    return _rooted(one, roots, keys).groupBy(*keys, "root").agg(F.sum("n_piece").alias("n"), *more)


def components(cells: DataFrame, keys: list[str], connectivity: int = 4, size: int | None = None) -> DataFrame:
    """(keys, r, c, root): the component of each cell, named by its least cell.

    Cells are joined into pieces inside tiles; only pieces at a tile's border
    meet each other. ``size`` bounds the rows and columns of all grids; without
    it the cells are read once more for it.
    """
    at = _rooted(*_labelled(cells, keys, connectivity, size), keys)
    return at.select(*keys, *[F.col(c).cast(cells.schema[c].dataType).alias(c) for c in ("r", "c")], "root")


def component_summary(named: DataFrame, keys: list[str]) -> DataFrame:
    return named.groupBy(*keys).agg(F.count_distinct("root").alias("n_components"), F.count("*").alias("n_cells"))


def remove_small(cells: DataFrame, keys: list[str], n: int = 3, connectivity: int = 4, size: int | None = None) -> DataFrame:
    """Cells of components of at least n cells.

    Cells of a piece that is large enough by itself stay without a look at the
    rest of their component.
    """
    if n <= 1:
        return cells.select(*keys, "r", "c")
    named, roots = _labelled(cells, keys, connectivity, size)
    kept = named.filter(F.col("n_piece") >= n)
    if roots is not None:
        large = _totals(named, roots, keys).filter(F.col("n") >= n)
        small = _rooted(named.filter(F.col("n_piece") < n), roots, keys).join(large, [*keys, "root"], "left_semi")
        kept = kept.unionByName(small.select(*kept.columns))
    return _placed(kept, cells, keys)


def removed_small(cells: DataFrame, keys: list[str], n: int = 3, connectivity: int = 4, size: int | None = None) -> DataFrame:
    """Components below n cells of each group, and their cells."""
    small = _totals(*_labelled(cells, keys, connectivity, size), keys).filter(F.col("n") < n)
    return small.groupBy(*keys).agg(F.count("*").alias("removed_components"), F.sum("n").alias("removed_cells"))


def _grid(groups: DataFrame, rows: Column | int, cols: Column | int) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    out = groups.withColumn("r", F.explode(F.sequence(F.lit(0), (lit(rows) - 1).cast("int"))))
    return out.withColumn("c", F.explode(F.sequence(F.lit(0), (lit(cols) - 1).cast("int")))).withColumns({"r": F.col("r").cast("long"), "c": F.col("c").cast("long")})


def close_mask(cells: DataFrame, keys: list[str], rows: int | str, cols: int | str, k: int = 3) -> DataFrame:
    """Binary closing with a k x k footprint; outside the grid counts as set.

    A cell is set if every place of its window is outside, near the edge, or has
    a set cell in its own window. Each tile sees the cells of a rim of k - 1
    round it, so that only cells near a border are sent twice.
    """
    p = (k if k % 2 else k + 1) // 2
    return _placed(T.closed(cells, keys, rows, cols, p), cells, keys)


def _longest(cells: DataFrame, rows: int | str, cols: int | str) -> int:
    """Rows or columns of the largest grid."""
    if isinstance(rows, int) and isinstance(cols, int):
        return max(rows, cols)
    return cells.agg(F.max(F.greatest(T.size_of(rows), T.size_of(cols)))).first()[0] or 0


def fill_holes(cells: DataFrame, keys: list[str], rows: int | str, cols: int | str, n: int = 10, connectivity: int = 4) -> DataFrame:
    """Cells and enclosed background components of up to n cells; n of 0 or less fills all.

    Background is laid out inside tasks only; what cannot be a hole leaves them
    as the cells at a tile's border.
    """
    own = cells.select(*keys, "r", "c")
    named = T.gaps(cells, keys, rows, cols, n + 1 if n > 0 else 0, connectivity)
    roots, longest = None, _longest(cells, rows, cols)
    if longest > T.SIDE:
        named = cut(named)
        roots = cut(T.roots(named, keys, connectivity, longest))
    shut = named.filter("NOT open")
    if roots is not None:
        bad = _rooted(named.select(*keys, "piece", "open").distinct(), roots, keys).groupBy(*keys, "root").agg(F.bool_or("open").alias("_open"))
        bad = bad.filter("_open").unionByName(_totals(shut, roots, keys).filter(F.col("n") > n if n > 0 else F.lit(False)).select(*keys, "root", F.lit(True).alias("_open"))).distinct()
        shut = _rooted(shut, roots, keys).join(bad, [*keys, "root"], "left_anti")
    return own.unionByName(_placed(shut, cells, keys))


def clean_mask(cells: DataFrame, editable: DataFrame | None, keys: list[str], rows: int | str, cols: int | str, small: int = 3, k: int = 3, holes: int = 10, connectivity: int = 4) -> DataFrame:
    """Small components go, gaps close, holes fill; each step changes editable cells only (null: all)."""
    now = cells.select(*keys, "r", "c")
    longest = _longest(now, rows, cols)
    steps = [lambda m: remove_small(m, keys, small, connectivity, longest), lambda m: close_mask(m, keys, rows, cols, k), lambda m: fill_holes(m, keys, rows, cols, holes, connectivity)]
    for step in steps:
        new = step(now)
        if editable is not None:
            may = editable.select(*keys, "r", "c")
            new = new.join(may, [*keys, "r", "c"], "left_semi").unionByName(now.join(may, [*keys, "r", "c"], "left_anti"))
        now = cut(new)
    return now


def union_masks(cells: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return cells.groupBy(*keys, "r", "c").agg(F.max(value).alias(value))


def mask_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that only one mask has, as added or removed."""
    at = [*keys, "r", "c"]
    a, b = before.select(*at), after.select(*at)
    return b.join(a, at, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, at, "left_anti").withColumn("change", F.lit("removed")))


def mask_delta(before: DataFrame, after: DataFrame, keys: list[str], small: int = 3, connectivity: int = 4, size: int | None = None) -> DataFrame:
    """Areas and components before and after, cells added and removed, and the components below ``small`` cells that cleaning takes away."""
    at = [*keys, "r", "c"]
    both = before.select(*at, F.lit(1).alias("_a")).join(after.select(*at, F.lit(1).alias("_b")), at, "full_outer")
    one = lambda c: F.count(c)
    areas = both.groupBy(*keys).agg(one("_a").alias("before_cells"), one("_b").alias("after_cells"), F.count_if(F.col("_a").isNull()).alias("added"), F.count_if(F.col("_b").isNull()).alias("removed"))
    sizes = lambda m: _totals(*_labelled(m, keys, connectivity, size), keys)
    tiny = F.col("n") < small
    old = sizes(before).groupBy(*keys).agg(F.count("*").alias("components_before"), F.count_if(tiny).alias("small_components"), F.sum(F.when(tiny, F.col("n"))).alias("small_cells"))
    new = sizes(after).groupBy(*keys).agg(F.count("*").alias("components_after"))
    return areas.join(old, keys, "left").join(new, keys, "left").fillna(0, ["components_before", "components_after", "small_components", "small_cells"])


def apply_mask(maps: DataFrame, mask: DataFrame, keys: list[str], tissue: int, background: int, na: int) -> DataFrame:
    """Class and quality maps after cleaning; quality is NA off tissue and on added cells."""
    hit = mask.select(*keys, "r", "c", F.lit(True).alias("_m"))
    out = maps.join(hit, [*keys, "r", "c"], "left").withColumn("_m", F.coalesce("_m", F.lit(False)))
    was = F.col("class_id") == tissue
    cls = F.when(F.col("_m"), F.lit(tissue)).when(was, F.lit(background)).otherwise(F.col("class_id"))
    return out.select(*keys, "r", "c", cls.alias("class_id"), F.when(F.col("_m") & was, F.col("quality_id")).otherwise(F.lit(na)).alias("quality_id"))


def build_maps(results: DataFrame, classes: DataFrame, tissue: int, na: int) -> DataFrame:
    """Class ids by ordinal, unknown classes as one more id; quality only on tissue."""
    n = classes.count()
    out = results.join(classes, "label", "left").withColumn("class_id", F.coalesce("ordinal", F.lit(n)))
    return out.drop("ordinal").withColumn("quality_id", F.when(F.col("class_id") == tissue, F.coalesce("quality_id", F.lit(na))).otherwise(F.lit(na)))


def assemble_slide_mask(cells: DataFrame, regions: DataFrame, slide: str, region: str, size: int, rows: int, cols: int) -> DataFrame:
    """Dense slide mask: region cells moved by their region's corner, clipped, combined by maximum.

    Cells meet the empty grid as whole lines, one row of a slide each, which
    are only spread into cells at the end.
    """
    corner = regions.select(slide, region, F.expr(f"CAST(y1 DIV {size} AS BIGINT)").alias("_dr"), F.expr(f"CAST(x1 DIV {size} AS BIGINT)").alias("_dc"))
    moved = cells.join(corner, [slide, region]).select(slide, (F.col("r") + F.col("_dr")).cast("long").alias("r"), (F.col("c") + F.col("_dc")).cast("int").alias("c"), "value")
    moved = moved.filter((F.col("r") >= 0) & (F.col("r") < rows) & (F.col("c") >= 0) & (F.col("c") < cols))
    empty = regions.select(slide).distinct().withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))))
    put = union_masks(moved, [slide]).select(slide, "r", F.struct("c", "value").alias("_v"))
    lines = put.unionByName(empty, allowMissingColumns=True).groupBy(slide, "r").agg(F.sort_array(F.collect_list("_v")).alias("_l"))
    kind = cells.schema["value"].dataType.simpleString()
    zeros = lambda n: f"array_repeat(CAST(0 AS {kind}), {n})"
    dense = f"""CASE WHEN size(_l) = 0 THEN {zeros(cols)} ELSE flatten(concat(array({zeros('_l[0].c')}),
        transform(_l, (x, i) -> concat(array(x.value), {zeros(f'coalesce(get(_l, i + 1).c, {cols}) - x.c - 1')})))) END"""
    return lines.select(slide, "r", F.posexplode(F.expr(dense)).alias("c", "value")).withColumn("c", F.col("c").cast("long"))


def gate_patches(patches: DataFrame, threshold: float = 0.05, ratio: str = "fg_ratio", background: str = "background") -> DataFrame:
    """Keep flag by foreground ratio, null ratios kept; skipped rows get the background label with one vote."""
    keep = F.col(ratio).isNull() | (F.col(ratio) >= threshold)
    return patches.withColumns({"kept": keep, "label": F.when(~keep, background), "quality": F.when(~keep, "NA"), "votes": F.when(~keep, 1)})


def resolve_ids(df: DataFrame, classes: str, mapping: str, tissue: str = "tissue", background: str = "background") -> DataFrame:
    """Tissue and background ids: the explicit map first, else the place in the class list."""
    at = lambda name: F.coalesce(F.try_element_at(F.col(mapping), F.lit(name)), F.nullif(F.array_position(classes, name) - 1, F.lit(-1)).cast("int"))
    need = F.coalesce(at(tissue), F.raise_error(F.lit("no tissue class")).cast("int"))
    return df.withColumns({"tissue_id": need, "background_id": at(background)})
