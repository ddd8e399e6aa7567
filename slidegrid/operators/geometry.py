"""Boxes and points: rotation, order, padding, pixel mapping, clamping, grids.

Boxes are columns x1, y1, x2, y2; normalised coordinates run from 0 to 1000.
All functions are column arithmetic and keep every other column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")


def _replace(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """All columns replaced at once, so that each reads the old ones."""
    return df.select(*[values[c].alias(c) if c in values else F.col(c) for c in df.columns], *[v.alias(k) for k, v in values.items() if k not in df.columns])


def _by_rotation(cases: dict[int, dict[str, Column]], rot: str, names: tuple[str, ...], otherwise) -> dict[str, Column]:
    out = {}
    for n in names:
        col = F.when(F.col(rot) == 0, F.col(n))
        for angle, values in cases.items():
            col = col.when(F.col(rot) == angle, values[n])
        out[n] = col.otherwise(otherwise(n))
    return out


def rotate_box_to_upright(df: DataFrame, rot: str = "rot") -> DataFrame:
    """Boxes of a view turned by 90, 180 or 270 degrees in the upright view; other turns are an error."""
    x1, y1, x2, y2 = map(F.col, BOX)
    cases = {
        90: {"x1": 1000 - y2, "y1": x1, "x2": 1000 - y1, "y2": x2},
        180: {"x1": 1000 - x2, "y1": 1000 - y2, "x2": 1000 - x1, "y2": 1000 - y1},
        270: {"x1": y1, "y1": 1000 - x2, "x2": y2, "y2": 1000 - x1},
    }
    bad = lambda n: F.raise_error(F.concat(F.lit("unknown rotation "), F.col(rot).cast("string"))).cast(df.schema[n].dataType)
    return _replace(df, _by_rotation(cases, rot, BOX, bad))


def rotate_points_to_upright(df: DataFrame, rot: str = "rot", x: str = "nx", y: str = "ny") -> DataFrame:
    """Points of a view turned counter-clockwise; other turns leave a point as it is."""
    a, b = F.col(x), F.col(y)
    cases = {90: {x: 1000 - b, y: a}, 180: {x: 1000 - a, y: 1000 - b}, 270: {x: b, y: 1000 - a}}
    return _replace(df, _by_rotation(cases, rot, (x, y), F.col))


def clamp01k(c: Column | str) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(1000), c))


def normalize_coords(df: DataFrame, order: str, col: str = "coords") -> DataFrame:
    """Arrays in ``xyxy``/``xy`` or ``yxxy``/``yx`` order as x-first, clamped to 0-1000."""
    c = F.col(col)
    if order.startswith("y"):
        swap = [1, 0, 3, 2] if len(order) == 4 else [1, 0]
        c = F.array(*[F.get(c, F.lit(i)) for i in swap])
    return _replace(df, {col: F.transform(c, clamp01k)})


def pad_boxes(df: DataFrame, fraction: float = 0.25) -> DataFrame:
    """Boxes grown on every side by a fraction of their own size, clamped."""
    x1, y1, x2, y2 = map(F.col, BOX)
    dx, dy = (x2 - x1) * F.lit(fraction), (y2 - y1) * F.lit(fraction)
    return _replace(df, {"x1": clamp01k(x1 - dx), "y1": clamp01k(y1 - dy), "x2": clamp01k(x2 + dx), "y2": clamp01k(y2 + dy)})


def union_orientations(*views: DataFrame) -> DataFrame:
    """The boxes of all views in upright coordinates and padded, in one frame; a frame may hold several views."""
    upright = [pad_boxes(rotate_box_to_upright(v)) for v in views]
    return reduce(DataFrame.unionByName, upright)


def to_pixels(df: DataFrame, width: str = "width", height: str = "height", offset: tuple[str, str] | None = None) -> DataFrame:
    """Pixel columns px1..py2 of normalised boxes: truncated, corners in order, shifted by a parent's corner."""
    px = [(F.col(c) / 1000 * F.col(width if c[0] == "x" else height)).cast("long") for c in BOX]
    if offset:
        px = [p + F.col(offset[0 if c[0] == "x" else 1]) for p, c in zip(px, BOX, strict=True)]
    return df.withColumns({"px1": F.least(px[0], px[2]), "py1": F.least(px[1], px[3]), "px2": F.greatest(px[0], px[2]), "py2": F.greatest(px[1], px[3])})


def to_thumbnail(df: DataFrame, scale: str = "scale") -> DataFrame:
    """Full-resolution boxes on the thumbnail: outward, at least one pixel."""
    f = {c: F.floor(F.col(c) / F.col(scale)) for c in ("x1", "y1")}
    g = {c: F.ceil(F.col(c) / F.col(scale)) for c in ("x2", "y2")}
    return df.withColumns({"tx1": f["x1"], "ty1": f["y1"], "tx2": F.greatest(g["x2"], f["x1"] + 1), "ty2": F.greatest(g["y2"], f["y1"] + 1)})


def to_normalized(df: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Full-resolution boxes as 0-1000, halves to even."""
    return df.withColumns({f"n{c}": F.bround(F.col(c) * 1000.0 / F.col(width if c[0] == "x" else height)).cast("long") for c in BOX})


def clamp_boxes(df: DataFrame, mode: str = "round", width: str = "width", height: str = "height") -> DataFrame:
    """Boxes inside the slide, by rounding or outward; boxes without area go."""
    if mode not in ("round", "outward"):
        raise ValueError(f"unknown mode {mode}")
    low = F.bround if mode == "round" else F.floor
    high = F.bround if mode == "round" else F.ceil
    put = {}
    for c in BOX:
        edge = F.col(width if c[0] == "x" else height)
        value = (low if c[1] == "1" else high)(F.expr(f"try_cast({c} AS double)")).cast("long")
        put[c] = F.greatest(F.lit(0), F.least(edge, value))
    return _replace(df, put).filter("x2 > x1 AND y2 > y1")


def reject_giant(df: DataFrame, threshold: float = 0.6, slide: str = "slide", rot: str = "rot") -> DataFrame:
    """Drop the only box of a view where it covers more than ``threshold`` of it."""
    n = F.count("*").over(Window.partitionBy(slide, rot))
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / 1e6
    return df.withColumn("_n", n).filter(~((F.col("_n") == 1) & (area > threshold))).drop("_n")


def patch_grid(df: DataFrame, size: int) -> DataFrame:
    """Rows and columns of patches over each region, edge patches clipped."""
    x1, y1, x2, y2 = map(F.col, BOX)
    rows, cols = F.ceil((y2 - y1) / size).cast("int"), F.ceil((x2 - x1) / size).cast("int")
    keep = [c for c in df.columns if c not in BOX]
    out = df.filter("x2 > x1 AND y2 > y1").withColumn("row", F.explode(F.sequence(F.lit(0), rows - 1)))
    out = out.withColumn("col", F.explode(F.sequence(F.lit(0), cols - 1)))
    px, py = x1 + F.col("col") * size, y1 + F.col("row") * size
    out = out.select(*keep, "row", "col", px.alias("px1"), py.alias("py1"), F.least(px + size, x2).alias("px2"), F.least(py + size, y2).alias("py2"))
    return out.withColumn("patch_id", F.format_string("r%d_c%d_x%d_y%d", "row", "col", "px1", "py1"))


def point_windows(df: DataFrame, size: int, mode: str = "central", x: str = "x", y: str = "y", width: str = "width", height: str = "height") -> DataFrame:
    """One central or four quadrant windows around each point, moved inside the slide."""
    half = size // 2
    shifts = [(-half, -half)] if mode == "central" else [(-size, -size), (0, -size), (-size, 0), (0, 0)]
    structs = F.array(*[F.struct(F.lit(i).alias("window"), F.lit(a).alias("dx"), F.lit(b).alias("dy")) for i, (a, b) in enumerate(shifts)])
    out = df.withColumn("_w", F.explode(structs))
    wx = F.greatest(F.lit(0), F.least(F.col(width) - size, F.col(x) + F.col("_w.dx")))
    wy = F.greatest(F.lit(0), F.least(F.col(height) - size, F.col(y) + F.col("_w.dy")))
    return out.withColumns({"window": F.col("_w.window"), "wx": wx, "wy": wy}).drop("_w")


def best_level(regions: DataFrame, levels: DataFrame, target: int, slide: str = "slide") -> DataFrame:
    """The pyramid level at which a region's longer side is nearest ``target``; the first wins a tie.

    The few levels of a slide meet each region as one array, so equal regions
    all stay. Regions of slides without levels go.
    """
    down = F.coalesce("downsample", F.pow(F.lit(2.0), F.col("level")))
    few = levels.groupBy(slide).agg(F.collect_list(F.struct("level", down.alias("down"))).alias("_levels"))
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    best = F.array_min(F.transform("_levels", lambda v: F.struct(F.abs(side / v["down"] - target).alias("d"), v["level"].alias("level"))))
    return regions.join(few, slide).select(*[F.col(c) for c in regions.columns], best["level"].alias("level"))


def hull(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
