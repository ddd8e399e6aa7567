"""Queries of the box, point and grid operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import overlap as O
from . import fixtures as X

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_B = f"WITH b AS ({X.BOXES}) "
_UP = """u AS (SELECT slide, rot, idx,
  CASE rot WHEN 0 THEN x1 WHEN 90 THEN 1000 - y2 WHEN 180 THEN 1000 - x2 ELSE y1 END AS x1,
  CASE rot WHEN 0 THEN y1 WHEN 90 THEN x1 WHEN 180 THEN 1000 - y2 ELSE 1000 - x2 END AS y1,
  CASE rot WHEN 0 THEN x2 WHEN 90 THEN 1000 - y1 WHEN 180 THEN 1000 - x1 ELSE y2 END AS x2,
  CASE rot WHEN 0 THEN y2 WHEN 90 THEN x2 WHEN 180 THEN 1000 - y1 ELSE 1000 - x1 END AS y2 FROM b)"""


def micro(c):
    """Floats are compared as rounded millionths in both engines."""
    return F.floor(c * 1e6 + 0.5).cast("long")


def _add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


@_add("b1_rotate_box", _B.rstrip() + ", " + _UP + " SELECT * FROM u")
def _(spark, d):
    return G.rotate_box_to_upright(X.boxes(spark, d)).select("slide", "rot", "idx", "x1", "y1", "x2", "y2")


@_add("b2_rotate_point", _B + """SELECT slide, idx, CASE rot WHEN 90 THEN 1000 - y1 WHEN 180 THEN 1000 - x1 WHEN 270 THEN y1 ELSE x1 END AS nx,
  CASE rot WHEN 90 THEN x1 WHEN 180 THEN 1000 - y1 WHEN 270 THEN 1000 - x1 ELSE y1 END AS ny FROM b""")
def _(spark, d):
    b = X.boxes(spark, d).select("slide", "rot", "idx", F.col("x1").alias("nx"), F.col("y1").alias("ny"))
    return G.rotate_points_to_upright(b).select("slide", "idx", "nx", "ny")


@_add("b3_normalize_coords", _B + "SELECT slide, idx, greatest(0, least(1000, x1 * 2 - 300)) AS x1, greatest(0, least(1000, y1 * 2 - 300)) AS y1, greatest(0, least(1000, x2 * 2 - 300)) AS x2, greatest(0, least(1000, y2 * 2 - 300)) AS y2 FROM b")
def _(spark, d):
    b = X.boxes(spark, d).select("slide", "idx", F.array(*[F.col(c) * 2 - 300 for c in ("y1", "x1", "y2", "x2")]).alias("coords"))
    b = G.normalize_coords(b, "yxxy")
    return b.select("slide", "idx", *[F.col("coords")[i].alias(c) for i, c in enumerate(G.BOX)])


@_add("b4_pad_boxes", _B + """SELECT slide, idx, CAST(floor(greatest(0, x1 - (x2 - x1) * 0.25) * 1e6 + 0.5) AS BIGINT) AS x1, CAST(floor(greatest(0, y1 - (y2 - y1) * 0.25) * 1e6 + 0.5) AS BIGINT) AS y1,
  CAST(floor(least(1000, x2 + (x2 - x1) * 0.25) * 1e6 + 0.5) AS BIGINT) AS x2, CAST(floor(least(1000, y2 + (y2 - y1) * 0.25) * 1e6 + 0.5) AS BIGINT) AS y2 FROM b""")
def _(spark, d):
    b = G.pad_boxes(X.boxes(spark, d).withColumns({c: F.col(c).cast("double") for c in G.BOX}))
    return b.select("slide", "idx", *[micro(F.col(c)).alias(c) for c in G.BOX])


@_add("b5_to_pixels", _B + """SELECT slide, idx, CAST(trunc(x1 / 1000.0 * (20000 + slide % 7 * 1000)) AS BIGINT) AS px1, CAST(trunc(y1 / 1000.0 * 15000) AS BIGINT) AS py1,
  CAST(trunc(x2 / 1000.0 * (20000 + slide % 7 * 1000)) AS BIGINT) AS px2, CAST(trunc(y2 / 1000.0 * 15000) AS BIGINT) AS py2 FROM b""")
def _(spark, d):
    b = X.boxes(spark, d).withColumns({"width": 20000 + F.col("slide") % 7 * 1000, "height": F.lit(15000)})
    return G.to_pixels(b).select("slide", "idx", "px1", "py1", "px2", "py2")


@_add("b6_thumbnail_normalized", _B + """SELECT slide, idx, CAST(floor(x1 / 7.0) AS BIGINT) AS tx1, CAST(floor(y1 / 7.0) AS BIGINT) AS ty1,
  CAST(greatest(ceil(x2 / 7.0), floor(x1 / 7.0) + 1) AS BIGINT) AS tx2, CAST(greatest(ceil(y2 / 7.0), floor(y1 / 7.0) + 1) AS BIGINT) AS ty2,
  CAST(round_even(x1 * 1000.0 / 1600, 0) AS BIGINT) AS nx1, CAST(round_even(y1 * 1000.0 / 1600, 0) AS BIGINT) AS ny1, CAST(round_even(x2 * 1000.0 / 1600, 0) AS BIGINT) AS nx2, CAST(round_even(y2 * 1000.0 / 1600, 0) AS BIGINT) AS ny2 FROM b""")
def _(spark, d):
    b = X.boxes(spark, d).withColumns({"scale": F.lit(7.0), "width": F.lit(1600), "height": F.lit(1600)})
    b = G.to_normalized(G.to_thumbnail(b))
    return b.select("slide", "idx", *[F.col(c).cast("long").alias(c) for c in ("tx1", "ty1", "tx2", "ty2", "nx1", "ny1", "nx2", "ny2")])


@_add("b7_clamp_boxes", _B + """SELECT * FROM (SELECT slide, idx, greatest(0, least(700, x1 - 50)) AS x1, greatest(0, least(600, y1 - 50)) AS y1, greatest(0, least(700, x2 - 50)) AS x2, greatest(0, least(600, y2 - 50)) AS y2 FROM b) WHERE x2 > x1 AND y2 > y1""")
def _(spark, d):
    b = X.boxes(spark, d).withColumns({c: F.col(c) - 50 for c in G.BOX} | {"width": F.lit(700), "height": F.lit(600)})
    return G.clamp_boxes(b).select("slide", "idx", "x1", "y1", "x2", "y2")


@_add("b8_reject_giant", _B + "SELECT slide, rot, idx FROM (SELECT *, count(*) OVER (PARTITION BY slide, rot, x1 % 3) AS n FROM b) WHERE NOT (n = 1 AND (x2 - x1) * (y2 - y1) / 1e6 > 0.001)")
def _(spark, d):
    b = X.boxes(spark, d).withColumn("view", F.concat_ws("-", "rot", (F.col("x1") % 3)))
    return G.reject_giant(b, 0.001, rot="view").select("slide", "rot", "idx")


_LEVELS = "l AS (SELECT DISTINCT slide, level, CAST(1 << level AS DOUBLE) AS downsample FROM b, (SELECT unnest([0, 1, 2, 3, 4]) AS level))"


@_add("b16_best_level", _B.rstrip() + ", " + _LEVELS + " SELECT b.slide, b.idx, CAST(arg_min(level, (abs(greatest(x2 - x1, y2 - y1) / downsample - 16), level)) AS BIGINT) AS level FROM b JOIN l USING (slide) GROUP BY 1, 2")
def _(spark, d):
    b = X.boxes(spark, d)
    levels = b.select("slide").distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("downsample", F.lit(None).cast("double"))
    return G.best_level(b, levels, 16).select("slide", "idx", F.col("level").cast("long").alias("level"))


@_add("c1_overlap_pairs", _B + """SELECT a.slide, a.idx AS a, b.idx AS b, CAST(floor((least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) * 1.0 / least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) * 1e6 + 0.5) AS BIGINT) AS score
  FROM b a JOIN b b ON a.slide = b.slide AND a.idx < b.idx AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2""")
def _(spark, d):
    return O.overlap_pairs(X.boxes(spark, d)).select("slide", "a", "b", micro(F.col("score")).alias("score"))


@_add("c12_crop_pixels", f"WITH p AS ({X.PIXELS_DUCK}) SELECT img, box, x - bx AS x, y - box AS y, r FROM (SELECT img, x, y, r, box, img % 3 AS bx FROM p, (SELECT unnest([0, 2, 4]) AS box)) WHERE x >= bx AND x < bx + 4 AND y >= box AND y < box + 3")
def _(spark, d):
    p = X.images(spark, d)
    b = p.select("img").distinct().withColumn("box", F.explode(F.array(*map(F.lit, (0, 2, 4)))))
    b = b.withColumns({"x1": F.col("img") % 3, "y1": F.col("box")}).withColumns({"x2": F.col("x1") + 4, "y2": F.col("y1") + 3})
    return O.crop_pixels(p.select("img", "x", "y", "r"), b).select("img", "box", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "r")


_GRID = """g AS (SELECT slide, idx, "row", col, x1 + col * 16 AS px1, y1 + "row" * 16 AS py1, least(x1 + col * 16 + 16, x2) AS px2, least(y1 + "row" * 16 + 16, y2) AS py2
  FROM (SELECT *, unnest(range(0, CAST(ceil((x2 - x1) / 16.0) AS BIGINT))) AS col FROM (SELECT *, unnest(range(0, CAST(ceil((y2 - y1) / 16.0) AS BIGINT))) AS "row" FROM b)))"""


@_add("h1_patch_grid", _B.rstrip() + ", " + _GRID + """ SELECT slide, idx, CAST("row" AS BIGINT) AS "row", CAST(col AS BIGINT) AS col, CAST(px1 AS BIGINT) AS px1, CAST(py1 AS BIGINT) AS py1, CAST(px2 AS BIGINT) AS px2, CAST(py2 AS BIGINT) AS py2, concat('r', "row", '_c', col, '_x', px1, '_y', py1) AS patch_id FROM g""")
def _(spark, d):
    g = G.patch_grid(X.boxes(spark, d), 16)
    return g.select("slide", "idx", *[F.col(c).cast("long").alias(c) for c in ("row", "col", "px1", "py1", "px2", "py2")], "patch_id")


@_add("c2_foreground_ratio", f"""WITH b AS ({X.BOXES}), m AS (SELECT slide * 12 AS lo, slide, r, c FROM ({X.CELLS}) WHERE class_id = 1),
  g AS (SELECT slide, idx, CAST(trunc(y1 * 0.024) AS BIGINT) AS r1, least(24, CAST(ceil(y2 * 0.024) AS BIGINT)) AS r2, CAST(trunc(x1 * 0.024) AS BIGINT) AS c1, least(24, CAST(ceil(x2 * 0.024) AS BIGINT)) AS c2 FROM b)
  SELECT g.slide, g.idx, CAST(floor(count(m.r) * 1.0 / ((any_value(r2) - any_value(r1)) * (any_value(c2) - any_value(c1))) * 1e6 + 0.5) AS BIGINT) AS fg_ratio
  FROM g LEFT JOIN m ON m.slide = g.slide AND m.r >= r1 AND m.r < r2 AND m.c >= c1 AND m.c < c2 GROUP BY 1, 2""")
def _(spark, d):
    b = X.boxes(spark, d)
    p = b.select("slide", F.col("idx").alias("patch_id"), *[F.col(c).alias(f"p{c}") for c in G.BOX])
    out = O.foreground_ratio(p, X.cells(spark, d).filter("class_id = 1"), 0.024, ["slide"], 24, 24)
    return out.select("slide", F.col("patch_id").alias("idx"), micro(F.col("fg_ratio")).alias("fg_ratio"))


_MEET = "a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2"
#: All hulls of a slide anew in each round, each joined to the least that it meets, while the slide has two that meet.
_ANY = f"""h(slide, it, idx, x1, y1, x2, y2) AS (SELECT slide, 0, idx, x1, y1, x2, y2 FROM b
  UNION ALL SELECT slide, it + 1, min(idx), min(x1), min(y1), max(x2), max(y2) FROM (
    SELECT *, max(n) OVER (PARTITION BY slide) AS most FROM (
      SELECT a.slide, a.it, a.idx, a.x1, a.y1, a.x2, a.y2, min(b.idx) AS root, count(*) AS n
      FROM h a JOIN h b ON a.slide = b.slide AND {_MEET} GROUP BY 1, 2, 3, 4, 5, 6, 7)) WHERE most > 1 GROUP BY slide, it, root)"""


@_add("h3_merge_boxes_any", f"WITH RECURSIVE b AS ({X.BOXES}), {_ANY} SELECT slide, idx, x1, y1, x2, y2 FROM h QUALIFY it = max(it) OVER (PARTITION BY slide)")
def _(spark, d):
    return O.merge_boxes_any(X.boxes(spark, d))


_W, _H = ("least(h.{0}2, v[1].{0}2) - greatest(h.{0}1, v[1].{0}1)".format(c) for c in "xy")
_SHARE = f"({_W}) > 0 AND ({_H}) > 0 AND ({_W}) * ({_H}) / least((h.x2 - h.x1) * (h.y2 - h.y1), (v[1].x2 - v[1].x1) * (v[1].y2 - v[1].y1))::DOUBLE >= 0.2"
#: A turn as a fold over the boxes in order: the first hull that a box overlaps enough takes it in, else it opens one.
_TURN = f"""list_reduce(hs, lambda u, v: list_transform([list_position(list_transform(u, lambda h: {_SHARE}), true)], lambda k: CASE WHEN k IS NULL OR k = 0 THEN list_concat(u, v)
   ELSE list_concat(u[:k - 1], [{{'x1': least(u[k].x1, v[1].x1), 'y1': least(u[k].y1, v[1].y1), 'x2': greatest(u[k].x2, v[1].x2), 'y2': greatest(u[k].y2, v[1].y2)}}], u[k + 1:]) END)[1])"""
_ORDERED = f"""o(slide, had, hs) AS (SELECT slide, CAST(-1 AS BIGINT), list([{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] ORDER BY rot, idx) FROM b GROUP BY 1
  UNION ALL SELECT slide, CAST(len(hs) AS BIGINT), list_transform({_TURN}, lambda h: [h]) FROM o WHERE had <> len(hs)),
  m AS (SELECT slide, e[1].x1 AS x1, e[1].y1 AS y1, e[1].x2 AS x2, e[1].y2 AS y2 FROM (SELECT slide, unnest(hs) AS e FROM o WHERE had = len(hs)))"""


@_add("h2_merge_boxes", f"WITH RECURSIVE b AS ({X.BOXES}), {_ORDERED} SELECT * FROM m")
def _(spark, d):
    return O.merge_boxes(X.boxes(spark, d), 0.2)


@_add("d8_tta_counts", f"WITH RECURSIVE b AS ({X.BOXES}), {_ORDERED} SELECT b.slide, count(*) FILTER (rot = 0) AS n_0, count(*) FILTER (rot = 90) AS n_90, count(*) FILTER (rot = 180) AS n_180, count(*) FILTER (rot = 270) AS n_270, count(*) AS n_all, any_value(n) AS n_merged FROM b JOIN (SELECT slide, count(*) AS n FROM m GROUP BY 1) USING (slide) GROUP BY 1")
def _(spark, d):
    from ..operators.votes import tta_counts

    b = X.boxes(spark, d)
    return tta_counts(b, O.merge_boxes(b, 0.2))


@_add("d9_hull", _B + "SELECT slide, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM b GROUP BY 1")
def _(spark, d):
    return G.hull(X.boxes(spark, d), ["slide"])


@_add("d21_dedupe_regions", _B + "SELECT slide, min(idx) AS idx, x1 % 20 AS x1, y1 % 20 AS y1 FROM b GROUP BY slide, x1 % 20, y1 % 20")
def _(spark, d):
    from ..operators.catalog import dedupe_regions

    b = X.boxes(spark, d).select("slide", "idx", (F.col("x1") % 20).alias("x1"), (F.col("y1") % 20).alias("y1"))
    return dedupe_regions(b, ["slide", "x1", "y1"], "idx").select("slide", "idx", "x1", "y1")


@_add("e2_number_regions", _B + "SELECT slide, idx, CASE WHEN idx % 5 = 0 THEN 'named' ELSE concat('tissue_', row_number() OVER (PARTITION BY slide ORDER BY rot, idx)) END AS label FROM b")
def _(spark, d):
    from ..operators.catalog import number_regions

    b = X.boxes(spark, d).withColumn("label", F.when(F.col("idx") % 5 == 0, "named"))
    return number_regions(b, ["rot", "idx"]).select("slide", "idx", "label")


_PADDED = ", ".join(f"CAST(floor({f} * 1e6 + 0.5) AS BIGINT) AS {n}" for v in "xy" for f, n in ((f"greatest(0, {v}1 - ({v}2 - {v}1) * 0.25)", f"{v}1"), (f"least(1000, {v}2 + ({v}2 - {v}1) * 0.25)", f"{v}2")))


@_add("g1_union_orientations", _B.rstrip() + ", " + _UP + f" SELECT slide, idx, {_PADDED} FROM u")
def _(spark, d):
    b = X.boxes(spark, d).withColumns({c: F.col(c).cast("double") for c in G.BOX})
    out = G.union_orientations(*[b.filter(F.col("rot") == r) for r in (0, 90, 180, 270)])
    return out.select("slide", "idx", *[micro(F.col(c)).alias(c) for c in G.BOX])


@_add("h18_point_windows", _B + """SELECT slide, idx, w AS "window", greatest(0, least(900, x1 + CASE w WHEN 0 THEN -100 WHEN 1 THEN 0 WHEN 2 THEN -100 ELSE 0 END)) AS wx, greatest(0, least(900, y1 + CASE WHEN w < 2 THEN -100 ELSE 0 END)) AS wy FROM b, (SELECT unnest([0, 1, 2, 3]) AS w)""")
def _(spark, d):
    b = X.boxes(spark, d).select("slide", "idx", F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(1000).alias("width"), F.lit(1000).alias("height"))
    return G.point_windows(b, 100, "quadrants").select("slide", "idx", "window", F.col("wx").cast("long").alias("wx"), F.col("wy").cast("long").alias("wy"))
