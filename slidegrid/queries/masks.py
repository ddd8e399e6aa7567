"""Queries of the cell-mask operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mask as M
from . import fixtures as X

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_T = f"WITH RECURSIVE cells AS ({X.CELLS}), t AS (SELECT slide, r, c FROM cells WHERE class_id = 1)"
K = ["slide"]


def _cc(src: str, near: str = "abs(a.r - b.r) + abs(a.c - b.c) = 1", p: str = "") -> str:
    """Components of ``src`` as {p}cc (slide, n, root)."""
    return f"""{p}e AS (SELECT a.slide, a.r * 24 + a.c AS a, b.r * 24 + b.c AS b FROM {src} a JOIN {src} b ON a.slide = b.slide AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 AND {near}),
 {p}w(slide, n, root) AS (SELECT slide, r * 24 + c, r * 24 + c FROM {src} UNION SELECT w.slide, w.n, e.b FROM {p}w w JOIN {p}e e ON e.slide = w.slide AND e.a = w.root),
 {p}cc AS (SELECT slide, n, min(root) AS root FROM {p}w GROUP BY 1, 2)"""


def _add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def tissue(spark, d):
    return X.cells(spark, d).filter("class_id = 1").select("slide", "r", "c")


@_add("c10_neighbors", _T + " SELECT a.slide, a.r, a.c, b.r AS nr, b.c AS nc FROM t a JOIN t b ON a.slide = b.slide AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c)")
def _(spark, d):
    return M.neighbors(tissue(spark, d), K, M.EIGHT).select("slide", "r", "c", "nr", "nc")


@_add("h4_components", _T + ", " + _cc("t") + " SELECT slide, count(DISTINCT root) AS n_components, count(*) AS n_cells FROM cc GROUP BY 1")
def _(spark, d):
    return M.component_summary(M.components(tissue(spark, d), K), K)


@_add("h4_components_eight", _T + ", " + _cc("t", "(a.r <> b.r OR a.c <> b.c)") + " SELECT slide, count(DISTINCT root) AS n_components, count(*) AS n_cells FROM cc GROUP BY 1")
def _(spark, d):
    return M.component_summary(M.components(tissue(spark, d), K, 8), K)


@_add("h5_remove_small", _T + ", " + _cc("t") + " SELECT slide, CAST(floor(n / 24.0) AS BIGINT) AS r, n % 24 AS c FROM (SELECT *, count(*) OVER (PARTITION BY slide, root) AS k FROM cc) WHERE k >= 3")
def _(spark, d):
    return M.remove_small(tissue(spark, d), K, 3)


@_add("h5_removed_small", _T + ", " + _cc("t") + " SELECT slide, count(*) AS removed_components, CAST(sum(k) AS BIGINT) AS removed_cells FROM (SELECT slide, root, count(*) AS k FROM cc GROUP BY 1, 2) WHERE k < 3 GROUP BY 1")
def _(spark, d):
    return M.removed_small(tissue(spark, d), K, 3)


_closing = lambda src, p="": f"""{p}g AS (SELECT slide, r, c FROM (SELECT DISTINCT slide FROM {src}), (SELECT unnest(range(0, 24)) AS r), (SELECT unnest(range(0, 24)) AS c)),
 {p}gr AS (SELECT g.slide, g.r, g.c FROM {p}g g WHERE g.r < 1 OR g.r > 22 OR g.c < 1 OR g.c > 22 OR EXISTS (SELECT 1 FROM {src} t WHERE t.slide = g.slide AND abs(t.r - g.r) <= 1 AND abs(t.c - g.c) <= 1)),
 {p}cl AS (SELECT g.slide, g.r, g.c FROM {p}g g JOIN {p}gr gr ON gr.slide = g.slide AND abs(gr.r - g.r) <= 1 AND abs(gr.c - g.c) <= 1 GROUP BY 1, 2, 3
   HAVING count(*) = (least(23, g.r + 1) - greatest(0, g.r - 1) + 1) * (least(23, g.c + 1) - greatest(0, g.c - 1) + 1))"""  # noqa: E731


@_add("h6_close_mask", _T + ", " + _closing("t") + " SELECT slide, r, c FROM cl")
def _(spark, d):
    return M.close_mask(tissue(spark, d), K, 24, 24, 3)


_back = lambda src, p="": f"{p}bg AS (SELECT slide, r, c FROM (SELECT DISTINCT slide FROM {src}), (SELECT unnest(range(0, 24)) AS r), (SELECT unnest(range(0, 24)) AS c)), {p}bk AS (SELECT * FROM {p}bg g WHERE NOT EXISTS (SELECT 1 FROM {src} t WHERE t.slide = g.slide AND t.r = g.r AND t.c = g.c))"
_filled = lambda src, p="": f"""{_back(src, p)}, {_cc(f'{p}bk', p=f'{p}b')}, {p}h AS (SELECT slide, CAST(floor(n / 24.0) AS BIGINT) AS r, n % 24 AS c, count(*) OVER (PARTITION BY slide, root) AS k,
   max(CASE WHEN n < 24 OR n >= 552 OR n % 24 IN (0, 23) THEN 1 ELSE 0 END) OVER (PARTITION BY slide, root) AS edge FROM {p}bcc),
 {p}fl AS (SELECT slide, r, c FROM {src} UNION ALL SELECT slide, r, c FROM {p}h WHERE edge = 0 AND k <= 10)"""  # noqa: E731


@_add("h7_fill_holes", _T + ", " + _filled("t") + " SELECT slide, r, c FROM fl")
def _(spark, d):
    return M.fill_holes(tissue(spark, d), K, 24, 24, 10)


#: Only cells that are tissue or background change at a step.
_within = lambda new, old, name: f"{name} AS (SELECT slide, r, c FROM {new} WHERE (slide, r, c) IN (SELECT slide, r, c FROM may) UNION ALL SELECT slide, r, c FROM {old} WHERE (slide, r, c) NOT IN (SELECT slide, r, c FROM may))"
_CLEAN = f"""{_cc('t', p='a')}, may AS (SELECT slide, r, c FROM cells WHERE class_id < 2),
 large AS (SELECT slide, CAST(floor(n / 24.0) AS BIGINT) AS r, n % 24 AS c FROM (SELECT *, count(*) OVER (PARTITION BY slide, root) AS k FROM acc) WHERE k >= 3), {_within('large', 't', 'm1')},
 {_closing('m1', 'c')}, {_within('ccl', 'm1', 'm2')}, {_filled('m2', 'f')}, {_within('ffl', 'm2', 'm3')}"""


@_add("h8_clean_mask", _T + ", " + _CLEAN + " SELECT slide, r, c FROM m3")
def _(spark, d):
    return M.clean_mask(tissue(spark, d), X.cells(spark, d).filter("class_id < 2"), K, 24, 24)


@_add("h9_apply_mask", f"WITH cells AS ({X.CELLS}) SELECT slide, r, c, CASE WHEN r % 3 > 0 THEN 1 WHEN class_id = 1 THEN 0 ELSE class_id END AS class_id, CASE WHEN r % 3 > 0 AND class_id = 1 THEN c % 3 ELSE 2 END AS quality_id FROM cells")
def _(spark, d):
    cells = X.cells(spark, d)
    return M.apply_mask(cells.withColumn("quality_id", F.col("c") % 3), cells.filter("r % 3 > 0"), K, 1, 0, 2)


@_add("h10_build_maps", f"WITH v AS ({X.VOTES}), k AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS o FROM (SELECT DISTINCT label FROM v WHERE label < 's')) SELECT run, coalesce(o, (SELECT count(*) FROM k)) AS class_id, CASE WHEN o = 1 THEN quality_id ELSE 9 END AS quality_id FROM v LEFT JOIN k USING (label)")
def _(spark, d):
    v = X.votes(spark, d)
    from pyspark.sql import Window

    classes = v.filter("label < 's'").select("label").distinct().withColumn("ordinal", F.row_number().over(Window.orderBy("label")) - 1)
    return M.build_maps(v.select("run", "label", "quality_id"), classes, 1, 9).select("run", F.col("class_id").cast("long").alias("class_id"), F.col("quality_id").cast("long").alias("quality_id"))


_REG = f"reg AS (SELECT slide, min(idx) AS region, min(x1) AS x1, min(y1) AS y1 FROM ({X.BOXES}) GROUP BY 1)"


@_add("h11_assemble_slide_mask", f"WITH {_REG}, cells AS ({X.CELLS}), m AS (SELECT reg.slide, r + floor(y1 / 16.0) AS r, c + floor(x1 / 16.0) AS c, max(class_id) AS value FROM reg JOIN cells ON cells.slide = reg.slide GROUP BY 1, 2, 3) SELECT s.slide, s.r, s.c, coalesce(m.value, 0) AS value FROM (SELECT slide, r, c FROM (SELECT DISTINCT slide FROM reg), (SELECT unnest(range(0, 30)) AS r), (SELECT unnest(range(0, 30)) AS c)) s LEFT JOIN m ON m.slide = s.slide AND m.r = s.r AND m.c = s.c")
def _(spark, d):
    reg = X.boxes(spark, d).groupBy("slide").agg(F.min("idx").alias("region"), F.min("x1").alias("x1"), F.min("y1").alias("y1"))
    cells = X.cells(spark, d).join(reg.select("slide", "region"), "slide").withColumnRenamed("class_id", "value")
    return M.assemble_slide_mask(cells, reg, "slide", "region", 16, 30, 30).select("slide", "r", "c", "value")


@_add("g5_union_masks", f"WITH cells AS ({X.CELLS}) SELECT CAST(floor(slide / 2.0) AS BIGINT) AS slide, r, c, max(class_id) AS value FROM cells GROUP BY 1, 2, 3")
def _(spark, d):
    cells = X.cells(spark, d).withColumn("slide", F.floor(F.col("slide") / 2.0))
    return M.union_masks(cells, K, "class_id").withColumnRenamed("class_id", "value")


@_add("g6_mask_diff", f"WITH cells AS ({X.CELLS}) SELECT slide, r, c, CASE WHEN class_id = 1 THEN 'removed' ELSE 'added' END AS change FROM cells WHERE class_id IN (0, 1)")
def _(spark, d):
    cells = X.cells(spark, d)
    return M.mask_diff(cells.filter("class_id > 0"), cells.filter("class_id <> 1"), K)


_SIZES = "SELECT slide, count(*) AS {0}_all, count(*) FILTER (k < 3) AS {0}_small, CAST(coalesce(sum(k) FILTER (k < 3), 0) AS BIGINT) AS {0}_cells FROM (SELECT slide, root, count(*) AS k FROM {0}cc GROUP BY 1, 2) GROUP BY 1"


@_add("d20_mask_delta", f"WITH RECURSIVE cells AS ({X.CELLS}), u AS (SELECT * FROM cells WHERE class_id > 0), v AS (SELECT * FROM cells WHERE class_id <> 1), {_cc('u', p='u')}, {_cc('v', p='v')}, a AS ({_SIZES.format('u')}), b AS ({_SIZES.format('v')}), n AS (SELECT slide, count(*) FILTER (class_id > 0) AS before_cells, count(*) FILTER (class_id <> 1) AS after_cells, count(*) FILTER (class_id = 0) AS added, count(*) FILTER (class_id = 1) AS removed FROM cells GROUP BY 1) SELECT n.*, coalesce(u_all, 0) AS components_before, coalesce(u_small, 0) AS small_components, coalesce(u_cells, 0) AS small_cells, coalesce(v_all, 0) AS components_after FROM n LEFT JOIN a USING (slide) LEFT JOIN b USING (slide)")
def _(spark, d):
    cells = X.cells(spark, d)
    return M.mask_delta(cells.filter("class_id > 0"), cells.filter("class_id <> 1"), K)


@_add("b9_gate_patches", f"WITH cells AS ({X.CELLS}) SELECT slide, r, c, class_id = 2 OR m >= 0.5 AS kept, CASE WHEN NOT (class_id = 2 OR m >= 0.5) THEN 'background' END AS label FROM (SELECT *, (r * 7 + c * 3) % 10 / 10.0 AS m FROM cells)")
def _(spark, d):
    cells = X.cells(spark, d).withColumn("fg_ratio", F.when(F.col("class_id") != 2, (F.col("r") * 7 + F.col("c") * 3) % 10 / 10.0))
    return M.gate_patches(cells, 0.5).select("slide", "r", "c", "kept", "label")


@_add("b15_resolve_ids", f"WITH v AS ({X.VOTES}), a AS (SELECT patch, list(DISTINCT label ORDER BY label) AS k FROM v GROUP BY 1) SELECT patch, CASE WHEN patch % 3 = 0 THEN 7 ELSE len(k) END AS tissue_id, CAST(CASE WHEN list_contains(k, 'view') THEN list_position(k, 'view') - 1 END AS BIGINT) AS background_id FROM a")
def _(spark, d):
    a = X.votes(spark, d).groupBy("patch").agg(F.array_sort(F.collect_set("label")).alias("k"))
    a = a.withColumns({"k": F.concat("k", F.array(F.lit("tissue"))), "m": F.when(F.col("patch") % 3 == 0, F.create_map(F.lit("tissue"), F.lit(7))).otherwise(F.from_json(F.lit("{}"), "map<string,int>"))})
    return M.resolve_ids(a, "k", "m", background="view").select("patch", F.col("tissue_id").cast("long").alias("tissue_id"), F.col("background_id").cast("long").alias("background_id"))
