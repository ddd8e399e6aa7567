"""Queries of whole jobs and of the streaming jobs' batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import slide_quality as Q
from ..streaming import stream_throughput
from . import fixtures as X
from .geometry import _ANY, _UP
from .masks import _cc, _within

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _l3(spark, d):
    return Q.slide_quality(X.boxes(spark, d), X.cells(spark, d))


def _j3(spark, d):
    e = X.table(spark, d, "events")
    return stream_throughput(e).select(F.unix_timestamp("start").alias("start"), "n")


QUERIES |= {"l3_slide_quality": _l3, "j3_throughput": _j3}
ORACLE["j3_throughput"] = "SELECT CAST(floor(epoch(ts) / 600.0) * 600 AS BIGINT) AS start, count(*) AS n FROM events GROUP BY 1"

_PAD = ", ".join(f"{f}(greatest(0, least(1000, {v}{n} {sign} ({v}2 - {v}1) * CAST(0.25 AS DOUBLE)))) AS {v}{n}" for v in "xy" for f, n, sign in (("floor", 1, "-"), ("ceil", 2, "+")))
#: Regions, known by slide * 1000 and their number, their patches with ratio and gate, and the vote of the cells in each.
_REGIONS = f"""b0 AS ({X.BOXES}), cells AS ({X.CELLS}), {_UP.replace('FROM b)', 'FROM b0)')}, b AS (SELECT slide, idx, {_PAD} FROM u), {_ANY},
 reg AS (SELECT slide, slide * 1000 + row_number() OVER (PARTITION BY slide ORDER BY idx) AS k, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, CAST(x2 AS BIGINT) AS x2, CAST(y2 AS BIGINT) AS y2 FROM (SELECT * FROM h QUALIFY it = max(it) OVER (PARTITION BY slide))),
 g AS (SELECT slide, k, r, c, x1 + c * 100 AS px1, y1 + r * 100 AS py1, least(x1 + c * 100 + 100, x2) AS px2, least(y1 + r * 100 + 100, y2) AS py2
   FROM (SELECT *, unnest(range(0, CAST(ceil((x2 - x1) / 100.0) AS BIGINT))) AS c FROM (SELECT *, unnest(range(0, CAST(ceil((y2 - y1) / 100.0) AS BIGINT))) AS r FROM reg WHERE x2 > x1 AND y2 > y1))),
 f AS (SELECT *, least(24, CAST(trunc(py1 * CAST(0.024 AS DOUBLE)) AS BIGINT)) AS r1, least(24, CAST(ceil(py2 * CAST(0.024 AS DOUBLE)) AS BIGINT)) AS r2, least(24, CAST(trunc(px1 * CAST(0.024 AS DOUBLE)) AS BIGINT)) AS c1, least(24, CAST(ceil(px2 * CAST(0.024 AS DOUBLE)) AS BIGINT)) AS c2 FROM g),
 p AS (SELECT slide, k, r, c, CASE WHEN r2 > r1 AND c2 > c1 THEN hits / CAST((r2 - r1) * (c2 - c1) AS DOUBLE) ELSE 0.0 END AS ratio FROM (
   SELECT f.slide, f.k, f.r, f.c, any_value(r1) AS r1, any_value(r2) AS r2, any_value(c1) AS c1, any_value(c2) AS c2, count(m.r) AS hits
   FROM f LEFT JOIN (SELECT slide, r, c FROM cells WHERE class_id = 1) m ON m.slide = f.slide AND m.r >= r1 AND m.r < r2 AND m.c >= c1 AND m.c < c2 GROUP BY 1, 2, 3, 4)),
 pl AS (SELECT slide, r * 24 + c AS run, class_id, CAST(floor((CAST(c AS DOUBLE) + 0.5) * 1000 / 24) AS BIGINT) AS x, CAST(floor((CAST(r AS DOUBLE) + 0.5) * 1000 / 24) AS BIGINT) AS y FROM cells),
 vo AS (SELECT reg.k, CAST(floor((y - y1) / 100.0) AS BIGINT) AS r, CAST(floor((x - x1) / 100.0) AS BIGINT) AS c, class_id, count(*) AS n, min(run) AS o FROM pl JOIN reg ON reg.slide = pl.slide AND x >= x1 AND x < x2 AND y >= y1 AND y < y2 GROUP BY 1, 2, 3, 4),
 mj AS (SELECT k, r, c, arg_max(class_id, (n, -o)) AS class_id FROM vo GROUP BY 1, 2, 3),
 mp AS (SELECT p.k AS slide, p.r, p.c, CASE WHEN ratio >= 0.05 THEN coalesce(mj.class_id, 0) ELSE 0 END AS class_id FROM p LEFT JOIN mj ON mj.k = p.k AND mj.r = p.r AND mj.c = p.c),
 t AS (SELECT slide, r, c FROM mp WHERE class_id = 1), may AS (SELECT slide, r, c FROM mp WHERE class_id < 2), ext AS (SELECT slide, max(r) + 1 AS nr, max(c) + 1 AS nc FROM mp GROUP BY 1)"""
_CLEANED = f"""{_cc('t', p='a')}, large AS (SELECT slide, CAST(floor(n / 24.0) AS BIGINT) AS r, n % 24 AS c FROM (SELECT *, count(*) OVER (PARTITION BY slide, root) AS many FROM acc) WHERE many >= 3), {_within('large', 't', 'm1')},
 full1 AS (SELECT ext.slide, nr, nc, r, c FROM ext, (SELECT unnest(range(0, 10)) AS r), (SELECT unnest(range(0, 10)) AS c) WHERE r < nr AND c < nc),
 gr AS (SELECT slide, r, c FROM full1 q WHERE slide IN (SELECT slide FROM m1) AND (r < 1 OR r > nr - 2 OR c < 1 OR c > nc - 2 OR EXISTS (SELECT 1 FROM m1 WHERE m1.slide = q.slide AND abs(m1.r - q.r) <= 1 AND abs(m1.c - q.c) <= 1))),
 cl AS (SELECT q.slide, q.r, q.c FROM full1 q JOIN gr ON gr.slide = q.slide AND abs(gr.r - q.r) <= 1 AND abs(gr.c - q.c) <= 1 GROUP BY q.slide, q.r, q.c, nr, nc HAVING count(*) = (least(nr - 1, q.r + 1) - greatest(0, q.r - 1) + 1) * (least(nc - 1, q.c + 1) - greatest(0, q.c - 1) + 1)), {_within('cl', 'm1', 'm2')},
 bk AS (SELECT slide, r, c FROM full1 q WHERE slide IN (SELECT slide FROM m2) AND NOT EXISTS (SELECT 1 FROM m2 WHERE m2.slide = q.slide AND m2.r = q.r AND m2.c = q.c)), {_cc('bk', p='b')},
 ho AS (SELECT slide, CAST(floor(n / 24.0) AS BIGINT) AS r, n % 24 AS c, count(*) OVER (PARTITION BY slide, root) AS many, max(CASE WHEN n < 24 OR floor(n / 24.0) = nr - 1 OR n % 24 IN (0, nc - 1) THEN 1 ELSE 0 END) OVER (PARTITION BY slide, root) AS edge FROM bcc JOIN ext USING (slide)),
 fi AS (SELECT slide, r, c FROM m2 UNION ALL SELECT slide, r, c FROM ho WHERE edge = 0 AND many <= 10), {_within('fi', 'm2', 'm3')}, {_cc('m3', p='z')}"""
_OF = "CAST(floor({0}.slide / 1000.0) AS BIGINT)".format
_SUMMARY = f"""ta AS (SELECT slide, count(DISTINCT k) AS n_regions, count(*) AS n_patches, count(*) FILTER (ratio >= 0.05) AS n_kept, CAST(floor(avg(ratio) * 1e6 + 0.5) AS BIGINT) AS mean_ratio FROM p GROUP BY 1),
 ch AS (SELECT {_OF('d')} AS slide, count(a) AS before_cells, count(z) AS after_cells, count(z) FILTER (a IS NULL) AS added, count(a) FILTER (z IS NULL) AS removed FROM (SELECT slide, r, c, max(a) AS a, max(z) AS z FROM (SELECT slide, r, c, 1 AS a, NULL AS z FROM t UNION ALL SELECT slide, r, c, NULL, 1 FROM m3) GROUP BY 1, 2, 3) d GROUP BY 1),
 co AS (SELECT {_OF('d')} AS slide, count(*) AS components_before, count(*) FILTER (many < 3) AS small_components FROM (SELECT slide, root, count(*) AS many FROM acc GROUP BY 1, 2) d GROUP BY 1),
 cz AS (SELECT {_OF('d')} AS slide, count(*) AS components_after FROM (SELECT DISTINCT slide, root FROM zcc) d GROUP BY 1),
 va AS (SELECT mp.slide, mp.r, mp.c, CASE WHEN m3.r IS NOT NULL THEN 2 WHEN class_id = 2 THEN 1 ELSE 0 END AS value FROM mp LEFT JOIN m3 ON m3.slide = mp.slide AND m3.r = mp.r AND m3.c = mp.c),
 pa AS (SELECT slide, count(*) FILTER (value = 2) AS mask_tissue, count(*) FILTER (value = 1) AS mask_artifact FROM (SELECT reg.slide, va.r + CAST(floor(y1 / 100.0) AS BIGINT) AS r, va.c + CAST(floor(x1 / 100.0) AS BIGINT) AS c, max(value) AS value FROM va JOIN reg ON reg.k = va.slide GROUP BY 1, 2, 3) WHERE r < 10 AND c < 10 GROUP BY 1)"""
_COUNTS = ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("before_cells", "after_cells", "added", "removed", "components_before", "small_components", "components_after", "mask_tissue", "mask_artifact"))
ORACLE["l3_slide_quality"] = f"WITH RECURSIVE {_REGIONS}, {_CLEANED}, {_SUMMARY} SELECT slide, n_regions, n_patches, n_kept, mean_ratio, {_COUNTS}, 100 AS mask_cells FROM ta LEFT JOIN ch USING (slide) LEFT JOIN co USING (slide) LEFT JOIN cz USING (slide) LEFT JOIN pa USING (slide)"
