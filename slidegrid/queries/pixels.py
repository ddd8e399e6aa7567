"""Queries of the pixel and cluster operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pixels as P
from . import fixtures as X
from .geometry import micro

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_P = f"WITH p AS ({X.PIXELS_DUCK}) "
_M = lambda e, n: f"CAST(floor(({e}) * 1e6 + 0.5) AS BIGINT) AS {n}"


def _add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def vectors(spark, d):
    """Embeddings as three numbers with their label as group."""
    e = X.table(spark, d, "embeddings")
    return e.select("vec_id", F.col("label").alias("grp"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(("x", "y", "z"))])


_E = "WITH e AS (SELECT vec_id, label AS grp, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings) "


@_add("h12_to_gray", _P + "SELECT img, x, y, " + _M("(r * 0.2125 + g * 0.7154 + b * 0.0721) / 255.0", "gray") + " FROM p")
def _(spark, d):
    return P.to_gray(X.images(spark, d).drop("gray")).select("img", "x", "y", micro(F.col("gray")).alias("gray"))


_LIN = lambda c: f"CASE WHEN {c} / 255.0 > 0.04045 THEN pow(({c} / 255.0 + 0.055) / 1.055, 2.4) ELSE {c} / 255.0 / 12.92 END"
_F = lambda c: f"CASE WHEN {c} > 0.008856 THEN pow({c}, 1.0 / 3) ELSE {c} * 7.787 + 16.0 / 116 END"
_R3 = lambda e, n: f"CAST(floor(({e}) * 1e3 + 0.5) AS BIGINT) AS {n}"


@_add("h12_to_lab", _P.rstrip() + f", l AS (SELECT img, x, y, CAST({_LIN('r')} AS DOUBLE) AS r, CAST({_LIN('g')} AS DOUBLE) AS g, CAST({_LIN('b')} AS DOUBLE) AS b FROM p), q AS (SELECT img, x, y, (r * 0.412453 + g * 0.357580 + b * 0.180423) / 0.95047 AS u, r * 0.212671 + g * 0.715160 + b * 0.072169 AS v, (r * 0.019334 + g * 0.119193 + b * 0.950227) / 1.08883 AS w FROM l), f AS (SELECT img, x, y, {_F('u')} AS u, {_F('v')} AS v, {_F('w')} AS w FROM q) SELECT img, x, y, {_R3('v * 116 - 16', 'l_star')}, {_R3('(u - v) * 500', 'a_star')}, {_R3('(v - w) * 200', 'b_star')} FROM f")
def _(spark, d):
    out = P.to_lab(X.images(spark, d))
    return out.select("img", "x", "y", *[F.floor(F.col(c) * 1e3 + 0.5).alias(c) for c in ("l_star", "a_star", "b_star")])


@_add("d12_color_histogram", _P.rstrip() + ", f AS (SELECT img, CAST(ch * 8 + least(floor(v * 8 / 256.0), 7) AS BIGINT) AS bin FROM (SELECT img, 0 AS ch, r AS v FROM p UNION ALL SELECT img, 1, g FROM p UNION ALL SELECT img, 2, b FROM p)), n AS (SELECT img, bin, count(*) AS n FROM f GROUP BY 1, 2) SELECT i.img, i.bin, " + _M("coalesce(n, 0) / 192.0", "share") + " FROM (SELECT img, bin FROM (SELECT DISTINCT img FROM p), (SELECT unnest(range(0, 24)) AS bin)) i LEFT JOIN n ON n.img = i.img AND n.bin = i.bin")
def _(spark, d):
    out = P.color_histogram(X.images(spark, d), "img", ["r", "g", "b"], 8)
    return out.select("img", F.col("bin").cast("long").alias("bin"), micro(F.col("share")).alias("share"))


@_add("d13_otsu", _P.rstrip() + """, m AS (SELECT img, r * 1.0 AS v, min(r) OVER (PARTITION BY img) * 1.0 AS lo, max(r) OVER (PARTITION BY img) * 1.0 AS hi FROM p),
 h AS (SELECT img, lo, hi, least(15, CAST(floor((v - lo) / ((hi - lo) / 16)) AS BIGINT)) AS bin, count(*) AS n FROM m GROUP BY 1, 2, 3, 4), c AS (SELECT *, lo + (bin + 0.5) * ((hi - lo) / 16) AS ce FROM h),
 s AS (SELECT *, sum(n) OVER (PARTITION BY img ORDER BY bin) AS w1, sum(n * ce) OVER (PARTITION BY img ORDER BY bin) AS s1, sum(n) OVER (PARTITION BY img) AS wt, sum(n * ce) OVER (PARTITION BY img) AS st FROM c)
 SELECT img, """ + _M("arg_max(ce, (round(CASE WHEN wt > w1 THEN w1 * (wt - w1) * pow(s1 / w1 - (st - s1) / (wt - w1), 2) ELSE -1 END, 6), -bin))", "threshold") + " FROM s GROUP BY 1")
def _(spark, d):
    p = X.images(spark, d).withColumn("r", F.col("r").cast("double"))
    return P.otsu(p, "img", "r", 16).select("img", micro(F.col("threshold")).alias("threshold"))


_K = P.gaussian_kernel(1.0)
_TAPS = "k AS (SELECT * FROM (VALUES " + ", ".join(f"({i - len(_K) // 2}, CAST({k!r} AS DOUBLE))" for i, k in enumerate(_K)) + ") t(o, k))"
_BLUR = lambda src: f"v1 AS (SELECT a.img, a.x, a.y, sum(k.k * b.gray) AS gray FROM {src} a, k JOIN {src} b ON b.img = a.img AND b.x = a.x AND b.y = greatest(0, least(7, a.y + k.o)) GROUP BY 1, 2, 3), v2 AS (SELECT a.img, a.x, a.y, sum(k.k * b.gray) AS gray FROM v1 a, k JOIN v1 b ON b.img = a.img AND b.y = a.y AND b.x = greatest(0, least(7, a.x + k.o)) GROUP BY 1, 2, 3)"


@_add("e7_gaussian_blur", _P.rstrip() + f", {_TAPS}, {_BLUR('p')} SELECT img, x, y, " + _M("gray", "gray") + " FROM v2")
def _(spark, d):
    return P.gaussian_blur(X.images(spark, d), "img", 1.0, 8, 8).select("img", "x", "y", micro(F.col("gray")).alias("gray"))


_MIRROR = lambda c: f"CASE WHEN {c} < 0 THEN -({c}) - 1 WHEN {c} >= 8 THEN 15 - ({c}) ELSE {c} END"
_EDGE = f"n AS (SELECT * FROM (VALUES (0, 0, 4.0), (-1, 0, -1.0), (1, 0, -1.0), (0, -1, -1.0), (0, 1, -1.0)) t(dx, dy, w)), ed AS (SELECT a.img, a.x, a.y, abs(sum(CAST(n.w AS DOUBLE) * b.gray)) AS gray FROM p a, n JOIN p b ON b.img = a.img AND b.x = {_MIRROR('a.x + n.dx')} AND b.y = {_MIRROR('a.y + n.dy')} GROUP BY 1, 2, 3)"


@_add("h13_blur_scores", _P.rstrip() + f", {_TAPS}, {_EDGE}, {_BLUR('ed')} SELECT img, " + _M("avg(CASE WHEN gray <= 0.25 THEN 1.0 ELSE 0.0 END)", "blur") + ", " + _M("avg(gray)", "sharp") + ", avg(CASE WHEN gray <= 0.25 THEN 1.0 ELSE 0.0 END) <= 0.5 AS passed FROM v2 GROUP BY 1")
def _(spark, d):
    s = P.blur_scores(X.images(spark, d), "img", 8, 8, 1.0, 0.25, 0.5)
    return s.select("img", micro(F.col("blur")).alias("blur"), micro(F.col("sharp")).alias("sharp"), "passed")


@_add("d19_blur_tally", _P + "SELECT count(*) AS scored, count(*) FILTER (b <= 0.5) AS passed, CAST(0 AS BIGINT) AS open FROM (SELECT img, avg(gray) AS b FROM p GROUP BY 1)")
def _(spark, d):
    s = X.images(spark, d).groupBy("img").agg(F.avg("gray").alias("blur")).withColumn("passed", F.col("blur") <= 0.5)
    return P.blur_tally(s)


@_add("h19_downsample", _P + "SELECT img, CAST(floor(x / 2.0) AS BIGINT) AS x, CAST(floor(y / 2.0) AS BIGINT) AS y, " + _M("avg(r)", "r") + " FROM p GROUP BY 1, 2, 3")
def _(spark, d):
    return P.downsample(X.images(spark, d), ["img"], 2, ["r"]).select("img", "x", "y", micro(F.col("r")).alias("r"))


@_add("d10_largest_cluster", "SELECT vec_id % 7 AS g, arg_max(label, (n, -label)) AS label, max(n) AS n FROM (SELECT vec_id % 7 AS vec_id, label - 1 AS label, count(*) AS n FROM embeddings WHERE label > 0 GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    e = X.table(spark, d, "embeddings").select((F.col("vec_id") % 7).alias("g"), (F.col("label") - 1).alias("label"))
    return P.largest_cluster(e, ["g"])


@_add("d11_cluster_centers", _E + "SELECT grp, " + ", ".join(_M(f"avg({c})", c) for c in "xyz") + " FROM e GROUP BY 1")
def _(spark, d):
    return P.cluster_centers(vectors(spark, d), ["grp"], ["x", "y", "z"]).select("grp", *[micro(F.col(c)).alias(c) for c in "xyz"])


@_add("c7_assign_nearest", _E.rstrip() + ", k AS (SELECT grp AS cluster, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM e GROUP BY 1) SELECT vec_id, arg_min(cluster, (round((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz), 12), cluster)) AS cluster FROM e, k GROUP BY 1")
def _(spark, d):
    v = vectors(spark, d).withColumn("all", F.lit(1))
    c = P.cluster_centers(v, ["all", "grp"], ["x", "y", "z"]).withColumnRenamed("grp", "cluster")
    return P.assign_nearest(v, c, ["all"], ["x", "y", "z"]).select("vec_id", "cluster")


_D2 = "({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y) + ({a}.z - {b}.z) * ({a}.z - {b}.z)".format


def _means(name: str, src: str, k: int, rounds: int) -> str:
    """Centres of k clusters of every g of ``src`` (g, i, x, y, z), and each point's nearest, round by round."""
    first = ", ".join(f"round(min({c}) + (max({c}) - min({c})) * ((2 * j + 1) / {2.0 * k}), 9) AS {c}" for c in "xyz")
    new, old = (", ".join(f.format(c=c) for c in "xyz") for f in ("round(avg({c}), 9) AS {c}", "coalesce(n.{c}, c.{c})"))
    return f"""{name}(it, g, cluster, x, y, z) AS (SELECT 0, g, j, {first.replace("2 * j + 1", "2 * any_value(j) + 1")} FROM {src}, (SELECT unnest(range(0, {k})) AS j) GROUP BY g, j
  UNION ALL SELECT c.it + 1, c.g, c.cluster, {old} FROM {name} c LEFT JOIN (
    SELECT g, cluster, {new} FROM (SELECT e.i, any_value(e.g) AS g, any_value(e.x) AS x, any_value(e.y) AS y, any_value(e.z) AS z, arg_min(m.cluster, ({_D2(a='e', b='m')}, m.cluster)) AS cluster FROM {src} e JOIN {name} m ON m.g = e.g GROUP BY e.i) GROUP BY g, cluster) n
    ON n.g = c.g AND n.cluster = c.cluster WHERE c.it < {rounds}),
 {name}_at AS (SELECT e.i, any_value(e.g) AS g, arg_min(m.cluster, ({_D2(a='e', b='m')}, m.cluster)) AS cluster FROM {src} e JOIN {name} m ON m.g = e.g AND m.it = {rounds} GROUP BY e.i)"""


def _silhouettes(name: str, src: str) -> str:
    """Mean silhouette of every g of ``src`` (g, i, cluster, x, y, z), from all pairs."""
    return f"""{name} AS (SELECT g, avg(CASE WHEN own_n <= 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END) AS s FROM (
   SELECT g, i, max(CASE WHEN own THEN n END) AS own_n, max(CASE WHEN own AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN NOT own THEN t / n END) AS b FROM (
     SELECT p.g, p.i, p.cluster = q.cluster AS own, q.cluster, sum({_D2(a='p', b='q')}) AS t, count(*) AS n FROM {src} p JOIN {src} q ON p.g = q.g GROUP BY p.g, p.i, p.cluster, q.cluster) GROUP BY g, i) GROUP BY g)"""


@_add("d14_silhouette", _E.rstrip() + ", v AS (SELECT vec_id % 3 AS g, vec_id AS i, grp AS cluster, x, y, z FROM e), " + _silhouettes("s", "v") + " SELECT g, " + _M("s", "silhouette") + " FROM s")
def _(spark, d):
    v = vectors(spark, d).withColumns({"g": F.col("vec_id") % 3, "cluster": F.col("grp")})
    return P.silhouette(v, ["g"], ["x", "y", "z"]).select("g", micro(F.col("silhouette")).alias("silhouette"))


@_add("h14_segment_background", _E.replace("WITH", "WITH RECURSIVE").rstrip() + f""", whole AS (SELECT grp AS g, vec_id AS i, x, y, z FROM e), part AS (SELECT grp * 4 + vec_id % 4 AS g, vec_id AS i, x, y, z FROM e),
 {_means("w", "whole", 2, 5)}, {_means("o", "part", 2, 5)},
 big AS (SELECT g, arg_max(cluster, (n, -cluster)) AS cluster FROM (SELECT g, cluster, count(*) AS n FROM w_at GROUP BY 1, 2) GROUP BY 1),
 back AS (SELECT w.* FROM w JOIN big USING (g, cluster) WHERE it = 5),
 near AS (SELECT o.g, arg_min(o.cluster, ({_D2(a='o', b='back')}, o.cluster)) AS cluster FROM o JOIN back ON back.g = floor(o.g / 4.0) WHERE o.it = 5 GROUP BY 1)
 SELECT CAST(floor(a.g / 4.0) AS BIGINT) AS grp, a.g % 4 AS region, """ + _M("avg(CASE WHEN a.cluster <> near.cluster THEN 1.0 ELSE 0.0 END)", "fg_ratio") + ", count(*) AS n_pixels FROM o_at a JOIN near USING (g) GROUP BY a.g")
def _(spark, d):
    v = vectors(spark, d).withColumn("region", F.col("vec_id") % 4)
    return P.segment_background(v, "grp", "region", ["x", "y", "z"]).select("grp", "region", micro(F.col("fg_ratio")).alias("fg_ratio"), "n_pixels")


_KS = (2, 3)


@_add("h15_auto_k", _E.replace("WITH", "WITH RECURSIVE").rstrip() + ", v AS (SELECT grp AS g, vec_id AS i, x, y, z FROM e), " + ", ".join(f"{_means(f'm{k}', 'v', k, 2)}, v{k} AS (SELECT v.*, cluster FROM v JOIN m{k}_at USING (i)), {_silhouettes(f's{k}', f'v{k}')}" for k in _KS)
    + " SELECT g AS grp, arg_max(k, (round(s, 9), -k)) AS k FROM (" + " UNION ALL ".join(f"SELECT g, {k} AS k, s FROM s{k}" for k in _KS) + ") GROUP BY 1")
def _(spark, d):
    return P.auto_k(vectors(spark, d), ["grp"], ["x", "y", "z"], _KS, 2)


_DB = f"""n AS (SELECT a.grp, a.vec_id AS i, b.vec_id AS j FROM e a JOIN e b ON a.grp = b.grp AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.0025),
 co AS (SELECT grp, i FROM n GROUP BY 1, 2 HAVING count(*) >= 3), l AS (SELECT n.* FROM n SEMI JOIN co ON co.i = n.i SEMI JOIN co c2 ON c2.i = n.j),
 w(i, root) AS (SELECT i, i FROM co UNION SELECT w.i, l.j FROM w JOIN l ON l.i = w.root), r AS (SELECT i, min(root) AS root FROM w GROUP BY 1),
 nm AS (SELECT n.i, arg_min(r.root, (n.i <> n.j, n.j)) AS cluster FROM n JOIN r ON r.i = n.j GROUP BY 1), big AS (SELECT cluster FROM nm GROUP BY 1 HAVING count(*) >= 4)"""


@_add("h16_density_clusters", _E.replace("WITH", "WITH RECURSIVE").rstrip() + ", " + _DB + " SELECT e.grp, e.vec_id, coalesce(CASE WHEN nm.cluster IN (SELECT cluster FROM big) THEN nm.cluster END, -1) AS cluster FROM e LEFT JOIN nm ON nm.i = e.vec_id")
def _(spark, d):
    return P.density_clusters(vectors(spark, d), ["grp"], "vec_id", 0.05, 3, 4)
