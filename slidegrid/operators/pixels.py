"""Pixel tables: colour, histograms, thresholds, smoothing, blur, clustering."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.fixpoint import components, cut


def to_gray(df: DataFrame) -> DataFrame:
    """Luminance of 8-bit r, g, b in 0-1."""
    return df.withColumn("gray", (F.col("r") * 0.2125 + F.col("g") * 0.7154 + F.col("b") * 0.0721) / 255.0)


def to_lab(df: DataFrame) -> DataFrame:
    """CIE LAB (D65) of 8-bit sRGB."""
    lin = lambda c: F.when(F.col(c) / 255.0 > 0.04045, F.pow((F.col(c) / 255.0 + 0.055) / 1.055, F.lit(2.4))).otherwise(F.col(c) / 255.0 / 12.92)
    r, g, b = lin("r"), lin("g"), lin("b")
    f = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1.0 / 3))).otherwise(t * 7.787 + 16.0 / 116)
    out = df.withColumns({"_x": f((r * 0.412453 + g * 0.357580 + b * 0.180423) / 0.95047), "_y": f(r * 0.212671 + g * 0.715160 + b * 0.072169), "_z": f((r * 0.019334 + g * 0.119193 + b * 0.950227) / 1.08883)})
    return out.withColumns({"l_star": F.col("_y") * 116 - 16, "a_star": (F.col("_x") - F.col("_y")) * 500, "b_star": (F.col("_y") - F.col("_z")) * 200}).drop("_x", "_y", "_z")


def color_histogram(pixels: DataFrame, key: str, channels: list[str], bins: int = 32) -> DataFrame:
    """(key, bin, share): bins of all channels in one row of numbers that sum to 1, zeros included."""
    values = F.posexplode(F.array(*[F.col(c).cast("double") for c in channels]))
    flat = pixels.select(key, values.alias("chan", "v"))
    at = F.col("chan") * bins + F.least(F.floor(F.col("v") * bins / 256), F.lit(bins - 1))
    n = flat.groupBy(key, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    dense = n.select(key).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins * len(channels) - 1))))
    out = dense.join(n, [key, "bin"], "left").fillna(0, ["n"])
    return out.select(key, "bin", (F.col("n") / F.sum("n").over(Window.partitionBy(key))).alias("share"))


def otsu(pixels: DataFrame, key: str, value: str = "gray", bins: int = 256) -> DataFrame:
    """(key, threshold) that parts gray values with the most variance between; 0.5 for one value only.

    The range of each image comes from an aggregate of its own, so pixels are
    only ever pre-aggregated; what is shuffled is a row a bin.
    """
    w = Window.partitionBy(key)
    span = pixels.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    x = pixels.select(key, F.col(value).alias("v")).join(span, key)
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / width)))
    h = x.groupBy(key, "lo", "hi", at.alias("bin")).agg(F.count("*").alias("n"))
    h = h.withColumn("center", F.col("lo") + (F.col("bin") + 0.5) * width)
    # windows over the bins of an image, of which there are no more than ``bins``
    up = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = h.withColumns({"w1": F.sum("n").over(up), "s1": F.sum(F.col("n") * F.col("center")).over(up), "wt": F.sum("n").over(w), "st": F.sum(F.col("n") * F.col("center")).over(w)})
    w2 = F.col("wt") - F.col("w1")
    between = F.when(w2 > 0, F.col("w1") * w2 * F.pow(F.col("s1") / F.col("w1") - (F.col("st") - F.col("s1")) / w2, F.lit(2.0))).otherwise(-1.0)
    best = h.groupBy(key).agg(F.max_by("center", F.struct(F.round(between, 6), -F.col("bin"))).alias("center"), F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    return best.select(key, F.when(F.col("hi") == F.col("lo"), 0.5).otherwise(F.col("center")).alias("threshold"))


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    k = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [x / sum(k) for x in k]


def _smooth(v: np.ndarray, there: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Weighted sums down, then across, over arrays that bring the kernel's reach on all sides; absent pixels count nothing."""
    r = len(kernel) // 2
    n, w = v.shape[0] - 2 * r, v.shape[1] - 2 * r
    down = sum(k * v[i : i + n] for i, k in enumerate(kernel)) * there[r : r + n]
    return sum(k * down[:, i : i + w] for i, k in enumerate(kernel))


def _on_tiles(pixels: DataFrame, key: str, value: str, width: int, height: int, halo: int, work: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(key, x, y, value): ``work`` applied to square tiles of an image, each with ``halo`` pixels round it.

    ``work`` gets values, which of them are there, and the rows and columns of
    the grid that each line of the array stands for; lines beyond the image's
    edge are left to it. Only pixels near a tile's border are sent twice.
    """
    side = max(64, 4 * halo)
    span = lambda c: F.sequence(F.floor((F.col(c) - halo) / side), F.floor((F.col(c) + halo) / side))
    dealt = pixels.select(key, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col(value).cast("double").alias("v")).filter((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))
    dealt = dealt.withColumn("ty", F.explode(span("y"))).withColumn("tx", F.explode(span("x")))
    dealt = dealt.filter((F.col("ty") >= 0) & (F.col("tx") >= 0) & (F.col("ty") * side < height) & (F.col("tx") * side < width))
    tiles = dealt.groupBy(key, "ty", "tx").agg(F.collect_list(F.struct("x", "y", "v")).alias("p")).select(key, "ty", "tx", "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, size = b.column(3).flatten(), b.column(3).value_lengths().to_numpy(zero_copy_only=False)
            x, y, v = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            made = []
            for i, (z, n) in enumerate(zip(np.cumsum(size), size, strict=True)):
                top, left = b.column(1)[i].as_py() * side, b.column(2)[i].as_py() * side
                ys, xs = np.arange(top - halo, min(top + side, height) + halo), np.arange(left - halo, min(left + side, width) + halo)
                own = slice(z - n, z)
                at = (y[own] - ys[0], x[own] - xs[0])
                ok = (at[0] < len(ys)) & (at[1] < len(xs))
                at = (at[0][ok], at[1][ok])
                full, there = np.zeros((len(ys), len(xs))), np.zeros((len(ys), len(xs)), dtype=bool)
                full[at], there[at] = v[own][ok], True
                out = work(full, there, ys, xs)
                r, c = np.nonzero(there[halo : len(ys) - halo, halo : len(xs) - halo])
                made.append((np.full(len(r), i), c + left, r + top, out[r, c]))
            if made:
                whose, *rest = (np.concatenate(m) for m in zip(*made, strict=True))
                yield pa.record_batch([b.column(0).take(pa.array(whose)), *(pa.array(m) for m in rest)], [key, "x", "y", value])

    schema = T.StructType([pixels.schema[key], *T.StructType.fromDDL(f"x long, y long, `{value}` double").fields])
    out = tiles.mapInArrow(run, schema)
    return out.select(key, *[F.col(c).cast(pixels.schema[c].dataType).alias(c) for c in ("x", "y")], value)


def _edged(v: np.ndarray, ys: np.ndarray, xs: np.ndarray, height: int, width: int) -> np.ndarray:
    """Lines beyond the grid's edge as copies of the last ones on it."""
    return v[np.clip(ys, 0, height - 1) - ys[0]][:, np.clip(xs, 0, width - 1) - xs[0]]


def gaussian_blur(pixels: DataFrame, key: str, sigma: float, width: int, height: int, value: str = "gray") -> DataFrame:
    """(key, x, y, value) smoothed along columns and rows, edge values repeated; pixels outside the grid go."""
    kernel = np.array(gaussian_kernel(sigma))
    return _on_tiles(pixels, key, value, width, height, len(kernel) // 2, lambda v, there, ys, xs: _smooth(*(_edged(a, ys, xs, height, width) for a in (v, there)), kernel))


def _laplace(v: np.ndarray, ys: np.ndarray, xs: np.ndarray, height: int, width: int) -> np.ndarray:
    """4-neighbour Laplace with mirrored edges of all but the outermost lines."""
    mirror = lambda at, n: np.where(at < 0, -at - 1, np.where(at >= n, 2 * n - 1 - at, at))
    rows, cols = np.clip(mirror(ys, height) - ys[0], 0, len(ys) - 1), np.clip(mirror(xs, width) - xs[0], 0, len(xs) - 1)
    m = v[rows][:, cols]
    return 4 * m[1:-1, 1:-1] - m[:-2, 1:-1] - m[2:, 1:-1] - m[1:-1, :-2] - m[1:-1, 2:]


def laplace(pixels: DataFrame, key: str, width: int, height: int, value: str = "gray") -> DataFrame:
    """4-neighbour Laplace with mirrored edges."""
    return _on_tiles(pixels, key, value, width, height, 1, lambda v, there, ys, xs: _laplace(v, ys, xs, height, width))


def blur_scores(pixels: DataFrame, key: str, width: int, height: int, sigma: float = 2.0, pixel_t: float = 0.05, patch_t: float = 0.5) -> DataFrame:
    """Share of pixels with little smoothed edge strength, its mean, and whether the patch passes; edges and smoothing in one go."""
    kernel = np.array(gaussian_kernel(sigma))

    def work(v, there, ys, xs):
        edge = np.abs(_laplace(v, ys, xs, height, width))
        return _smooth(*(_edged(a, ys[1:-1], xs[1:-1], height, width) for a in (edge, there[1:-1, 1:-1])), kernel)

    soft = _on_tiles(pixels, key, "gray", width, height, len(kernel) // 2 + 1, work)
    blur = F.avg(F.when(F.col("gray") <= pixel_t, 1.0).otherwise(0.0))
    return soft.groupBy(key).agg(blur.alias("blur"), F.avg("gray").alias("sharp")).withColumn("passed", F.col("blur") <= patch_t)


def blur_tally(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("blur").alias("scored"), F.count_if("passed").alias("passed"), F.count_if(F.col("blur").isNull()).alias("open"))


def downsample(pixels: DataFrame, keys: list[str], factor: int, values: list[str]) -> DataFrame:
    """Averages over blocks of factor x factor pixels."""
    block = lambda c: F.floor(F.col(c) / factor).alias(c)
    return pixels.groupBy(*keys, block("x"), block("y")).agg(*[F.avg(v).alias(v) for v in values])


def largest_cluster(labels: DataFrame, keys: list[str], label: str = "label", strict: bool = False) -> DataFrame:
    """The cluster with most points, noise (-1) left out, the lowest label winning a tie.

    A group of noise only has a null label and 0 points; with ``strict`` it is
    an error.
    """
    named = F.when(F.col(label) >= 0, F.col(label))
    n = labels.groupBy(*keys, named.alias(label)).agg(F.count(named).alias("n"))
    pick = F.max_by(F.struct(label, "n"), F.struct("n", -F.col(label))).alias("_p")
    out = (n.groupBy(*keys) if keys else n.groupBy()).agg(pick).select(*keys, "_p.*").filter("n IS NOT NULL")
    if strict:
        out = out.withColumn("n", F.when(F.col("n") == 0, F.raise_error(F.lit("a group holds noise only")).cast("long")).otherwise(F.col("n")))
    return out


def cluster_centers(points: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    return points.groupBy(*keys).agg(*[F.avg(d).alias(d) for d in dims])


def _square(dims: list[str], prefix: str) -> Column:
    return sum(((F.col(d) - F.col(f"{prefix}{d}")) * (F.col(d) - F.col(f"{prefix}{d}")) for d in dims[1:]), (F.col(dims[0]) - F.col(f"{prefix}{dims[0]}")) * (F.col(dims[0]) - F.col(f"{prefix}{dims[0]}")))


def assign_nearest(points: DataFrame, centers: DataFrame, keys: list[str], dims: list[str], cluster: str = "cluster") -> DataFrame:
    """Each point with its nearest centre of the same group, the lowest cluster winning a tie.

    Centres of a group become one array, so points meet them by one equi-join.
    """
    packed = centers.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(cluster, *dims))).alias("_c"))
    dist = lambda c: sum(((F.col(d) - c[d]) * (F.col(d) - c[d]) for d in dims[1:]), (F.col(dims[0]) - c[dims[0]]) * (F.col(dims[0]) - c[dims[0]]))
    near = F.array_min(F.transform("_c", lambda c: F.struct(dist(c).alias("d"), c[cluster].alias(cluster))))
    return points.join(packed, keys).withColumn(cluster, near[cluster]).drop("_c")


def _first_centers(points: DataFrame, keys: list[str], dims: list[str], ks: list[int]) -> DataFrame:
    """(keys, k, cluster, dims): for each k, places spread evenly between the least and the largest value of every dimension."""
    span = points.groupBy(*keys).agg(*[f(d).alias(f"_{n}{d}") for d in dims for f, n in ((F.min, "lo"), (F.max, "hi"))])
    spread = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(j).alias("cluster"), F.lit((2 * j + 1) / (2 * k)).alias("at")) for k in ks for j in range(k)]))
    span = span.withColumn("_c", spread)
    return span.select(*keys, "_c.k", "_c.cluster", *[F.round(F.col(f"_lo{d}") + (F.col(f"_hi{d}") - F.col(f"_lo{d}")) * F.col("_c.at"), 9).alias(d) for d in dims])


def _distance(c: Column, dims: list[str]) -> Column:
    return sum(((F.col(d) - c[d]) * (F.col(d) - c[d]) for d in dims[1:]), (F.col(dims[0]) - c[dims[0]]) * (F.col(dims[0]) - c[dims[0]]))


def _nearest_of_each(points: DataFrame, centers: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    """``points`` with, for every k, the nearest centre as k and cluster; one pass whatever the number of ks."""
    packed = centers.groupBy(*keys, "k").agg(F.array_sort(F.collect_list(F.struct("cluster", *dims))).alias("c"))
    packed = packed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("_k"))
    nearest = lambda c: F.struct(_distance(c, dims).alias("d"), c["cluster"].alias("cluster"))
    best = F.transform("_k", lambda s: F.struct(s["k"].alias("k"), F.array_min(F.transform(s["c"], nearest))["cluster"].alias("cluster")))
    rest = [c for c in points.columns if c not in ("k", "cluster")]
    return points.join(packed, keys).select(*rest, F.explode(best).alias("_b")).select(*rest, "_b.k", "_b.cluster")


def lloyd(points: DataFrame, keys: list[str], dims: list[str], ks: list[int], rounds: int = 5) -> DataFrame:
    """(keys, k, cluster, dims): k-means centres of all groups and all ``ks`` at once.

    First centres come from one mergeable aggregate, so points are never
    sorted. A centre without a point stays where it is; centres are rounded to
    nine places, so that the order of sums does not show.
    """
    centers = cut(_first_centers(points, keys, dims, ks))
    at = [*keys, "k", "cluster"]
    for _ in range(rounds):
        new = cluster_centers(_nearest_of_each(points, centers, keys, dims), at, dims).select(*at, *[F.round(d, 9).alias(f"_{d}") for d in dims])
        centers = cut(centers.join(new, at, "left").select(*at, *[F.coalesce(f"_{d}", d).alias(d) for d in dims]))
    return centers


def kmeans_groups(points: DataFrame, keys: list[str], dims: list[str], k: int, rounds: int = 5) -> DataFrame:
    """(keys, cluster, dims): k-means centres of all groups at once, by ``lloyd``."""
    return lloyd(points, keys, dims, [k], rounds).drop("k")


def segment_background(pixels: DataFrame, slide: str, region: str, dims: list[str], k: int = 2, rounds: int = 5) -> DataFrame:
    """Foreground share of each region.

    The largest cluster of a slide's pixels is its background colour; in each
    region the cluster nearest to it is background, the rest foreground.
    """
    whole = kmeans_groups(pixels, [slide], dims, k, rounds)
    big = largest_cluster(assign_nearest(pixels, whole, [slide], dims), [slide], "cluster").drop("n")
    back = whole.join(big, [slide, "cluster"]).select(slide, *[F.col(d).alias(f"bg_{d}") for d in dims])
    own = kmeans_groups(pixels, [slide, region], dims, k, rounds)
    near = own.join(back, slide).groupBy(slide, region).agg(F.min_by("cluster", F.struct(_square(dims, "bg_"), F.col("cluster"))).alias("bg"))
    named = assign_nearest(pixels, own, [slide, region], dims).join(near, [slide, region])
    return named.groupBy(slide, region).agg(F.avg((F.col("cluster") != F.col("bg")).cast("double")).alias("fg_ratio"), F.count("*").alias("n_pixels"))


def silhouette(points: DataFrame, keys: list[str], dims: list[str], cluster: str = "cluster") -> DataFrame:
    """Mean squared-Euclidean silhouette of each group, from cluster sums only.

    The mean squared distance of a point to a cluster needs the cluster's
    count, sum and sum of squares, so no pair of points is formed.
    """
    norm = sum((F.col(d) * F.col(d) for d in dims[1:]), F.col(dims[0]) * F.col(dims[0]))
    stats = points.groupBy(*keys, cluster).agg(F.count("*").alias("n"), F.sum(norm).alias("q"), *[F.sum(d).alias(d) for d in dims])
    packed = stats.groupBy(*keys).agg(F.collect_list(F.struct(F.col(cluster).alias("k"), "n", "q", *dims)).alias("_s"))
    x = points.withColumn("_q", norm).join(packed, keys)
    dot = lambda s: sum((F.col(d) * s[d] for d in dims[1:]), F.col(dims[0]) * s[dims[0]])
    mean = F.transform("_s", lambda s: F.struct(s["k"].alias("k"), s["n"].alias("n"), (F.col("_q") * s["n"] + s["q"] - 2 * dot(s)).alias("t")))
    x = x.withColumn("_m", mean)
    own = F.filter("_m", lambda s: s["k"] == F.col(cluster))[0]
    b = F.array_min(F.transform(F.filter("_m", lambda s: s["k"] != F.col(cluster)), lambda s: s["t"] / s["n"]))
    a = own["t"] / (own["n"] - 1)
    s = F.when(own["n"] <= 1, 0.0).otherwise((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)))
    return x.select(*keys, F.coalesce(s, F.lit(0.0)).alias("s")).groupBy(*keys).agg(F.avg("s").alias("silhouette"))


def auto_k(points: DataFrame, keys: list[str], dims: list[str], ks: range = range(2, 6), rounds: int = 5) -> DataFrame:
    """The k with the best silhouette for each group, the least winning a tie; all ks share every pass over the points."""
    named = _nearest_of_each(points, lloyd(points, keys, dims, list(ks), rounds), keys, dims)
    scored = silhouette(named, [*keys, "k"], dims)
    return scored.groupBy(*keys).agg(F.max_by("k", F.struct(F.round("silhouette", 9), -F.col("k"))).alias("k"))


#: Steps to the cells that may hold a point within the diagonal of a cell.
_ROUND = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if abs(a * b) < 4]
#: Parts of a cell's side for which one point each stands first when cells are held against each other.
_PARTS = 16


def _beside(df: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """Each row once for every step, with the cell that the step leads to as bx, by and its own as ax, ay."""
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps]))
    rest = [c for c in df.columns if c not in ("bx", "by")]
    return df.withColumn("_o", step).select(*rest, F.col("bx").alias("ax"), F.col("by").alias("ay"), (F.col("bx") + F.col("_o.a")).alias("bx"), (F.col("by") + F.col("_o.b")).alias("by"))


def _within(eps: float) -> Column:
    return (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2")) <= eps * eps


def _linked_cells(core: DataFrame, keys: list[str], eps: float, side: float) -> DataFrame:
    """(keys, ax, ay, bx, by): pairs of cells with core points within eps of each other.

    First one point for each part of a cell is held against those of the cell
    beside it. Pairs that this leaves open look at all points, but only of
    parts that lie near enough.
    """
    pair = [*keys, "ax", "ay", "bx", "by"]
    fine = side / _PARTS
    parts = core.withColumns({"px": F.floor(F.col("x") / fine), "py": F.floor(F.col("y") / fine)})
    one = parts.groupBy(*keys, "bx", "by", "px", "py").agg(F.min(F.struct("i", "x", "y")).alias("p")).select(*keys, "bx", "by", "px", "py", "p.x", "p.y")
    second = lambda df: df.withColumnsRenamed({"px": "px2", "py": "py2", "x": "x2", "y": "y2"})
    gap = lambda c: F.greatest(F.lit(0), F.abs(F.col(f"p{c}") - F.col(f"p{c}2")) - 1) * fine
    forward = [o for o in _ROUND if o > (0, 0)]
    may = _beside(one, forward).join(second(one), [*keys, "bx", "by"]).filter(gap("x") * gap("x") + gap("y") * gap("y") <= eps * eps * (1 + 1e-9))
    may = cut(may.withColumn("close", _within(eps)).select(*pair, "px", "py", "px2", "py2", "close"))
    linked = may.groupBy(*pair).agg(F.bool_or("close").alias("close"))
    unsure = may.join(linked.filter("NOT close"), pair, "left_semi").drop("close")
    left = parts.select(*keys, F.col("bx").alias("ax"), F.col("by").alias("ay"), "px", "py", "x", "y")
    right = second(parts.select(*keys, "bx", "by", "px", "py", "x", "y"))
    late = unsure.join(left, [*keys, "ax", "ay", "px", "py"]).join(right, [*keys, "bx", "by", "px2", "py2"]).filter(_within(eps)).select(*pair)
    return linked.filter("close").select(*pair).unionByName(late).distinct()


def density_clusters(points: DataFrame, keys: list[str], ident: str, eps: float, min_pts: int, min_size: int) -> DataFrame:
    """Clusters of core points within eps of each other, with the points they reach; the rest is noise (-1).

    Points lie in cells whose diagonal is eps, so all points of a cell are
    within eps of each other: a cell of ``min_pts`` points or more holds core
    points only, by a count, and the core points of any cell are one cluster.
    Only points of sparser cells are held against the points of cells round
    them; cells are linked by one pair of core points. A point of a cluster
    below ``min_size`` is noise too; a border point joins its least core
    neighbour. A cluster has the least id of its core points.
    """
    side = eps / math.sqrt(2) * (1 - 1e-12)
    cell = [*keys, "bx", "by"]
    p = points.select(*keys, F.col(ident).cast("long").alias("i"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    p = p.withColumns({"bx": F.floor(F.col("x") / side), "by": F.floor(F.col("y") / side)})
    p = cut(p.join(p.groupBy(*cell).agg((F.count("*") >= min_pts).alias("sure")), cell))
    # fewer than min_pts points of a sparse cell meet those round them
    other = p.select(*cell, F.col("i").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    met = cut(_beside(p.filter("NOT sure").drop("sure"), _ROUND).join(other, cell).filter(_within(eps)).select(*keys, "i", "j"))
    sparse_core = met.groupBy(*keys, "i").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pts)
    core = cut(p.filter("sure").unionByName(p.filter("NOT sure").join(sparse_core, [*keys, "i"], "left_semi").select(*p.columns)).drop("sure"))
    first = cut(core.groupBy(*cell).agg(F.min("i").alias("first")))
    a = first.select(*keys, F.col("bx").alias("ax"), F.col("by").alias("ay"), F.col("first").alias("a"))
    edges = _linked_cells(core, keys, eps, side).join(a, [*keys, "ax", "ay"]).join(first.withColumnRenamed("first", "b"), cell).select(*keys, "a", "b")
    root = components(edges, keys).select(*keys, F.col("node").alias("first"), "root")
    rooted = first.join(root, [*keys, "first"], "left").select(*cell, F.coalesce("root", "first").alias("cluster"))
    own = core.join(rooted, cell).select(*keys, "i", "cluster")
    border = met.join(core.select(*keys, "i"), [*keys, "i"], "left_anti").join(own.withColumnRenamed("i", "j"), [*keys, "j"])
    named = own.unionByName(border.groupBy(*keys, "i").agg(F.min_by("cluster", "j").alias("cluster")))
    big = named.groupBy(*keys, "cluster").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size)
    named = named.join(big, [*keys, "cluster"], "left_semi")
    return p.select(*keys, "i").join(named, [*keys, "i"], "left").select(*keys, F.col("i").alias(ident), F.coalesce("cluster", F.lit(-1)).alias("cluster"))
