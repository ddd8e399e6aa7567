"""Spatial joins and the merging of overlapping boxes.

Spark plans a plain overlap predicate as a cross product. ``range_join`` sorts
boxes into size classes, each with square bins of its own size, joins on (keys,
class, bin) and keeps a pair in the one bin that holds the larger of both low
corners. Merging runs inside a task for a slide of at most ``LOCAL`` boxes; of
larger slides pieces are merged first, and what is left goes through a fixpoint
of joins in which only hulls that have changed look for partners.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.fixpoint import cut
from .geometry import BOX

#: Boxes that one task merges at once.
LOCAL = 4096
#: Groups of at most so many boxes are merged side by side, as rows of padded arrays of about so many numbers.
SMALL, NUMBERS = 512, 1 << 15
#: Bins of a size class have sides of this to the power of the class.
STEP = 4


def has_area() -> Column:
    return F.coalesce((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), F.lit(False))


def _size_class(p: str = "") -> Column:
    """The least class whose bins are as wide and high as a box."""
    side = F.greatest(F.col(f"{p}x2") - F.col(f"{p}x1"), F.col(f"{p}y2") - F.col(f"{p}y1"))
    return F.when(side > 1, F.ceil(F.log(float(STEP), side))).otherwise(0).cast("int")


def _in_bins(df: DataFrame, classes: Column, p: str = "") -> DataFrame:
    """Each box in the bins that it touches, of each of ``classes``, as _k, _bx, _by; four of a class at most."""
    side = F.pow(F.lit(float(STEP)), F.col("_k"))
    low, high = (lambda c: F.floor(F.col(f"{p}{c}1") / side)), (lambda c: F.floor(F.col(f"{p}{c}2") / side))
    out = df.withColumn("_k", F.explode(classes))
    return out.withColumn("_bx", F.explode(F.sequence(low("x"), high("x")))).withColumn("_by", F.explode(F.sequence(low("y"), high("y"))))


def _meetings(left: DataFrame, right: DataFrame, keys: list[str], classes: list[int], which: Callable[[Column, Column], Column]) -> DataFrame:
    """Overlapping pairs of a left box and a right one of its class or a lower one, each once."""
    have = F.array(*map(F.lit, classes))
    a = _in_bins(left.withColumn("_kl", _size_class()), F.array("_kl"))
    b = _in_bins(right.withColumn("_kr", _size_class("r_")), F.filter(have, lambda k: k >= F.col("_kr")), "r_")
    met = a.join(b, [*keys, "_k", "_bx", "_by"]).filter(which(F.col("_kl"), F.col("_kr")))
    met = met.filter("least(x2, r_x2) > greatest(x1, r_x1) AND least(y2, r_y2) > greatest(y1, r_y1)")
    side = F.pow(F.lit(float(STEP)), F.col("_k"))
    once = (F.col("_bx") == F.floor(F.greatest("x1", "r_x1") / side)) & (F.col("_by") == F.floor(F.greatest("y1", "r_y1") / side))
    return met.filter(once).drop("_k", "_bx", "_by", "_kl", "_kr")


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"r_{c}") for c in df.columns if c not in keys])


def size_classes(*sides: DataFrame) -> list[int]:
    """The size classes that occur, of which there are no more than digits in the longest side."""
    return sorted({r[0] for df in sides for r in df.filter(has_area()).select(_size_class()).distinct().collect()})


def range_join(left: DataFrame, right: DataFrame, keys: list[str], classes: list[int] | None = None) -> DataFrame:
    """Pairs of boxes that overlap with area; the right side's columns are prefixed ``r_``.

    A pair meets in bins of the larger box's class, so neither many small boxes
    nor one that covers them all fill more than the bins that they touch.
    """
    left, right = left.filter(has_area()), right.filter(has_area())
    classes = size_classes(left, right) if classes is None else classes
    large_left = _meetings(left, _renamed(right, keys), keys, classes, lambda a, b: a >= b)
    if len(classes) < 2:
        return large_left
    # the other way round: the right box is of the higher class
    turned = _meetings(right, _renamed(left, keys), keys, classes, lambda a, b: a > b)
    names = [c for c in left.columns if c not in keys], [c for c in right.columns if c not in keys]
    back = turned.select(*keys, *[F.col(f"r_{c}").alias(c) for c in names[0]], *[F.col(c).alias(f"r_{c}") for c in names[1]])
    return large_left.unionByName(back)


def overlap_pairs(boxes: DataFrame, min_ratio: float = 0.0, key: str = "slide", ident: str = "idx", classes: list[int] | None = None) -> DataFrame:
    """(key, a, b, score): pairs of one slide with overlap / smaller area above 0 and at least ``min_ratio``."""
    solid = boxes.filter(has_area()).select(key, ident, *BOX)
    classes = size_classes(solid) if classes is None else classes
    pairs = _meetings(solid, _renamed(solid, [key]), [key], classes, lambda a, b: (a > b) | (F.col(ident) < F.col(f"r_{ident}")))
    pairs = pairs.filter(F.col(ident) != F.col(f"r_{ident}"))
    w = F.least("x2", "r_x2") - F.greatest("x1", "r_x1")
    h = F.least("y2", "r_y2") - F.greatest("y1", "r_y1")
    area = F.least((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")), (F.col("r_x2") - F.col("r_x1")) * (F.col("r_y2") - F.col("r_y1")))
    out = pairs.select(key, F.least(ident, f"r_{ident}").alias("a"), F.greatest(ident, f"r_{ident}").alias("b"), F.try_divide(w * h, area).alias("score"))
    return out.filter(F.col("score") >= min_ratio)


def disjoint_hulls(low: np.ndarray, high: np.ndarray, ident: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hulls, no two of which overlap, of boxes that overlap directly or through others.

    Boxes are added one by one to hulls that are disjoint already: what a box
    meets is joined with it, and the larger hull is held against the others
    again. The least ident of its boxes names a hull.
    """
    n, out_low, out_high, name = 0, np.empty_like(low), np.empty_like(high), ident.copy()
    for i in range(len(low)):
        a, b, least = low[i], high[i], ident[i]
        while n:
            met = ((out_low[:n] < b) & (out_high[:n] > a)).all(axis=1)
            if not met.any():
                break
            a, b = np.minimum(a, out_low[:n][met].min(axis=0)), np.maximum(b, out_high[:n][met].max(axis=0))
            least = min(least, name[:n][met].min())
            left = n - int(met.sum())
            for part in (out_low, out_high, name):
                part[:left] = part[:n][~met]
            n = left
        out_low[n], out_high[n], name[n] = a, b, least
        n += 1
    return out_low[:n], out_high[:n], name[:n]


def _by_group(df: DataFrame, by: list[str], key: str, order: list[str], fields: list[str], merge: Callable[..., tuple[np.ndarray, ...]], many: Callable[..., tuple[np.ndarray, ...]]) -> DataFrame:
    """(key, fields): what ``merge`` makes of the arrays of ``fields`` of each group, its rows sorted by ``order`` and then by ``fields``.

    Groups travel as one list each and many to a batch, so that a small group
    costs no call of its own: groups of about the same size are given together
    to ``many``, as padded arrays of one row a group and the sizes, if their
    numbers allow it; it gives the row of each result, and its fields.
    """
    kinds = [df.schema[c].dataType for c in fields]
    wide = [F.col(c).cast("long" if isinstance(t, T.IntegralType) else "double" if isinstance(t, T.NumericType) else t).alias(f"_{c}") for c, t in zip(fields, kinds, strict=True)]
    lists = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, *wide))).alias("_rows")).select(key, "_rows")
    names = [key, *fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = b.column(1).flatten(), b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            columns, ends = [rows.field(f"_{c}").to_numpy(zero_copy_only=False) for c in fields], np.cumsum(size)
            alike = np.argsort(size, kind="stable")
            few = int((size <= SMALL).sum()) if _side_by_side(columns) else 0
            made, at = [], 0
            while at < few:
                which = alike[at : min(few, at + max(1, NUMBERS // int(size[alike[at]])))]
                place = (ends - size)[which][:, None] + np.arange(size[which].max())
                inside = place < ends[which][:, None]
                who, *out = many(*[c[np.where(inside, place, 0)] for c in columns], inside)
                made.append((which[who], *out))
                at += len(which)
            for i in alike[few:]:
                out = merge(*[c[ends[i] - size[i] : ends[i]] for c in columns])
                made.append((np.full(len(out[0]), i), *out))
            if made:
                who, *out = map(np.concatenate, zip(*made, strict=True))
                yield pa.record_batch([b.column(0).take(pa.array(who)), *map(pa.array, out)], names)

    schema = T.StructType([df.schema[key], *[T.StructField(c, w) for c, w in zip(fields, [f.dataType for f in df.select(*wide).schema], strict=True)]])
    return lists.mapInArrow(run, schema).select(key, *[F.col(c).cast(t).alias(c) for c, t in zip(fields, kinds, strict=True)])


def _side_by_side(columns: list[np.ndarray]) -> bool:
    """Whether arrays of numbers give what plain numbers would: finite, and integers with exact areas as doubles."""
    corners = columns[:4]
    if any(c.dtype.kind not in "if" for c in columns) or any(not np.isfinite(c).all() for c in corners):
        return False
    return all(c.dtype.kind == "f" or not len(c) or (c.min() > -(1 << 25) and c.max() < 1 << 25) for c in corners)


def hulls_side_by_side(x1, y1, x2, y2, ident, inside):
    """Row and fields of the hulls of ``disjoint_hulls`` for many groups: rows of boxes, of which those ``inside`` count.

    In each round a hull goes to the first hull of its row that it meets.
    """
    low, high = np.stack((x1, y1)), np.stack((x2, y2))
    group, done = np.arange(len(ident)), []
    while len(group):
        n = ident.shape[1]
        meet = inside[:, :, None] & inside[:, None, :]
        for a, b in zip(low, high, strict=True):
            ahead = a[:, :, None] < b[:, None, :]
            meet &= ahead & ahead.swapaxes(1, 2)
        to = np.where(inside, meet.argmax(axis=2), np.arange(n)) + n * np.arange(len(group))[:, None]
        settled = (to == np.arange(to.size).reshape(to.shape)).all(axis=1)
        if settled.any():
            row, at = np.nonzero(inside & settled[:, None])
            done.append((group[row], *(v[row, at] for v in (*low, *high, ident))))
            still = ~settled
            group, inside, ident, low, high = group[still], inside[still], ident[still], low[:, still], high[:, still]
            to = to[still]
            if not len(group):
                break
            to = to % n + n * np.arange(len(group))[:, None]
        to = to.ravel()
        while (to[to] != to).any():
            to = to[to]
        low, high, ident = low.copy(), high.copy(), ident.copy()
        some = np.flatnonzero(inside.ravel() & (to != np.arange(to.size)))
        for flat, least in ((low[0], np.minimum), (low[1], np.minimum), (high[0], np.maximum), (high[1], np.maximum), (ident, np.minimum)):
            # rows of a plane are contiguous, so that this writes into it
            least.at(flat.reshape(-1), to[some], flat.reshape(-1)[some])
        inside = inside & (to == np.arange(to.size)).reshape(inside.shape)
        first = np.argsort(~inside, axis=1, kind="stable")[:, : inside.sum(axis=1).max()]
        take = lambda v: np.take_along_axis(v, first, axis=1)  # noqa: B023, E731
        inside, ident, low, high = take(inside), take(ident), np.stack([*map(take, low)]), np.stack([*map(take, high)])
    return tuple(map(np.concatenate, zip(*done, strict=True)))


def _hulls_of(x1, y1, x2, y2, ident):
    low, high, name = disjoint_hulls(np.stack((x1, y1), axis=1), np.stack((x2, y2), axis=1), ident)
    return low[:, 0], low[:, 1], high[:, 0], high[:, 1], name


def _large(boxes: DataFrame, key: str, local: int) -> DataFrame:
    """(key, _nx, _low1.., _side1..): keys with more than ``local`` boxes, and a raster that gives each about a quarter of that."""
    n = boxes.groupBy(key).agg(F.count("*").alias("_n"), *[f(c).alias(f"_{g}{c}") for c in ("x1", "y1") for f, g in ((F.min, "low"), (F.max, "high"))])
    nx = F.ceil(F.sqrt(4 * F.col("_n") / local))
    side = lambda c: ((F.col(f"_high{c}") - F.col(f"_low{c}")) / nx + 1e-9).cast("double").alias(f"_side{c}")
    return n.filter(F.col("_n") > local).select(key, "_lowx1", "_lowy1", side("x1"), side("y1"))


def _merge_pieces(boxes: DataFrame, large: DataFrame, key: str, ident: str, local: int) -> DataFrame:
    """Boxes of large keys merged within pieces: a cell of the key's raster, and a share of it where it holds more than ``local``."""
    place = lambda c: F.floor((F.col(c) - F.col(f"_low{c}")) / F.col(f"_side{c}"))
    at = [key, "_px", "_py"]
    cells = boxes.join(large, key).select(*boxes.columns, place("x1").alias("_px"), place("y1").alias("_py"))
    shares = cells.groupBy(*at).agg(F.ceil(F.count("*") / local).cast("int").alias("_shares"))
    dealt = cells.join(shares, at).withColumn("_share", F.pmod(F.xxhash64(*BOX, ident), F.col("_shares")))
    return _by_group(dealt, [*at, "_share"], key, [], [*BOX, ident], _hulls_of, hulls_side_by_side)


def _changed_rounds(hulls: DataFrame, key: str, ident: str, rounds: int) -> DataFrame:
    """Hulls that overlap become one until none do; each round only hulls that the last one made look for partners.

    A hull is known by its corners: two with equal corners are one.
    """
    corners = F.struct(*BOX)
    least = lambda df: df.groupBy(key, *BOX).agg(F.min(ident).alias(ident), F.max("_new").alias("_new"))
    now = cut(least(hulls.withColumn("_new", F.lit(True))))
    for _ in range(rounds):
        met = range_join(now.filter("_new"), now, [key]).select(key, corners.alias("a"), F.struct(*[F.col(f"r_{c}").alias(c) for c in BOX]).alias("b")).filter("a <> b")
        to = met.unionByName(met.select(key, F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(key, "a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        to = cut(to)
        if to.isEmpty():
            return now.drop("_new")
        # a hull goes to the least that it meets, and on to the one which that goes to
        on = to.select(key, F.col("a").alias("to"), F.col("to").alias("on"))
        to = to.join(on, [key, "to"], "left").select(key, "a", F.coalesce("on", "to").alias("to"))
        moved = now.withColumn("a", corners).join(to, [key, "a"], "left").withColumn("to", F.coalesce("to", "a"))
        joined = moved.groupBy(key, "to").agg(*[(F.min if c[1] == "1" else F.max)(c).alias(c) for c in BOX], F.min(ident).alias(ident), (F.count("*") > 1).alias("_new"))
        now = cut(least(joined.drop("to")))
    raise RuntimeError(f"boxes did not settle in {rounds} rounds")


def _sides(boxes: DataFrame, key: str, ident: str) -> tuple[DataFrame, DataFrame]:
    """Boxes that can overlap others, and those that cannot: without area, corners, key or ident."""
    can = has_area() & F.col(key).isNotNull() & F.col(ident).isNotNull()
    return boxes.filter(can), boxes.filter(~can)


def merge_boxes_any(boxes: DataFrame, key: str = "slide", ident: str = "idx", rounds: int = 50, local: int = LOCAL) -> DataFrame:
    """(key, ident, x1..y2): hulls of boxes that overlap directly or through others, until no two hulls overlap.

    A hull has the least ident of its boxes; the result does not depend on
    order or partitions. Boxes without area, corners, key or ident stay as they
    are. A key of at most ``local`` boxes is settled in one task.
    """
    names = [key, ident, *BOX]
    solid, alone = _sides(boxes.select(*names), key, ident)
    whole = lambda df: _by_group(df, [key], key, [], [*BOX, ident], _hulls_of, hulls_side_by_side)
    large = cut(_large(solid, key, local))
    if large.isEmpty():
        return whole(solid).select(*names).unionByName(alone)
    done = whole(solid.join(large, key, "left_anti"))
    left = cut(_merge_pieces(solid, large, key, ident, local))
    still = cut(_large(left, key, local))
    done = done.unionByName(whole(left.join(still, key, "left_anti")))
    left = left.join(still, key, "left_semi")
    if not still.isEmpty():
        done = done.unionByName(_changed_rounds(left, key, ident, rounds).select(*done.columns))
    return done.select(*names).unionByName(alone)


class _Places:
    """Boxes by size class and bin, so that a rectangle finds what lies near it."""

    def __init__(self, boxes: list[tuple]):
        self.bins: dict[int, dict[tuple[int, int], list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, (x1, y1, x2, y2) in enumerate(boxes):
            if x2 > x1 and y2 > y1:
                k = max(0, math.ceil(math.log(max(x2 - x1, y2 - y1), STEP)))
                for at in self.covered((x1, y1, x2, y2), STEP**k):
                    self.bins[k][at].append(i)

    @staticmethod
    def covered(box: tuple, side: int) -> Iterator[tuple[int, int]]:
        a, b, c, d = (math.floor(v / side) for v in box)
        return ((x, y) for x in range(a, c + 1) for y in range(b, d + 1))

    def near(self, box: tuple, old: tuple | None = None) -> Iterator[int]:
        """Boxes of the bins that ``box`` touches and ``old``, which lies in it, does not."""
        for k, bins in self.bins.items():
            a, b, c, d = (math.floor(v / STEP**k) for v in box)
            p, q, r, s = (math.floor(v / STEP**k) for v in old) if old else (c + 1, d + 1, c, d)
            if (c - a + 1) * (d - b + 1) - (r - p + 1) * (s - q + 1) > len(bins):
                found = [at for at in bins if a <= at[0] <= c and b <= at[1] <= d and not (p <= at[0] <= r and q <= at[1] <= s)]
            else:
                found = [(x, y) for x in (*range(a, p), *range(r + 1, c + 1)) for y in range(b, d + 1) if (x, y) in bins]
                found += [(x, y) for y in (*range(b, q), *range(s + 1, d + 1)) for x in range(p, r + 1) if (x, y) in bins]
            for at in found:
                yield from bins[at]


def _share(p: tuple, q: tuple) -> float:
    """Overlap of two boxes as a share of the smaller of both areas."""
    w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
    area = min((p[2] - p[0]) * (p[3] - p[1]), (q[2] - q[0]) * (q[3] - q[1]))
    return w * h / area if w > 0 and h > 0 and area > 0 else 0.0


def _one_turn(boxes: list[tuple], threshold: float) -> list[tuple]:
    """One turn of ``merge_in_order``; boxes near a hull are events, taken in their order."""
    places, free, out = _Places(boxes), [True] * len(boxes), []
    for i, hull in enumerate(boxes):
        if not free[i]:
            continue
        queued = {j for j in places.near(hull) if j > i and free[j]}
        events = sorted(queued)
        while events:
            j = heapq.heappop(events)
            share = _share(hull, boxes[j])
            if share > 0 and share >= threshold:
                free[j] = False
                p, q = hull, boxes[j]
                hull = (min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3]))
                for m in places.near(hull, p):  # what the smaller hull passed over stays out in this turn
                    if m > j and free[m] and m not in queued:
                        queued.add(m)
                        heapq.heappush(events, m)
        out.append(hull)
    return out


def merge_in_order(boxes: list[tuple], threshold: float) -> list[tuple]:
    """Hulls of boxes in their order: each takes in later boxes that it overlaps enough, until a turn changes nothing."""
    while True:
        turned = _one_turn(boxes, threshold)
        if len(turned) == len(boxes):
            return boxes
        boxes = turned


def merge_side_by_side(x1, y1, x2, y2, inside, threshold: float):
    """Row and corners of the hulls of ``merge_in_order`` for many groups: rows of boxes in their order, of which those ``inside``, from the left, count.

    A turn is a fold: each box goes into the first hull of its row that it
    overlaps enough, or opens one.
    """
    kinds, boxes = [v.dtype for v in (x1, y1, x2, y2)], np.stack((x1, y1, x2, y2)).astype(np.float64)
    size, group, done = inside.sum(axis=1), np.arange(len(inside)), []
    while len(group):
        hulls, area, count = np.zeros_like(boxes), np.zeros(boxes.shape[1:]), np.zeros(len(group), dtype=np.int64)
        for t in range(boxes.shape[2]):
            box, most = boxes[:, :, t], int(count.max())
            own = (box[2] - box[0]) * (box[3] - box[1])
            h = hulls[:, :, :most]
            wide = np.minimum(h[2], box[2][:, None]) - np.maximum(h[0], box[0][:, None])
            high = np.minimum(h[3], box[3][:, None]) - np.maximum(h[1], box[1][:, None])
            # places without a hull are empty boxes of area 0
            whole = np.minimum(area[:, :most], own[:, None])
            share = np.divide(wide * high, whole, out=np.zeros_like(wide), where=(wide > 0) & (high > 0) & (whole > 0))
            enough = (share > 0) & (share >= threshold)
            first = enough.argmax(axis=1) if most else count
            here = np.arange(len(group))
            taken = enough[here, first] if most else np.zeros(len(group), dtype=bool)
            there = t < size
            g, k = here[taken & there], first[taken & there]
            for c, join in ((0, np.minimum), (1, np.minimum), (2, np.maximum), (3, np.maximum)):
                hulls[c, g, k] = join(hulls[c, g, k], box[c, g])
            area[g, k] = (hulls[2, g, k] - hulls[0, g, k]) * (hulls[3, g, k] - hulls[1, g, k])
            g = here[~taken & there]
            hulls[:, g, count[g]] = box[:, g]
            area[g, count[g]] = own[g]
            count[g] += 1
        settled = count == size
        row, at = np.nonzero((np.arange(boxes.shape[2]) < count[:, None]) & settled[:, None])
        done.append((group[row], *(v[row, at] for v in hulls)))
        group, size = group[~settled], count[~settled]
        boxes = hulls[:, ~settled, : int(size.max(initial=0))]
    who, *out = map(np.concatenate, zip(*done, strict=True))
    return who, *(v.astype(k) for v, k in zip(out, kinds, strict=True))


def merge_boxes(boxes: DataFrame, threshold: float = 0.2, key: str = "slide", order: tuple[str, ...] = ("rot", "idx"), ident: str = "idx", rounds: int = 50, local: int = LOCAL) -> DataFrame:
    """(key, x1..y2): hulls by the threshold rule, in pinned order.

    The rule is bound to the order of the boxes. It never joins boxes of
    different any-overlap hulls, so a key of more than ``local`` boxes is dealt
    out by these hulls; one hull's boxes are merged in one task, each turn
    looking only at boxes in bins that a hull touches. Boxes without area,
    corners, key or ident stay as they are.
    """
    solid, alone = _sides(boxes, key, ident)

    def run(x1, y1, x2, y2):
        rows = merge_in_order(list(zip(x1.tolist(), y1.tolist(), x2.tolist(), y2.tolist(), strict=True)), threshold)
        return tuple(np.array(c, dtype=v.dtype) for c, v in zip(zip(*rows, strict=True), (x1, y1, x2, y2), strict=True))

    many = lambda *rows: merge_side_by_side(*rows, threshold)
    merge = lambda df, by: _by_group(df, by, key, [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], list(BOX), run, many)
    large = cut(_large(solid, key, local))
    if large.isEmpty():
        return merge(solid, [key]).unionByName(alone.select(key, *BOX))
    crowded = solid.join(large.select(key), key, "left_semi")
    hulls = cut(merge_boxes_any(crowded, key, ident, rounds, local).select(key, *BOX))
    # a box lies in one hull as a whole, and hulls do not overlap
    within = range_join(crowded, hulls, [key])
    return merge(solid.join(large.select(key), key, "left_anti"), [key]).unionByName(merge(within, [key, *[f"r_{c}" for c in BOX]])).unionByName(alone.select(key, *BOX))


def crop_pixels(pixels: DataFrame, boxes: DataFrame, key: str = "img", ident: str = "box", classes: list[int] | None = None) -> DataFrame:
    """Pixels inside each half-open box, with coordinates from the box corner.

    A box lies in four bins of its size class at most, whatever its size; a
    pixel lies in one bin of each class that occurs.
    """
    solid = boxes.filter(has_area())
    classes = size_classes(solid) if classes is None else classes
    binned = _in_bins(solid.select(key, F.col(ident).alias("_box"), *BOX).withColumn("_kl", _size_class()), F.array("_kl"))
    side = F.pow(F.lit(float(STEP)), F.col("_k"))
    cells = pixels.withColumn("_k", F.explode(F.array(*map(F.lit, classes)).cast("array<int>")))
    cells = cells.withColumns({"_bx": F.floor(F.col("x") / side), "_by": F.floor(F.col("y") / side)})
    met = cells.join(binned, [key, "_k", "_bx", "_by"]).filter("x >= x1 AND x < x2 AND y >= y1 AND y < y2")
    rest = [c for c in pixels.columns if c not in (key, "x", "y")]
    return met.select(key, F.col("_box").alias(ident), (F.col("x") - F.col("x1")).alias("x"), (F.col("y") - F.col("y1")).alias("y"), *rest)


def prefix_columns(mask: DataFrame, keys: list[str], rows: int, cols: int) -> DataFrame:
    """(keys, c, sums): for each column border c of 1..cols, the set cells left of it and above row border 0..rows.

    The summed-area table of a mask, by two prefix passes: counts along each
    row that has a cell, then along each column over those rows.
    """
    inside = (F.col("r") >= 0) & (F.col("r") < rows) & (F.col("c") >= 0) & (F.col("c") < cols)
    lines = mask.filter(inside).groupBy(*keys, F.col("r").cast("int").alias("r")).agg(F.sort_array(F.collect_set(F.col("c").cast("int"))).alias("_c"))
    # the count after a cell holds up to the next one
    left = f"flatten(concat(array(array_repeat(0, _c[0])), transform(_c, (x, i) -> array_repeat(i + 1, coalesce(get(_c, i + 1), {cols}) - x))))"
    spread = lines.select(*keys, "r", F.posexplode(F.expr(left)).alias("c", "_n"))
    above = Window.partitionBy(*keys, "c").orderBy("r")
    run = spread.withColumn("_sum", F.sum("_n").over(above)).groupBy(*keys, "c").agg(F.sort_array(F.collect_list(F.struct("r", "_sum"))).alias("_s"))
    down = f"flatten(concat(array(array_repeat(0L, _s[0].r + 1)), transform(_s, (x, i) -> array_repeat(x._sum, coalesce(get(_s, i + 1).r, {rows}) - x.r))))"
    return run.select(*keys, (F.col("c") + 1).alias("c"), F.expr(down).alias("sums"))


def foreground_ratio(patches: DataFrame, mask: DataFrame, scale: float, keys: list[str], rows: int, cols: int) -> DataFrame:
    """Share of set mask cells under each patch (px1..py2); low edges truncate, high edges go up, all clamped.

    ``mask`` holds the set cells (keys, r, c); cells without a row are 0. A
    patch is counted by its four corners in the summed-area table: two rows
    whatever its area, each with two look-ups.
    """
    low = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n), (F.col(c) * scale).cast("long")))
    high = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n), F.ceil(F.col(c) * scale)))
    p = patches.withColumns({"_r1": low("py1", rows), "_r2": high("py2", rows), "_c1": low("px1", cols), "_c2": high("px2", cols)})
    area = ["_r1", "_r2", "_c1", "_c2"]
    cells = (F.col("_r2") - F.col("_r1")) * (F.col("_c2") - F.col("_c1"))
    # equal areas are looked up once, whatever the patches are called
    sides = F.array(F.struct(F.col("_c1").alias("c"), F.lit(-1).alias("sign")), F.struct(F.col("_c2").alias("c"), F.lit(1).alias("sign")))
    corners = p.filter("_r2 > _r1 AND _c2 > _c1").select(*keys, *area).distinct().withColumn("_side", F.explode(sides))
    corners = corners.select(*keys, *area, F.col("_side.c").cast("int").alias("c"), "_side.sign").filter("c > 0")
    seen = corners.join(prefix_columns(mask, keys, rows, cols), [*keys, "c"])
    count = F.sum(F.col("sign") * (F.get("sums", F.col("_r2").cast("int")) - F.get("sums", F.col("_r1").cast("int"))))
    out = p.join(seen.groupBy(*keys, *area).agg(count.alias("_hit")), [*keys, *area], "left")
    ratio = F.when((F.col("_r2") > F.col("_r1")) & (F.col("_c2") > F.col("_c1")), F.coalesce("_hit", F.lit(0)) / cells).otherwise(F.lit(0.0))
    return out.select(*patches.columns, ratio.alias("fg_ratio"))
