"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, tables: Scratch, rounds: int = 40) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b: long) with the least node it reaches.

    Each round links every node's larger neighbours, then its smaller ones, to
    the least of them; the number of rounds grows with the logarithm of the
    longest path. Per-node work is a minimum and an equi-join, so no node's
    neighbours are ever held together.
    """
    now = edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).filter("a <> b").distinct()
    now = tables.put(now, "stars")
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = tables.put(small.filter("a <> b").distinct(), "stars")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
