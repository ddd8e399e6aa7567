"""Iterative plans that cut their lineage in the folder all executors share."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of its own only in local mode where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return base or tempfile.mkdtemp(prefix="slidegrid-")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df``."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint(eager=True)
    gc.collect()
    return out


def components(edges: DataFrame, keys: list[str], a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(keys, node, root): least node that each node of ``edges`` reaches within its key.

    Each round takes the least root among the neighbours of a root's members
    and then jumps to that root's own root, so long chains halve.
    """
    both = edges.select(*keys, F.col(a).alias("x"), F.col(b).alias("y"))
    both = cut(both.unionByName(both.select(*keys, F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    label = cut(both.groupBy(*keys, F.col("x").alias("node")).agg(F.least(F.col("x"), F.min("y")).alias("root")))
    for _ in range(rounds):
        # the least root seen from any member of a tree moves the tree's root
        seen = both.join(label.select(*keys, F.col("node").alias("y"), F.col("root").alias("ry")), [*keys, "y"])
        seen = seen.groupBy(*keys, F.col("x").alias("node")).agg(F.min("ry").alias("near"))
        near = label.join(seen, [*keys, "node"]).withColumn("near", F.least("near", "root"))
        hook = near.groupBy(*keys, F.col("root")).agg(F.min("near").alias("to"))
        moved = near.join(hook, [*keys, "root"]).select(*keys, "node", "root", F.least("near", "to").alias("new"))
        jump = moved.select(*keys, F.col("node").alias("new"), F.col("new").alias("far"))
        moved = cut(moved.join(jump, [*keys, "new"], "left").select(*keys, "node", "root", F.least("new", F.coalesce("far", "new")).alias("new")))
        label = moved.select(*keys, "node", F.col("new").alias("root"))
        if moved.filter("new <> root").isEmpty():
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")
