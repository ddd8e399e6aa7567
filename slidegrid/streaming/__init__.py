"""Structured Streaming jobs over result files and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.labels import rate_limited
from ..operators.votes import pace


def stream_review_summary(spark: SparkSession, path: str, schema: StructType | str, keys: list[str], by: str) -> DataFrame:
    """Running tallies of review results that arrive as JSON files; a key counts once."""
    rows = spark.readStream.schema(schema).json(path).dropDuplicates(keys)
    ok = F.coalesce(F.trim("text"), F.lit("")) != ""
    return rows.groupBy(by).agg(F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"), F.count_if(rate_limited(F.col("error"))).alias("rate_limited"))


def stream_patch_results(spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str, keys: list[str], ts: str, delay: str = "1 hour") -> StreamingQuery:
    """Append each patch once; the checkpoint lets a restart go on.

    A batch is written to a folder of its own number, so one that is replayed
    after a failure replaces itself.
    """
    rows = spark.readStream.schema(schema).parquet(source).withColumn(ts, F.col(ts).cast("timestamp"))
    once = rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_throughput(rows: DataFrame, width: str = "10 minutes", delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Rows of each interval; works on streams and on tables. Rows later than the watermark are dropped by a stream."""
    typed = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    if typed.isStreaming:
        typed = typed.withWatermark(ts, delay)
    return typed.groupBy(F.window(ts, width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def stream_progress(spark: SparkSession, source: str, schema: StructType | str, totals: DataFrame, target: str, checkpoint: str, run: str, ident: str, ts: str, delay: str = "1 hour") -> StreamingQuery:
    """Progress of each run in ``target``: rows done, percent, rate and seconds left, as results arrive as Parquet files.

    The state of the stream holds a count and two times a run, and the ids
    within the watermark; the checkpoint lets a restart go on from there, and a
    result that is sent twice counts once. ``totals`` has (run, total). Each
    batch writes the runs that it touched to a folder of its own number; the
    last number of a run holds.
    """
    rows = spark.readStream.schema(schema).parquet(source).withColumn(ts, F.col(ts).cast("timestamp"))
    once = rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark([run, ident])
    state = once.groupBy(run).agg(F.count("*").alias("done"), F.min(ts).alias("first"), F.max(ts).alias("last"))

    def write(batch: DataFrame, number: int) -> None:
        now = batch.join(totals, run)
        speed = pace(F.col("done"), F.greatest(F.lit(0), F.col("total") - F.col("done")), F.col("first"), F.col("last"))
        percent = F.when(F.col("total") > 0, 100.0 * F.col("done") / F.col("total")).otherwise(100.0)
        now.select(run, "done", "total", percent.alias("percent"), *[v.alias(n) for n, v in speed.items()]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_progress(spark: SparkSession, target: str, run: str) -> DataFrame:
    """The last state of each run that ``stream_progress`` has written."""
    rows = spark.read.parquet(target)
    kept = [c for c in rows.columns if c not in (run, "batch")]
    return rows.groupBy(run).agg(F.max_by(F.struct(*kept), "batch").alias("_s")).select(run, "_s.*")
