"""Review batches: status, prices, costs, latency, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import rate_limited

#: The columns of a flat review result and of the retry queue, in order.
REVIEW_COLUMNS = (
    "case_id", "run_id", "bbox_id", "crop_path", "mask_path", "status", "failure_reason", "rate_limited", "json_parsed", "elapsed_seconds",
    "prompt_tokens", "output_tokens", "thoughts_tokens", "total_tokens", "estimated_input_cost_usd", "estimated_output_cost_usd",
    "estimated_total_cost_usd", "finish_reason", "error", "output_dir", "metadata_path",
)
RETRY_COLUMNS = (
    "case_id", "run_id", "bbox_id", "crop_path", "mask_path", "failure_reason", "error", "rate_limited", "finish_reason",
    "estimated_total_cost_usd", "metadata_path",
)
_NESTED = ("usage", "cost_estimate_usd")


def review_status(df: DataFrame, text: str = "text", parsed: str = "parsed") -> DataFrame:
    """success where there is text; a text that does not parse is a success with a reason."""
    empty = F.coalesce(F.trim(text), F.lit("")) == ""
    reason = F.when(empty, "empty_response").when(F.col(parsed).isNull(), "parse_failed")
    return df.withColumns({"status": F.when(empty, "failed").otherwise("success"), "failure_reason": reason})


def with_pricing(df: DataFrame, prices: DataFrame, model: str = "model", family: str = "m-") -> DataFrame:
    """Prices of the exact model, else of its last path segment where that is of the family."""
    last = F.element_at(F.split(model, "/"), -1)
    short = prices.select(F.col("model").alias("_s"), F.col("price_in").alias("_i2"), F.col("price_out").alias("_o2"))
    full = prices.select(F.col("model").alias("_f"), F.col("price_in").alias("_i1"), F.col("price_out").alias("_o1"))
    out = df.join(full, F.col(model) == F.col("_f"), "left").join(short, (last == F.col("_s")) & last.startswith(family), "left")
    return out.withColumns({"price_in": F.coalesce("_i1", "_i2"), "price_out": F.coalesce("_o1", "_o2")}).drop("_f", "_s", "_i1", "_i2", "_o1", "_o2")


def with_cost(df: DataFrame) -> DataFrame:
    """Cost in USD, of input, output and both, from prices per million tokens; thoughts are billed as output; null without prompt tokens or price."""
    out = F.coalesce("output_tokens", F.lit(0)) + F.coalesce("thoughts_tokens", F.lit(0))
    paid, made = F.col("prompt_tokens") * F.col("price_in"), out * F.col("price_out")
    return df.withColumns({"cost_input": paid / 1e6, "cost_output": F.when(paid.isNotNull(), made) / 1e6, "cost": (paid + made) / 1e6})


def latency_percentiles(df: DataFrame, col: str = "elapsed_s", at: tuple[float, ...] = (0.5, 0.9, 0.95)) -> DataFrame:
    p = F.percentile(col, F.array(*[F.lit(x) for x in at]))
    return df.agg(p.alias("p"), F.max(col).alias("m")).select(*[F.coalesce(F.col("p")[i], F.lit(0.0)).alias(f"p{int(x * 100)}") for i, x in enumerate(at)], F.coalesce("m", F.lit(0.0)).cast("double").alias("max"))


def review_summary(df: DataFrame, elapsed_total: float | None = None) -> DataFrame:
    """Totals of a batch in one row; with the batch's wall seconds also its requests a second."""
    failed = F.count_if(F.col("status") != "success")
    out = df.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("success"), failed.alias("failed"), failed.alias("retry"),
        F.count_if(rate_limited(F.col("error"))).alias("rate_limited"), F.count("parsed").alias("parsed"), F.count("cost").alias("costed"), F.sum("cost").alias("cost"))
    return out if elapsed_total is None else out.withColumn("throughput", F.col("total") / max(elapsed_total, 1e-6))


def review_scores(df: DataFrame, js: str = "parsed") -> DataFrame:
    """precision and recall as numbers out of several keys, and their band."""
    out = df
    for name in ("precision", "recall"):
        raw = F.coalesce(*[F.get_json_object(js, f"$.{name}.{k}") for k in ("score", "grade", "rating", "percentage")], F.get_json_object(js, f"$.{name}"))
        out = out.withColumn(name, F.regexp_extract(raw, r"([0-9.]+)", 1).try_cast("double"))
        v = F.col(name)
        out = out.withColumn(f"{name}_band", F.when(v >= 90, "high").when(v >= 70, "medium").when(v.isNotNull(), "low"))
    return out


def _fields(df: DataFrame, names: tuple[str, ...]) -> list[Column]:
    """Columns of these names, out of the nested ones where they lie there; null where there is none."""
    place = {c: F.col(c) for c in df.columns if c not in _NESTED}
    place |= {c: F.col(f"{p}.{c}") for p in _NESTED if p in df.columns for c in df.schema[p].dataType.names}
    if "elapsed_seconds" in place:
        place["elapsed_seconds"] = F.round(F.coalesce(place["elapsed_seconds"], F.lit(0.0)), 3)
    return [place.get(c, F.lit(None).cast("string")).alias(c) for c in names]


def flat_results(df: DataFrame) -> DataFrame:
    """Review rows in the column contract, usage and cost flat, times in milliseconds."""
    return df.select(*_fields(df, REVIEW_COLUMNS))


def retry_queue(df: DataFrame) -> DataFrame:
    """Rows without success, in the contract of the queue."""
    failed = df.filter("status <> 'success'")
    return failed.select(*_fields(failed, RETRY_COLUMNS))


def run_manifest(df: DataFrame, config: dict[str, str]) -> DataFrame:
    """Counts of a run and its settings in one row."""
    out = df.agg(F.count("*").alias("n_rows"), F.count_distinct("case_id").alias("n_cases"), F.count_distinct("model").alias("n_models"))
    return out.withColumns({k: F.lit(v) for k, v in config.items()})


def fallback_info(df: DataFrame, js: str = "meta") -> DataFrame:
    """Reason, no-examples and no-points flags of a selection run, from either place of its metadata."""
    reason = F.coalesce(F.get_json_object(js, "$.fallback.reason"), F.get_json_object(js, "$.selection.fallback.reason"))
    return df.withColumns({"reason": reason, "no_points": F.coalesce(reason == "no_points", F.lit(False)), "no_examples": reason.isNotNull()})
