"""Queries of review batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import rate_limited
from ..operators import reviews as R
from . import fixtures as X
from .geometry import micro

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_PRICE = "pr AS (SELECT 'm-large' AS model, 2.0 AS pi, 12.0 AS po UNION ALL SELECT 'm-small', 0.5, 3.0)"
_R = f"WITH r AS (SELECT *, CASE WHEN trim(text) = '' THEN 'failed' ELSE 'success' END AS status, CASE WHEN trim(text) = '' THEN 'empty_response' WHEN item % 2 = 1 THEN 'parse_failed' END AS failure_reason FROM ({X.REVIEWS})), {_PRICE}, c AS (SELECT r.*, pi, po, (prompt_tokens * pi + (coalesce(output_tokens, 0) + coalesce(thoughts_tokens, 0)) * po) / 1e6 AS cost FROM r LEFT JOIN pr ON pr.model = regexp_extract(r.model, '[^/]*$')) "


def _add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def reviewed(spark, d):
    r = X.reviews(spark, d).withColumn("parsed", F.when((F.trim("text") != "") & (F.col("item") % 2 == 0), "{}"))
    return R.review_status(r)


def costed(spark, d):
    prices = spark.sql("SELECT 'm-large' AS model, 2.0D AS price_in, 12.0D AS price_out UNION ALL SELECT 'm-small', 0.5D, 3.0D")
    return R.with_cost(R.with_pricing(reviewed(spark, d), prices))


@_add("b11_rate_limited", "SELECT doc_id, regexp_matches(lower(text), '429|rate limit|ratelimit|too many requests|quota|resource exhausted') AS limited FROM documents")
def _(spark, d):
    return X.table(spark, d, "documents").select("doc_id", rate_limited(F.col("text")).alias("limited"))


@_add("b12_review_status", _R + "SELECT case_id, item, status, failure_reason FROM r")
def _(spark, d):
    return reviewed(spark, d).select("case_id", "item", "status", "failure_reason")


@_add("c6_with_pricing", _R + "SELECT case_id, item, CAST(pi * 1e6 AS BIGINT) AS price_in, CAST(po * 1e6 AS BIGINT) AS price_out FROM c")
def _(spark, d):
    return costed(spark, d).select("case_id", "item", micro(F.col("price_in")).alias("price_in"), micro(F.col("price_out")).alias("price_out"))


@_add("d15_latency_percentiles", _R + "SELECT " + ", ".join(f"CAST(floor({e} * 1e6 + 0.5) AS BIGINT) AS {n}" for e, n in (("quantile_cont(elapsed_s, 0.5)", "p50"), ("quantile_cont(elapsed_s, 0.9)", "p90"), ("quantile_cont(elapsed_s, 0.95)", "p95"), ("max(elapsed_s)", '"max"'))) + " FROM r")
def _(spark, d):
    p = R.latency_percentiles(X.reviews(spark, d))
    return p.select(*[micro(F.col(c)).alias(c) for c in p.columns])


@_add("d16_review_summary", _R + "SELECT count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status <> 'success') AS failed, count(*) FILTER (status <> 'success') AS retry, count(*) * 1000 // 3600 AS throughput, count(*) FILTER (error IS NOT NULL) AS rate_limited, count(*) FILTER (failure_reason IS NULL) AS parsed, count(cost) AS costed, CAST(floor(sum(cost) * 1e6 + 0.5) AS BIGINT) AS cost FROM c")
def _(spark, d):
    return R.review_summary(costed(spark, d), 3600.0).withColumns({"cost": F.floor(F.col("cost") * 1e6 + 0.5), "throughput": F.floor(F.col("throughput") * 1e3 + 1e-9)})


@_add("d17_with_cost", _R + "SELECT case_id, item, CAST(floor(cost * 1e9 + 0.5) AS BIGINT) AS cost FROM c")
def _(spark, d):
    return costed(spark, d).select("case_id", "item", F.floor(F.col("cost") * 1e9 + 0.5).alias("cost"))


_NONE = ("run_id", "crop_path", "mask_path", "finish_reason", "output_dir", "metadata_path")
_FLAT = {
    "bbox_id": "item", "elapsed_seconds": "CAST(floor(elapsed_s * 1e3 + 0.5) AS BIGINT)", "json_parsed": "failure_reason IS NULL", "rate_limited": "error IS NOT NULL",
    "total_tokens": "prompt_tokens + output_tokens", "estimated_input_cost_usd": "CAST(floor(prompt_tokens * pi * 1e3 + 0.5) AS BIGINT)",
    "estimated_output_cost_usd": "CAST(floor((output_tokens + coalesce(thoughts_tokens, 0)) * po * 1e3 + 0.5) AS BIGINT)", "estimated_total_cost_usd": "CAST(floor(cost * 1e9 + 0.5) AS BIGINT)",
} | {c: "NULL" for c in _NONE}
_flat = lambda names: ", ".join(f"{_FLAT.get(c, c)} AS {c}" for c in names)
_NANO = ("estimated_input_cost_usd", "estimated_output_cost_usd", "estimated_total_cost_usd")


def nested(spark, d):
    r = costed(spark, d).withColumnsRenamed({"item": "bbox_id", "elapsed_s": "elapsed_seconds"})
    r = r.withColumns({"json_parsed": F.col("parsed").isNotNull(), "rate_limited": rate_limited(F.col("error"))})
    usage = F.struct("prompt_tokens", "output_tokens", "thoughts_tokens", (F.col("prompt_tokens") + F.col("output_tokens")).alias("total_tokens"))
    cost = F.struct(*[F.col(c).alias(n) for c, n in zip(("cost_input", "cost_output", "cost"), _NANO, strict=True)])
    return r.select("case_id", "bbox_id", "status", "failure_reason", "error", "json_parsed", "rate_limited", "elapsed_seconds", usage.alias("usage"), cost.alias("cost_estimate_usd"))


def whole(df):
    """Costs as whole billionths of a dollar, times as milliseconds."""
    return df.withColumns({c: F.floor(F.col(c) * (1e9 if c in _NANO else 1e3) + 0.5) for c in (*_NANO, "elapsed_seconds") if c in df.columns})


@_add("a8_flat_results", _R + f"SELECT {_flat(R.REVIEW_COLUMNS)} FROM c")
def _(spark, d):
    return whole(R.flat_results(nested(spark, d)))


@_add("a9_retry_queue", _R + f"SELECT {_flat(R.RETRY_COLUMNS)} FROM c WHERE status <> 'success'")
def _(spark, d):
    return whole(R.retry_queue(nested(spark, d)))


@_add("a10_run_manifest", _R + "SELECT count(*) AS n_rows, count(DISTINCT case_id) AS n_cases, count(DISTINCT model) AS n_models, 'v1' AS version FROM r")
def _(spark, d):
    return R.run_manifest(X.reviews(spark, d), {"version": "v1"})


@_add("b17_fallback_info", "WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN CASE o_orderstatus WHEN 'F' THEN 'no_points' ELSE 'few_points' END END AS reason FROM orders) SELECT o_orderkey, reason, coalesce(reason = 'no_points', false) AS no_points, reason IS NOT NULL AS no_examples FROM m")
def _(spark, d):
    why = F.when(F.col("o_orderstatus") == "F", "no_points").otherwise("few_points")
    js = F.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit('{"fallback":{"reason":"'), why, F.lit('"}}'))).when(F.col("o_orderkey") % 3 == 2, F.concat(F.lit('{"selection":{"fallback":{"reason":"'), why, F.lit('"}}}'))).otherwise("{}")
    return R.fallback_info(X.table(spark, d, "orders").select("o_orderkey", js.alias("meta"))).drop("meta")


@_add("b19_review_scores", "WITH s AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL ELSE event_id % 101 END AS v FROM events) SELECT event_id, CAST(v * 1000000 AS BIGINT) AS precision, CASE WHEN v >= 90 THEN 'high' WHEN v >= 70 THEN 'medium' WHEN v IS NOT NULL THEN 'low' END AS precision_band FROM s")
def _(spark, d):
    n = (F.col("event_id") % 101).cast("string")
    js = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"precision":{"score":"'), n, F.lit(' %"}}'))).when(F.col("event_id") % 3 == 2, F.concat(F.lit('{"precision":'), n, F.lit("}"))).otherwise("{}")
    out = R.review_scores(X.table(spark, d, "events").select("event_id", js.alias("parsed")))
    return out.select("event_id", micro(F.col("precision")).alias("precision"), "precision_band")
