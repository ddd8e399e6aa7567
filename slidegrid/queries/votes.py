"""Queries of votes, verdicts, catalogue and resume operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import votes as V
from . import fixtures as X

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_V = f"WITH v AS ({X.VOTES}) "
_KINDS = ["artifact_0", "artifact_1", "artifact_2", "artifact_3", "artifact_4", "artifact_5", "artifact_6"]
_CLAIM = "SELECT event_id, user_id AS region, concat('artifact_', event_id % 7) AS artifact, 90 * (event_id % 4) AS rot, value > 0.5 AS present, CASE WHEN event_id % 3 > 0 THEN event_type ELSE '' END AS evidence, CASE event_id % 5 WHEN 0 THEN 'sa' WHEN 1 THEN ' SA ' WHEN 2 THEN 'WA' WHEN 3 THEN 'maybe' END AS answer FROM events"
_CLAIMS = f"WITH q AS ({_CLAIM}), c AS (SELECT region, artifact, rot, max(event_id) AS e FROM q GROUP BY 1, 2, 3), k AS (SELECT q.* FROM q JOIN c ON q.event_id = c.e), s AS (SELECT region, artifact, rot, CASE WHEN NOT present THEN 'SD' WHEN trim(evidence) = '' THEN 'WA' WHEN upper(trim(answer)) IN ('SA', 'WA') THEN upper(trim(answer)) ELSE 'WA' END AS strength FROM k)"
_VERD = f"{_CLAIMS}, n AS (SELECT region, a.artifact, count(*) FILTER (s.artifact = a.artifact AND strength = 'WA') AS \"WA\", count(*) FILTER (s.artifact = a.artifact AND strength = 'SA') AS \"SA\" FROM s, (SELECT unnest({_KINDS!r}) AS artifact) a GROUP BY 1, 2), vd AS (SELECT region, artifact, 4 - \"WA\" - \"SA\" AS \"SD\", \"WA\", \"SA\", CASE WHEN \"SA\" >= 3 THEN 'INCLUDE' WHEN \"SA\" = 2 THEN 'CONFLICT' ELSE 'EXCLUDE' END AS verdict FROM n)"


def _add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def claims(spark, d):
    q = X.derive(spark, d, _CLAIM, "events")
    rest = [c for c in q.columns if c not in ("region", "artifact", "rot")]
    return q.groupBy("region", "artifact", "rot").agg(F.max_by(F.struct(*rest), "event_id").alias("_r")).select("region", "artifact", "rot", "_r.*")


def strengths(spark, d):
    c = claims(spark, d)
    return V.resolve_strength(c.drop("answer"), c.select("region", "artifact", "rot", "answer"), ["region", "artifact", "rot"])


def verdicts(spark, d):
    return V.artifact_verdicts(strengths(spark, d), _KINDS, ["region"])


@_add("d1_majority_vote", _V + "SELECT slide, patch, arg_max(label, (n, -o)) AS label, max(n) AS votes FROM (SELECT slide, patch, label, count(*) AS n, min(run) AS o FROM v GROUP BY 1, 2, 3) GROUP BY 1, 2")
def _(spark, d):
    return V.majority_vote(X.votes(spark, d), ["slide", "patch"], "label", "run", "background")


@_add("d2_vote_map", _V + "SELECT slide, patch, concat('{', string_agg(concat('\"', label, '\":', n), ',' ORDER BY label), '}') AS votes FROM (SELECT slide, patch, label, count(*) AS n FROM v GROUP BY 1, 2, 3) GROUP BY 1, 2")
def _(spark, d):
    return V.vote_map(X.votes(spark, d), ["slide", "patch"], "label")


@_add("d3_artifact_verdicts", _VERD + ' SELECT region, artifact, "SD" AS n_sd, "WA" AS n_wa, "SA" AS n_sa, verdict FROM vd')
def _(spark, d):
    return verdicts(spark, d).select("region", "artifact", F.col("SD").alias("n_sd"), F.col("WA").alias("n_wa"), F.col("SA").alias("n_sa"), "verdict")


@_add("d4_aggregate_claims", _CLAIMS + " SELECT region, artifact, concat('{', string_agg(concat('\"', rot, '\":\"', evidence, '\"'), ',' ORDER BY CAST(rot AS VARCHAR)), '}') AS evidence FROM k WHERE present GROUP BY 1, 2")
def _(spark, d):
    return V.aggregate_claims(claims(spark, d), ["region", "artifact"])


@_add("d5_resolve_strength", _CLAIMS + " SELECT region, artifact, rot, strength FROM s")
def _(spark, d):
    return strengths(spark, d).select("region", "artifact", "rot", "strength")


@_add("d6_verdict_summary", _VERD + " SELECT region, count(*) FILTER (verdict = 'INCLUDE') AS n_include, count(*) FILTER (verdict = 'EXCLUDE') AS n_exclude, count(*) FILTER (verdict = 'CONFLICT') AS n_conflict, CAST(0 AS BIGINT) AS n_error FROM vd GROUP BY 1")
def _(spark, d):
    return V.verdict_summary(verdicts(spark, d), ["region"])


@_add("b18_include_classes", _VERD + " SELECT region, artifact, 'no note' AS note FROM vd WHERE verdict = 'INCLUDE'")
def _(spark, d):
    return V.include_classes(verdicts(spark, d).withColumn("note", F.lit(" "))).select("region", "artifact", "note")


@_add("d7_point_summary", "WITH p AS (SELECT user_id AS region, event_type AS cls FROM events WHERE user_id % 4 > 0), a AS (SELECT region, cls, count(*) AS n, 'files' AS source FROM p GROUP BY 1, 2) SELECT * FROM a UNION ALL SELECT DISTINCT user_id, CAST(NULL AS VARCHAR), CASE WHEN user_id % 8 = 0 THEN 0 ELSE user_id END, CASE WHEN user_id % 8 = 0 THEN 'none' ELSE 'metadata' END FROM events WHERE user_id % 4 = 0")
def _(spark, d):
    e = X.table(spark, d, "events")
    p = e.filter("user_id % 4 > 0").select(F.col("user_id").alias("region"), F.col("event_type").alias("cls"))
    meta = e.select(F.col("user_id").alias("region")).distinct().withColumn("total", F.when(F.col("region") % 8 != 0, F.col("region")))
    return C.point_summary(p, meta, ["region"], "cls")


_NEW = "FILTER (quality_id > 0 AND run % 2 = 1 AND run % 4 > 0)"
_RATE = f"(count(*) {_NEW} / (epoch(max(ts) {_NEW}) - epoch(min(ts) {_NEW})))"


@_add("d18_progress_summary", f"WITH v AS (SELECT v.*, ts FROM ({X.VOTES}) v JOIN (SELECT event_id AS run, ts FROM events) USING (run)) SELECT count(*) FILTER (quality_id > 0) AS kept, count(*) FILTER (quality_id = 0) AS skipped, count(*) FILTER (quality_id > 0 AND run % 4 > 0) AS done, count(*) FILTER (quality_id > 0 AND run % 2 = 0) AS resumed, count(*) FILTER (quality_id > 0 AND run % 2 = 1) AS \"new\", CAST(floor(100.0 * count(*) FILTER (quality_id > 0 AND run % 4 > 0) / count(*) FILTER (quality_id > 0) * 1e6 + 0.5) AS BIGINT) AS percent, CAST(floor({_RATE} * 1e6 + 0.5) AS BIGINT) AS rate, CAST(floor(count(*) FILTER (quality_id > 0 AND run % 2 = 1 AND run % 4 = 0) / {_RATE} * 1e3 + 0.5) AS BIGINT) AS eta_seconds FROM v")
def _(spark, d):
    v = X.votes(spark, d).withColumn("label", F.when(F.col("run") % 4 > 0, F.col("label")))
    v = v.join(X.table(spark, d, "events").select(F.col("event_id").alias("run"), "ts"), "run")
    out = V.progress_summary(v, F.col("quality_id") > 0, F.col("run") % 2 == 0, F.col("ts"))
    return out.withColumns({"percent": F.floor(F.col("percent") * 1e6 + 0.5), "rate": F.floor(F.col("rate") * 1e6 + 0.5), "eta_seconds": F.floor(F.col("eta_seconds") * 1e3 + 0.5)})


@_add("f6_expand_variants", _V + "SELECT run, CAST(s AS BIGINT) AS shuffle, CAST(q AS BIGINT) AS rotation, CASE WHEN s = 0 THEN '' ELSE md5(concat(s + 42, '-', run)) END AS rank_key FROM v, (SELECT unnest([0, 1, 2]) AS s), (SELECT unnest([0, 180]) AS q)")
def _(spark, d):
    out = V.expand_variants(X.votes(spark, d).select("run"), 3, (0, 180), 42, "run")
    return out.select("run", F.col("shuffle").cast("long").alias("shuffle"), F.col("rotation").cast("long").alias("rotation"), "rank_key")


@_add("c3_resume_join", _V + "SELECT run, CASE WHEN run % 3 = 0 THEN quality_id + 10 ELSE quality_id END AS quality_id, run % 3 = 0 AS resumed FROM v")
def _(spark, d):
    v = X.votes(spark, d).select("run", "quality_id")
    s = v.filter("run % 3 = 0").withColumn("quality_id", F.col("quality_id") + 10)
    return C.resume_join(v, s, ["run"], ["quality_id"])


@_add("c3_stale_rows", _V + "SELECT run, patch FROM v WHERE run % 3 = 0")
def _(spark, d):
    v = X.votes(spark, d).select("run", "patch")
    return C.stale_rows(v.filter("run % 3 > 0"), v, ["run"])


@_add("c4_pending", _V + "SELECT run, patch FROM v WHERE quality_id <> 1")
def _(spark, d):
    v = X.votes(spark, d)
    return C.pending(v.select("run", "patch"), v.filter("quality_id = 1").select("run"), ["run"])


_CAT = "cat AS (SELECT l_orderkey AS run, l_partkey % 3 AS region, concat('a', l_linenumber % 4) AS name FROM lineitem)"


@_add("a12_complete_items", f"WITH {_CAT}, n AS (SELECT run, list(DISTINCT name) AS h FROM cat GROUP BY 1) SELECT run, array_to_string(list_filter(['a0', 'a1', 'a2'], lambda x: NOT list_contains(h, x)), ',') AS missing, len(list_filter(['a0', 'a1', 'a2'], lambda x: NOT list_contains(h, x))) = 0 AS complete FROM n")
def _(spark, d):
    return C.complete_items(catalog(spark, d), ["a0", "a1", "a2"], ["run"], "name")


def catalog(spark, d):
    return X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), (F.col("l_partkey") % 3).alias("region"), F.concat(F.lit("a"), F.col("l_linenumber") % 4).alias("name"))


@_add("c5_run_completeness", f"WITH {_CAT}, need AS (SELECT run, region, n, name FROM (SELECT DISTINCT run, region FROM cat), (SELECT unnest([0, 1, 2]) AS n, unnest(['a0', 'a1', 'a2']) AS name)), lack AS (SELECT need.* FROM need ANTI JOIN cat ON cat.run = need.run AND cat.region = need.region AND cat.name = need.name), f AS (SELECT run, arg_min(concat(region, ':', name), (region, n)) AS first_missing FROM lack GROUP BY 1) SELECT r.run, first_missing, first_missing IS NULL AS complete FROM (SELECT DISTINCT run FROM cat) r LEFT JOIN f ON f.run = r.run")
def _(spark, d):
    c = catalog(spark, d)
    return C.run_completeness(c.select("run", "region").distinct(), c, ["a0", "a1", "a2"], "run", "region", "name")


@_add("e1_latest_per", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def _(spark, d):
    return C.latest_per(X.table(spark, d, "events"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@_add("e3_assign_batches", f"WITH c AS (SELECT slide, r, c, class_id > 0 AS kept, row_number() OVER (PARTITION BY slide, class_id > 0 ORDER BY r, c) - 1 AS a FROM ({X.CELLS})), b AS (SELECT slide, r, c, CASE WHEN kept THEN concat('b', CAST(floor(a / 8.0) AS BIGINT)) ELSE concat('s', a) END AS batch_id, CASE WHEN kept THEN a % 8 ELSE 0 END AS batch_index FROM c) SELECT *, count(*) OVER (PARTITION BY slide, batch_id) AS batch_size FROM b")
def _(spark, d):
    c = X.cells(spark, d).withColumn("kept", F.col("class_id") > 0)
    out = C.assign_batches(c, 8, order=("r", "c"))
    return out.select("slide", "r", "c", "batch_id", F.col("batch_index").cast("long").alias("batch_index"), "batch_size")


@_add("c8_replay_group", f"{_V}, g AS (SELECT slide, run, CASE WHEN patch % 5 > 0 THEN concat('g', patch) ELSE '' END AS batch FROM v), m AS (SELECT *, count(*) OVER (PARTITION BY slide, batch) AS n FROM g) SELECT t.slide, t.run AS target, m.run, row_number() OVER (PARTITION BY t.slide, t.run ORDER BY m.run) AS position FROM g t JOIN m ON m.slide = t.slide AND m.batch = t.batch AND m.n > 1 WHERE t.run % 11 = 3 AND t.batch <> ''")
def _(spark, d):
    g = X.votes(spark, d).select("slide", "run", F.when(F.col("patch") % 5 > 0, F.concat(F.lit("g"), "patch")).otherwise("").alias("batch"))
    return C.replay_group(g, g.filter("run % 11 = 3").select("slide", "run"), ["slide"], "batch", "run").select("slide", "target", "run", F.col("position").cast("long").alias("position"))


@_add("f1_cap_per_class", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) <= 5")
def _(spark, d):
    return C.cap_per_class(X.table(spark, d, "documents"), 5, ["lang"], ["source", "doc_id"]).select("doc_id", "lang")


@_add("f2_sample_per_class", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(concat('7-', doc_id))) <= 5")
def _(spark, d):
    return C.sample_per_class(X.table(spark, d, "documents").select("doc_id", "lang"), 5, 7, ["lang"], "doc_id")


@_add("f3_cap_cases", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT DISTINCT o_custkey FROM orders ORDER BY 1 LIMIT 50) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2")
def _(spark, d):
    return C.cap_cases(X.table(spark, d, "orders").select("o_custkey", "o_orderkey"), 50, "o_custkey", "o_orderkey", 2)


@_add("f4_order_group", _V + "SELECT slide, run, row_number() OVER (PARTITION BY slide, patch ORDER BY CASE WHEN quality_id > 0 THEN quality_id END NULLS LAST, run) AS position FROM v")
def _(spark, d):
    v = X.votes(spark, d).withColumn("rank", F.when(F.col("quality_id") > 0, F.col("quality_id")))
    return C.order_group(v, ["slide", "patch"], "rank", "run").select("slide", "run", F.col("position").cast("long").alias("position"))


@_add("f5_present_classes", _V + "SELECT patch, string_agg(label, ',' ORDER BY label DESC) AS classes FROM (SELECT DISTINCT patch, label FROM v) GROUP BY 1")
def _(spark, d):
    from pyspark.sql import Window

    v = X.votes(spark, d)
    k = v.select("label").distinct().withColumn("ordinal", F.row_number().over(Window.orderBy(F.desc("label"))))
    return C.present_classes(v, k, ["patch"], "label")


@_add("l1_resume_plan", "WITH r AS (SELECT o_custkey AS case_id, o_orderkey AS run, o_orderstatus = 'F' AS complete FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) SELECT c_custkey AS case_id, run, CASE WHEN run IS NULL THEN 'new' WHEN complete THEN 'skip' ELSE 'resume' END AS plan FROM customer LEFT JOIN r ON r.case_id = c_custkey")
def _(spark, d):
    runs = X.table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("run"), (F.col("o_orderstatus") == "F").alias("complete"))
    return C.resume_plan(X.table(spark, d, "customer").select(F.col("c_custkey").alias("case_id")), runs, "case_id", "run")


_STAGES = ("click", "view", "purchase", "error", "signup")
_DONE = ", ".join(f"coalesce(bool_or(CASE WHEN stage = '{x}' THEN ok END), false) AS done_{x}" for x in _STAGES)
_PLACE = "list_position([" + ", ".join(f"'{x}'" for x in _STAGES) + "], stage)"


@_add("l2_status_rollup", f"WITH v AS (SELECT user_id, event_type AS stage, value > 0.2 AS ok, concat('low ', event_id) AS why FROM events) SELECT user_id, {_DONE}, arg_min(stage, ({_PLACE}, why)) FILTER (NOT ok) AS first_failure, arg_min(why, ({_PLACE}, why)) FILTER (NOT ok) AS error FROM v GROUP BY 1")
def _(spark, d):
    e = X.table(spark, d, "events").select("user_id", F.col("event_type").alias("stage"), (F.col("value") > 0.2).alias("ok"), F.concat(F.lit("low "), "event_id").alias("why"))
    return C.status_rollup(e, ["user_id"], list(_STAGES), error="why")


@_add("b10_select_cases", "SELECT o_orderkey, o_orderpriority FROM orders WHERE (o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '%LOW') AND o_orderpriority IN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderstatus = 'F')")
def _(spark, d):
    o = X.table(spark, d, "orders")
    allow = o.filter("o_orderstatus = 'F'").select("o_orderpriority").distinct()
    return C.select_cases(o.select("o_orderkey", "o_orderpriority"), "o_orderpriority", allow, ["1-*", "*LOW"])


@_add("b10_select_cases_capped", "SELECT c_custkey, c_name FROM customer WHERE c_name IN (SELECT DISTINCT c_name FROM customer WHERE c_name LIKE 'C%1' ORDER BY c_name LIMIT 5)")
def _(spark, d):
    return C.select_cases(X.table(spark, d, "customer").select("c_custkey", "c_name"), "c_name", globs=["C*1"], max_items=5)


@_add("g4_fill_missing", "SELECT s_suppkey, coalesce(CAST(q AS BIGINT), -1) AS q, q IS NULL AS synthetic FROM supplier LEFT JOIN (SELECT l_suppkey, sum(l_linenumber) AS q FROM lineitem WHERE l_quantity > 48 GROUP BY 1) ON l_suppkey = s_suppkey")
def _(spark, d):
    q = X.table(spark, d, "lineitem").filter("l_quantity > 48").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum("l_linenumber").alias("q"))
    return C.fill_missing(X.table(spark, d, "supplier"), q, ["s_suppkey"], {"q": F.lit(-1).cast("long")})
