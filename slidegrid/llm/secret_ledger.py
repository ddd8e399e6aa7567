"""Incremental secret scanning over a content-addressed blob ledger, in DataFrame functions only.

Every text version is addressed by its SHA-256. A ledger row says that one blob
was scanned under one version of one rule, with what was found. ``scan`` reads
only pairs of blob and rule version that the ledger lacks; ``update_ledger``
keeps the ledger as a table that lasts from run to run and appends what is new;
``findings_by_path`` joins findings back to every path (``doc_id``) that ever
held a blob.

Spans are whole matches, in code points, end exclusive. Edge cases: a null text
is the empty blob; repeated rows share one blob and each row gets its findings;
very long texts are scanned whole; ties do not occur, as spans are ordered by
start and rule; an empty table gives no rows; extra columns are ignored; a null
doc_id is kept.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import _store, shared_dir


class Rule(NamedTuple):
    """``least``: code points that group ``group`` of a match must have at least."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


# The base patterns. Runs of access and hex keys below their least
# length cannot hold a longer match, so their length stands in the pattern.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

_SPAN = "array<struct<start:int,end:int>>"


def _spans(rule: Rule) -> Column:
    """Spans of a rule: the pieces between matches give each match's place."""
    p = rule.pattern.replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(f"""
      CASE WHEN text RLIKE '{p}' THEN
        transform(array(struct(regexp_extract_all(text, '{p}', 0) AS m, split(text, '{p}', -1) AS gap,
                               regexp_extract_all(text, '{p}', {rule.group}) AS g)), x ->
          aggregate(sequence(0, size(x.m) - 1),
            named_struct('at', 0, 'out', CAST(array() AS {_SPAN})),
            (a, i) -> named_struct('at', a.at + length(x.gap[i]) + length(x.m[i]), 'out',
              CASE WHEN length(x.g[i]) >= {rule.least} THEN
                concat(a.out, array(named_struct('start', a.at + length(x.gap[i]), 'end', a.at + length(x.gap[i]) + length(x.m[i]))))
              ELSE a.out END),
            a -> a.out))[0]
      ELSE CAST(array() AS {_SPAN}) END""")


def blobs_of(docs: DataFrame) -> DataFrame:
    """(doc_id, blob, text): each path with the address of what it holds."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, kind, version, spans) for pairs that ``ledger`` lacks."""
    versions = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    rows = blobs_of(docs)
    if ledger is None:
        todo = rows.groupBy("blob").agg(F.first("text").alias("text")).withColumn("due", versions)
    else:
        pairs = rows.select("blob").distinct().select("blob", F.explode(versions).alias("r")).select("blob", "r.kind", "r.version")
        due = pairs.join(ledger.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")
        due = due.groupBy("blob").agg(F.collect_list(F.struct("kind", "version")).alias("due"))
        # only texts with an open pair move on
        todo = rows.join(due, "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("due").alias("due"))
    found = F.array(*[
        F.when(F.array_contains("due", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))),
               F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), _spans(r).alias("spans")))
        for r in rules])
    out = todo.select("blob", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f"))
    return out.select("blob", "f.kind", "f.version", "f.spans")


LEDGER = "blob binary, kind string, version int, spans " + _SPAN


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at ``path``, or nothing where no update has been written yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(LEDGER).option("recursiveFileLookup", True).parquet(path)


def update_ledger(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger at ``path`` after all pairs that it lacked were scanned and appended.

    Each update is a table of its own below ``path``, written as a whole or not
    at all; a run that is repeated finds its pairs there and scans none. One
    writer at a time: two would append the same pairs.
    """
    spark = docs.sparkSession
    _store(scan(docs, read_ledger(spark, path), rules), f"{path.rstrip('/')}/update-{uuid.uuid4().hex}")
    return read_ledger(spark, path)


def findings_by_path(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, found): every path with all findings of its blob, by start and rule order."""
    order = {r.kind: k for k, r in enumerate(rules)}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    now = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    hit = ledger.filter(F.size("spans") > 0).filter(F.array_contains(now, F.struct("kind", "version")))
    hit = hit.select("blob", F.transform("spans", lambda s: F.struct(s.start.alias("start"), rank[F.col("kind")].alias("rank"), F.col("kind").alias("kind"), s.end.alias("end"))).alias("s"))
    hit = hit.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("found"))
    return blobs_of(docs).drop("text").join(hit, "blob", "left").select("doc_id", "found")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract out of ``findings_by_path``."""
    base = ("assign", "access", "hex")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    rows = found.withColumn("found", F.coalesce("found", F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")))
    rows = rows.withColumn("base", F.filter("found", lambda s: s.kind.isin(*base)))
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of the base rules, brought up to date for the rules that came later, and its findings by path."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"
    update_ledger(docs, path, RULES[:3])
    return digest(findings_by_path(docs, update_ledger(docs, path)))


def _rule_sql(rule: Rule, rank: int) -> str:
    p = rule.pattern.replace("'", "''")
    return f"SELECT doc_id, {rank} AS o, '{rule.kind}' AS kind, {rule.least} AS least, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {rule.group}) AS g, string_split_regex(t, '{p}') AS p FROM d"


#: The same rows as DuckDB SQL.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS ({" UNION ALL ".join(_rule_sql(r, k) for k, r in enumerate(RULES))}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM r),
s AS (SELECT doc_id, o, kind, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(m[i]) AS n FROM i WHERE length(g[i]) >= least),
f AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(concat(kind, ':', a, ':', a + n), ',' ORDER BY a, o) FILTER (o < 3) AS base, string_agg(concat(kind, ':', a, ':', a + n), ',' ORDER BY a, o) AS spans FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (doc_id)
"""
