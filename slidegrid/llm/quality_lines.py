"""Quality rules with cross-document line frequency, in DataFrame functions only.

``quality_rules`` measures every whole text, hashes its normalised lines, counts
for each host (``source``) in how many distinct documents a line occurs, removes
lines above the limit and rejects documents that lose most of their words.

Edge cases: a null or empty text has no words and fails the base rules; a null
source is a host of its own; rows that share a doc_id are one document where
documents are counted, and rows without one are not counted; repeated rows get
the same row each; very long texts are measured whole; ties do not occur (all
limits are exact integers); an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import column, materialize, with_text

#: A line in more distinct documents of one host than this is boilerplate.
MAX_DOCS_PER_HOST = 20
#: A document is depleted when fewer percent of its words are left than this.
MIN_LEFT_PERCENT = 30

_WORDS = r"regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+', 0)"
#: Bound once per row through a one-element array, as SQL has no local names.
_REPEATS = """
CASE WHEN n_words < 3 THEN 0L ELSE
 transform(array(slice(transform(words, (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2))), 1, n_words - 2)), h ->
  CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE
   transform(array(array_sort(transform(h, (x, i) -> struct(x AS h, i AS p)))), s ->
    aggregate(
     sort_array(filter(transform(s, (e, i) -> CASE WHEN e.h = get(s, i - 1).h OR e.h = get(s, i + 1).h THEN e.p END), p -> p IS NOT NULL)),
     named_struct('prev', -3, 'n', 0L),
     (a, p) -> named_struct('prev', p, 'n', a.n + least(3, p - a.prev)),
     a -> a.n))[0]
  END)[0]
END
"""


def line_profile(docs: DataFrame) -> DataFrame:
    """One row per document with base measures and its lines as (hash, words)."""
    rows = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.withColumn("words", F.expr(_WORDS)).withColumn("n_words", F.size("words"))
    return rows.select(
        "doc_id",
        "source",
        F.xxhash64("t").alias("text_key"),
        F.col("n_words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.expr("""transform(array(filter(split(t, '\\n', -1), x -> x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')),
                  x -> CAST(size(x) - size(array_distinct(x)) AS BIGINT))[0]""").alias("n_dup_lines"),
        F.expr(_REPEATS).cast("long").alias("n_repeat_words"),
        F.expr("""transform(filter(split(t, '\\n', -1), x -> x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'),
                  x -> transform(array(regexp_extract_all(lower(x), '[^\\\\x20\\\\x09-\\\\x0D]+', 0)),
                       w -> struct(xxhash64(array_join(w, ' ')) AS h, size(w) AS w))[0])""").alias("lines"),
    )


def frequent_lines(profile: DataFrame, max_docs: int = MAX_DOCS_PER_HOST) -> DataFrame:
    """(source, h) of lines in more than ``max_docs`` distinct documents of one host.

    ``profile`` has one row a doc_id, source and text. Lines of ids with one
    text of a host are counted as they are; those of the few ids with several
    are first made distinct by id, so that no id counts twice.
    """
    rows = profile.filter(F.col("doc_id").isNotNull())
    several = rows.groupBy("doc_id", "source").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select(F.col("doc_id").alias("_id"), F.col("source").alias("_host"))
    same = (F.col("doc_id") == F.col("_id")) & F.col("source").eqNullSafe(F.col("_host"))
    lines = lambda df: df.select("doc_id", "source", F.explode(F.array_distinct("lines.h")).alias("h"))
    count = lambda df: df.groupBy("source", "h").agg(F.count("*").alias("n_docs"))
    some = count(lines(rows.join(several, same, "left_anti"))).unionByName(count(lines(rows.join(several, same, "left_semi")).distinct()))
    return some.groupBy("source", "h").agg(F.sum("n_docs").alias("n_docs")).filter(F.col("n_docs") > max_docs)


def quality_rules(docs: DataFrame, max_docs: int = MAX_DOCS_PER_HOST, min_left: int = MIN_LEFT_PERCENT) -> DataFrame:
    """Measures, base verdict and final verdict of each document."""
    profile = materialize(line_profile(docs), "line-profile")
    keys = ["doc_id", "source", "text_key"]
    # one row per document, however often it is repeated
    once = profile.groupBy(*keys).agg(F.first("lines").alias("lines"))
    often = frequent_lines(once, max_docs).withColumnRenamed("source", "host").drop("n_docs")
    lines = once.select(*keys, F.explode("lines").alias("line")).select(*keys, "line.h", "line.w")
    # counts of one document's lines are summed before any row meets another table
    hit = lines.groupBy(*keys, "h").agg(F.sum("w").alias("w"), F.count("*").alias("n")).alias("l")
    hit = hit.join(often.alias("o"), (F.col("l.h") == F.col("o.h")) & F.col("l.source").eqNullSafe(F.col("o.host")))
    lost = hit.groupBy("doc_id", "source", "text_key").agg(F.sum("w").alias("removed_words"), F.sum("n").alias("removed_lines"))
    lost = lost.select(*[F.col(k).alias(f"_{k}") for k in keys], "removed_words", "removed_lines")
    match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    out = profile.drop("lines").join(lost, match[0] & match[1] & match[2], "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (100 * left >= min_left * F.col("n_words"))).alias("kept"),
        F.coalesce("removed_lines", F.lit(0)).cast("long").alias("removed_lines"),
        F.coalesce("removed_words", F.lit(0)).cast("long").alias("removed_words"),
    )


def without_frequent_lines(docs: DataFrame, max_docs: int = MAX_DOCS_PER_HOST) -> DataFrame:
    """``docs`` with all columns and rows, and texts without the lines that are frequent at their host.

    Texts that lose nothing stay as they are, null ones too; ``n_chars``
    follows the text where it is there.
    """
    keys = ["doc_id", "source", "text_key"]
    once = materialize(line_profile(docs).groupBy(*keys).agg(F.first("lines").alias("lines")), "line-profile")
    often = frequent_lines(once, max_docs).select(F.col("source").alias("host"), F.col("h").alias("_h"))
    lines = once.select(*keys, F.explode(F.array_distinct("lines.h")).alias("h"))
    gone = lines.join(often, (F.col("h") == F.col("_h")) & F.col("source").eqNullSafe(F.col("host"))).groupBy(*keys).agg(F.collect_set("h").alias("_gone"))
    gone = gone.select(*[F.col(k).alias(f"_{k}") for k in keys], "_gone")
    rows = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("_row"), *[F.col(c).alias(f"_of_{c}") for c in ("doc_id", "source")], F.xxhash64(F.coalesce("text", F.lit(""))).alias("_of_text_key"))
    match = [F.col(f"_of_{k}").eqNullSafe(F.col(f"_{k}")) for k in keys]
    words = lambda x: F.regexp_extract_all(F.lower(x), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    kept = F.filter(F.split(F.col("_row").getField("text"), "\n", -1), lambda x: (F.size(words(x)) == 0) | ~F.array_contains("_gone", F.xxhash64(F.array_join(words(x), " "))))
    text = F.when(F.col("_gone").isNull(), F.col("_row").getField("text")).otherwise(F.array_join(kept, "\n"))
    return rows.join(gone, match[0] & match[1] & match[2], "left").select(*with_text(docs, text))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same rows as DuckDB SQL.
SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM x QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY 1),
l AS (SELECT doc_id, source, s, array_to_string(v, ' ') AS k, len(v) AS n FROM (SELECT *, regexp_extract_all(lower(s), '[^\x20\x09-\x0D]+') AS v FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS s FROM d)) WHERE len(v) > 0),
f AS (SELECT source, k FROM l GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > {MAX_DOCS_PER_HOST}),
z AS (SELECT l.doc_id, count(*) AS removed_lines, sum(n) AS removed_words FROM l JOIN f ON f.k = l.k AND f.source IS NOT DISTINCT FROM l.source GROUP BY 1),
u AS (SELECT doc_id, count(*) - count(DISTINCT s) AS n_dup_lines FROM l GROUP BY 1),
o AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, CAST(coalesce(removed_lines, 0) AS BIGINT) AS removed_lines, CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN c USING (doc_id) LEFT JOIN z USING (doc_id) LEFT JOIN u USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - removed_words) >= {MIN_LEFT_PERCENT} * n_words AS kept FROM o
"""
