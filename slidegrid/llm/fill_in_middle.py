"""Fill-in-middle transformation by counted-quantifier regular expressions.

``regexp_count`` gives the number n of tokens of a text. Two cuts a <= b are
drawn from the hash of a seed and the row's id, and a pattern made for the row,
``(unit{a})(unit{b-a})(rest)`` with possessive groups, captures prefix, middle
and suffix in one match, whose replacement writes them in the order of the
row's form. Possessive groups never step back, so a text of any length is read
once and without recursion; a text is never cut.

Edge cases: a null or empty text stays plain and empty; a text that holds one
of the markers stays plain; a null id is hashed as the empty string; both cuts
may fall on the same place, which leaves an empty middle; very long texts are
transformed whole; repeated rows get the same result each; ties do not occur;
an empty table gives no rows; all columns are kept, one that is called as a new
one (n, form, output) gives way to it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import column

#: A token: spaces and the word that follows them, or the spaces at the end.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"


class Markers(NamedTuple):
    """Each opens its part. None may end in a piece of another or of itself."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def _draw(hashed: Column, k: int) -> Column:
    """The k-th group of eight hex digits, counted from 1, as an unsigned integer."""
    return F.conv(F.substring(hashed, 8 * k - 7, 8), 16, 10).cast("long")


def _quoted(text: str) -> str:
    """As a replacement that stands for itself."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def _start(text: Column, marker: str) -> Column:
    """Where a marker begins, counted from 1."""
    return F.instr(text, marker)


def _part(text: Column, begin: Column | int, end: Column | None = None) -> Column:
    """From place ``begin`` up to before place ``end``, counted from 1."""
    begin = F.lit(begin) if isinstance(begin, int) else begin
    return F.substring(text, begin, (F.length(text) + 1 if end is None else end) - begin)


def transform(docs: DataFrame, text: str = "text", ident: str = "doc_id", seed: int = 42, percent: int = 50, spm_percent: int = 80, markers: Markers = Markers()) -> DataFrame:
    """``docs`` with n (tokens), form (plain, psm or spm) and output.

    ``percent`` of the rows are transformed, ``spm_percent`` of them into the
    form in which the suffix comes first.
    """
    p, s, m = map(_quoted, markers)
    whole = F.coalesce(column(text), F.lit(""))
    rows = docs.select(*[column(c) for c in docs.columns if c not in ("n", "form", "output")], whole.alias("_text"))
    rows = rows.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(column(ident).cast("string"), F.lit(""))), 256))
    held = F.lit(False)
    for marker in markers:
        held = held | F.contains(F.col("_text"), F.lit(marker))
    plain = (F.col("_text") == "") | held | (_draw(F.col("_h"), 3) % 100 >= percent)
    form = F.when(plain, "plain").when(_draw(F.col("_h"), 4) % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.withColumns({"form": form, "n": F.regexp_count("_text", F.lit(UNIT)).cast("long")})
    one, two = (_draw(F.col("_h"), k) % (F.col("n") + 1) for k in (1, 2))
    rows = rows.withColumns({"_a": F.least(one, two), "_b": F.greatest(one, two)})
    unit = f"(?:{UNIT})"
    pattern = F.concat(F.lit(rf"(?s)\A({unit}{{"), F.col("_a"), F.lit(rf"}}+)({unit}{{"), F.col("_b") - F.col("_a"), F.lit(r"}+)(.*+)\z"))
    order = F.when(F.col("form") == "psm", f"{p}$1{s}$3{m}$2").otherwise(f"{s}$3{p}$1{m}$2")
    output = F.when(F.col("form") == "plain", F.col("_text")).otherwise(F.regexp_replace("_text", pattern, order))
    return rows.withColumn("output", output).drop("_text", "_h", "_a", "_b")


def parts(output: Column, form: Column, markers: Markers = Markers()) -> tuple[Column, Column, Column]:
    """Prefix, middle and suffix out of an output that is not plain; null for plain ones."""
    p, s, m = (_start(output, x) for x in markers)
    lp, ls, lm = map(len, markers)
    psm = F.when(form == "psm", F.lit(True)).when(form == "spm", F.lit(False))
    prefix = F.when(psm, _part(output, lp + 1, s)).when(~psm, _part(output, p + lp, m))
    suffix = F.when(psm, _part(output, s + ls, m)).when(~psm, _part(output, ls + 1, p))
    return prefix, F.when(psm.isNotNull(), _part(output, m + lm)), suffix


def restore(output: Column, form: Column, markers: Markers = Markers()) -> Column:
    """The exact text that an output was made of."""
    return F.when(form == "plain", output).otherwise(F.concat(*parts(output, form, markers)))


def digest(made: DataFrame) -> DataFrame:
    """The columns of the contract out of ``transform``."""
    prefix, middle, _ = parts(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", F.length(prefix).cast("long").alias("prefix_chars"), F.length(middle).cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(transform(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


_H = ", ".join(f"CAST(concat('0x', substr(h, {8 * k + 1}, 8)) AS BIGINT) AS h{k + 1}" for k in range(4))
#: The same rows as DuckDB SQL.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('42:', doc_id)) AS h FROM documents),
u AS (SELECT doc_id, t, {_H}, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM d),
c AS (SELECT doc_id, t, w, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(w[1:a], '') AS x, array_to_string(w[a + 1:b], '') AS y, array_to_string(w[b + 1:], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
