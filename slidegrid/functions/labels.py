"""Labels, keys and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Other names of the classes, and the names of the qualities.
CLASS_ALIASES = {
    "foreground": "tissue",
    "fg": "tissue",
    "bg": "background",
    "paraffin": "paraffin_mounting_medium",
    "paraffin_mounting": "paraffin_mounting_medium",
    "paraffin_mounting_medium": "paraffin_mounting_medium",
    "pen": "pen_ink_marks",
    "pen_ink": "pen_ink_marks",
    "pen_ink_mark": "pen_ink_marks",
    "pen_ink_marks": "pen_ink_marks",
}
QUALITY_NAMES = {
    "sharp": "Sharp",
    "somewhat_blurred": "Somewhat Blurred",
    "blurred": "Somewhat Blurred",
    "slightly_blurred": "Somewhat Blurred",
    "out_of_focus": "Out of Focus",
    "completely_out_of_focus": "Out of Focus",
    "oof": "Out of Focus",
    "na": "NA",
}
RATE_HINTS = ("429", "rate limit", "ratelimit", "too many requests", "quota", "resource exhausted")


def _lookup(aliases: dict[str, str], c: Column, other: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.when(c.isNotNull(), F.coalesce(F.try_element_at(table, c), other))


def slug(c: Column) -> Column:
    """Lower case, separators as one underscore, other symbols and underscores at the ends gone."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"[\s\-/]+", "_")
    return F.btrim(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9_]", ""), "_+", "_"), F.lit("_"))


def canonical_label(c: Column, aliases: dict[str, str] = CLASS_ALIASES) -> Column:
    s = slug(c)
    return _lookup(aliases, s, s)


def canonical_quality(c: Column) -> Column:
    """The name of a quality; blank where it is unknown, null of null."""
    return _lookup(QUALITY_NAMES, slug(c), F.lit(""))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")


def box_key(*cols: str) -> Column:
    return F.concat_ws("_", *[F.col(c).cast("string") for c in cols])


def config_hash(*cols: str) -> Column:
    """First 8 hex digits of the md5 of the columns as JSON with sorted keys."""
    return F.substring(F.md5(F.to_json(F.struct(*sorted(cols)))), 1, 8)


def rate_limited(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike("|".join(RATE_HINTS)), F.lit(False))


def label_map(classes: DataFrame, keys: list[str], cls: str, mode: str = "neutral") -> DataFrame:
    """Display names: the class itself, or CLASS_0... with background first and tissue second."""
    if mode == "semantic":
        return classes.withColumn("display", F.col(cls))
    first = F.when(F.col(cls) == "background", 0).when(F.col(cls) == "tissue", 1).otherwise(2)
    w = Window.partitionBy(*keys).orderBy(first, cls)
    return classes.withColumn("display", F.concat(F.lit("CLASS_"), F.row_number().over(w) - 1))
