"""Columns derived from artifact paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_path_keys(df: DataFrame, col: str, anchor: str = "bboxes") -> DataFrame:
    """case_id, run_id, region and its box x1..y2 of ``case/run/bboxes/x1_y1_x2_y2/...``; fallbacks without the anchor."""
    parts = F.split(col, "/")
    at = F.array_position(parts, anchor)
    has = at > 2
    pick = lambda k: F.get(parts, (at + k - 1).cast("int"))
    region = F.when(has & pick(1).rlike(r"^\d+_\d+_\d+_\d+$"), pick(1))
    out = df.withColumns({"case_id": F.when(has, pick(-2)).otherwise(F.coalesce(F.nullif(F.element_at(parts, -2), F.lit("")), F.lit("unknown_case"))), "run_id": F.when(has, pick(-1)).otherwise("unknown_run"), "region": region})
    return out.withColumns({c: F.split("region", "_")[i].try_cast("long") for i, c in enumerate(("x1", "y1", "x2", "y2"))})
