"""Registered queries: every operator applied to the given tables, with its SQL twin."""

from __future__ import annotations

from . import files, geometry, masks, pipeline, pixels, replies, reviews, selection, votes

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _m in (files, geometry, masks, pipeline, pixels, replies, reviews, selection, votes):
    QUERIES.update(_m.QUERIES)
    ORACLE.update(_m.ORACLE)
