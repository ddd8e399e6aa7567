"""Every registered slide query against its SQL twin on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from slidegrid.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


def norm(v):
    v = v.item() if hasattr(v, "item") else v
    if v is None or v != v:
        return None
    return int(v) if isinstance(v, float) and v == int(v) else v


def rows(pdf):
    cols = sorted(pdf.columns)
    return sorted(repr([norm(v) for v in r]) for r in pdf[cols].astype(object).where(pdf[cols].notna(), None).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_names_are_registered_once():
    assert set(ORACLE) <= set(QUERIES)
