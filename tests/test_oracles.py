"""Every query with SQL is held against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from loomtext.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "events documents pages benchmark conversations labels".split()


def cell(v):
    if v is None or (pd.api.types.is_scalar(v) and pd.isna(v)):
        return "NULL"
    if isinstance(v, float) or (hasattr(v, "dtype") and v.dtype.kind in "iuf"):
        return str(int(v)) if v == int(v) else repr(float(v))
    return str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(cell(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0
