"""Every catalogue query against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from rollview import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None else round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, con, name):
    df = catalog.queries()[name](spark, sf_dir)
    found = con.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(found.columns)
    at = [found.columns.index(c) for c in df.columns]
    ours = sorted((tuple(map(plain, r)) for r in df.collect()), key=str)
    theirs = sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=str)
    assert ours == theirs


def test_entry_imports_without_llm():
    import __spark_entry__

    assert "tumble_5m_ohlcv" in __spark_entry__.queries()
    assert os.path.exists(__spark_entry__.__file__)
