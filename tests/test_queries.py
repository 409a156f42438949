"""Each registered query of the engine against its SQL in DuckDB."""

from decimal import Decimal
from pathlib import Path

import pytest

import __spark_entry__
from plumbline.queries import QUERIES, SQL, TABLES

DATA = Path("/root/testdata/sf0.001")


def plain(x):
    if isinstance(x, float | Decimal):
        return round(float(x), 5)
    return x


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, str(DATA))
    want = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert normal(df.columns, df.collect()) == normal(want.columns, want.fetchall())


def test_entry(spark):
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())
