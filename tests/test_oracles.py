"""Every query with a SQL counterpart, against DuckDB."""

import os
from decimal import Decimal
from math import isclose

import duckdb
import pytest

from tidemark import catalogue

SF = "/root/testdata/sf0.01"
TABLES = [f.removesuffix(".parquet") for f in os.listdir(SF)]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(value):
    return float(value) if isinstance(value, Decimal) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    out = [tuple(plain(r[k]) for k in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple(f"{x:.5g}" if isinstance(x, float) else str(x) for x in r))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    want = duck.sql(catalogue.oracle_sql()[name])
    columns, rows = rows_of(want.columns, want.fetchall())
    assert got[0] == columns
    assert len(got[1]) == len(rows)
    for a, b in zip(got[1], rows, strict=True):
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert (isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) if isinstance(x, float) and isinstance(y, float) else x == y and type(x) is type(y)), (a, b)


def test_queries_without_sql(spark):
    for name in catalogue.queries().keys() - catalogue.oracle_sql().keys():
        assert catalogue.queries()[name](spark, SF).count() >= 0
