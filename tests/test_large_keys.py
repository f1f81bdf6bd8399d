"""Queries with SQL on keys and numbers of rows beyond those of the small tables."""

import duckdb
import pytest

from tidemark import catalogue

from .test_oracles import rows_of


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query over a table of parts gives what its SQL gives; the rows are returned."""

    def compare(name: str, parts: str) -> list[tuple]:
        duck = duckdb.connect()
        duck.sql(f"COPY ({parts}) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
        duck.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
        df = catalogue.queries()[name](spark, str(tmp_path))
        got, want = rows_of(df.columns, df.collect()), duck.sql(catalogue.oracle_sql()[name])
        assert got == rows_of(want.columns, want.fetchall())
        return got[1]

    return compare


def test_answers_for_ids_of_other_batches(same):
    """Ids of a million and more are asked for themselves and are also the unknown ids of other batches."""
    rows = same("x4_strict_responses", "SELECT i::BIGINT AS p_partkey FROM (SELECT unnest(range(1, 4000)) UNION ALL SELECT unnest(range(999990, 1004000))) t(i)")
    large = [r for r in rows if r[2] > 1_000_100]  # batch, decision, id, problem
    assert {r[3] for r in large} == {None, "missing", "duplicate", "invalid-decision", "unknown-id"}


def test_model_run_beyond_the_budget(same):
    """10,003 batches of 20: the last three are beyond the budget."""
    [row] = same("a26_model_run", "SELECT i AS p_partkey, 'part ' || i AS p_name FROM range(1, 200061) t(i)")
    columns = sorted(["candidates", "cache_hits", "provider_decisions", "ai_related", "review", "not_ai", "request_failed", "response_invalid", "budget_exhausted", "requests", "adds_up"])
    found = dict(zip(columns, row, strict=True))
    assert found["requests"] == 10_000 and found["budget_exhausted"] == 60 and found["candidates"] == 200_060
