import duckdb

from tests.test_oracles import SF, TABLES, rows_of
from tidemark.llm import queries


def test_queries_against_sql(spark):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        want = connection.sql(sql)
        assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())
        assert [x for _, x in sorted(zip(df.columns, [t for _, t in df.dtypes]))] == [{"BIGINT": "bigint", "BOOLEAN": "boolean", "INTEGER": "int"}[str(t)] for _, t in sorted(zip(want.columns, want.types))]
