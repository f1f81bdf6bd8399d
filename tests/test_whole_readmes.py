"""Queries over keywords read whole READMEs, against their SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark import catalogue

NAMES = ["a14_observations", "a15_census", "a18_related_counts", "a19_primary_community", "a20_communities", "f11_signals", "f16_evidence", "f16_score", "f17_confidence", "f19_label", "f9_compounds", "j13_district", "o3_census_top", "o5_community_order", "p19_readme_needed", "p9_related"]


@pytest.fixture(scope="module")
def long_texts(tmp_path_factory):
    """Documents of which most have the keywords that decide behind the first 12,000 characters of their README."""
    folder = tmp_path_factory.mktemp("long")
    filler, late = "x1 " * 4100, ["the ai of-the llm-de", "by and de la ing-tools", "ai ai-agents vision-of", "la in the rag-parts the-de"]
    texts = [f"one two\nplain {('words', 'the')[k % 2]}\n{filler}{late[k % 4]} w{k}-the" if k % 5 else f"topic{k} the\nby and\nshort" for k in range(60)]
    pq.write_table(pa.table({"doc_id": pa.array(range(60), pa.int64()), "text": texts}), f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_what_stands_late_is_found(spark, long_texts, name):
    sql = catalogue.oracle_sql()[name]
    assert "12000" not in sql
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{long_texts}/documents.parquet'")
    want = duck.sql(sql)
    found = catalogue.queries()[name](spark, long_texts).select(*want.columns).collect()
    whole = sorted(want.fetchall(), key=str)
    assert sorted(map(tuple, found), key=str) == whole != []
    cut = sql.replace("array_to_string(lines[3:], chr(10)) AS readme", "substr(array_to_string(lines[3:], chr(10)), 1, 12000) AS readme")
    assert sorted(duck.sql(cut).fetchall(), key=str) != whole, "the texts tell a cut from none"
