"""Documents of every version: written, read back equal, dispatched, refused."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructType

from tidemark.sources import documents


def value(rng, kind, depth=0):
    """A random value of a type; some are null."""
    if depth and rng.random() < 0.15:
        return None
    if isinstance(kind, StructType):
        return {f.name: value(rng, f.dataType, depth + 1) for f in kind}
    if isinstance(kind, ArrayType):
        return [value(rng, kind.elementType, depth + 1) for _ in range(rng.randint(0, 3))]
    if isinstance(kind, MapType):
        return {k: value(rng, kind.valueType, depth + 1) for k in rng.sample(["core", "search", "Ä"], rng.randint(0, 3))}
    return {StringType: rng.choice(["", "plain", 'q"\\\n\x01', "日本 😀"]), LongType: rng.randint(-9, 2**53), IntegerType: rng.randint(0, 999), BooleanType: rng.random() < 0.5, DoubleType: rng.choice([0.5, 3.0, 1e-7, 1e21, 0.1])}[type(kind)]


@pytest.mark.parametrize("version", documents.SCHEMAS)
def test_written_and_read_back(spark, tmp_path, version):
    kind, rng = spark.createDataFrame([], documents.SCHEMAS[version]).schema, random.Random(version)
    rows = [value(rng, kind) | {"schema_version": version} for _ in range(5)]
    df = spark.createDataFrame([{**r, "name": f"{k}.json"} for k, r in enumerate(rows)], kind.add("name", "string"))
    documents.write(df, str(tmp_path / "docs"), version)
    assert sorted(p.name for p in (tmp_path / "docs").iterdir()) == [f"{k}.json" for k in range(5)]
    text = (tmp_path / "docs" / "2.json").read_text()
    assert json.loads(text) == rows[2] and text.startswith('{\n  "schema_version"') and text.endswith("}\n")
    back = documents.read(spark, str(tmp_path / "docs"), version)[version]
    want = [r.asDict(True) for r in df.drop("name").collect()]
    got = {r.pop("path").rpartition("/")[2]: r for r in (r.asDict(True) for r in back.collect())}
    assert [got[f"{k}.json"] for k in range(5)] == want
    with pytest.raises(Exception, match="FileExistsError"):
        documents.write(df, str(tmp_path / "docs"), version)


def test_dispatch(spark, tmp_path):
    """Each version gets its own columns; fields that an old document lacks are null, unknown ones are ignored."""
    (tmp_path / "a.json").write_text(json.dumps({"schema_version": "city-v1", "period": "weekly", "later": 1, "source": {"coverage_complete": True}, "repositories": [{"repository_id": 7}]}))
    (tmp_path / "b.json").write_text(json.dumps({"schema_version": "candidate-v1", "source": {"hours_collected": 3}}, indent=1))
    found = documents.read(spark, str(tmp_path))
    city, candidate = found["city-v1"].collect(), found["candidate-v1"].collect()
    assert len(city) == len(candidate) == 1 and found["snapshot-v1"].count() == 0
    assert city[0].repositories[0].repository_id == 7 and city[0].repositories[0].detection_explanation is None and city[0].source.archive_coverage_complete is None
    assert candidate[0].source.hours_collected == 3 and candidate[0].source.event_integrity is None and candidate[0].repositories is None
    with pytest.raises(Exception, match="expected city-v1, found candidate-v1"):
        documents.read(spark, str(tmp_path), "city-v1")["city-v1"].collect()


@pytest.mark.parametrize("text,message", [('{"schema_version": "city-v2"}', "unknown version city-v2"), ("{}", "unknown version none"), ('{"schema_version": "city-v1"', "not JSON"), ("", "not JSON"), ('{"schema_version": "city-v1", "window": 3}', "(?i)cast")])
def test_refused(spark, tmp_path, text, message):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match=message):
        documents.read(spark, str(tmp_path))["city-v1"].collect()


def test_lists_are_bounded(spark, monkeypatch):
    rows = spark.range(5).select("id", (-F.col("id")).alias("n"))
    assert [r.n for r in documents.listed(rows, {"n": F.col("n")}, [F.col("n")], "all").first()["all"]] == [-4, -3, -2, -1, 0]
    monkeypatch.setattr(documents, "LIMIT", 4)
    with pytest.raises(Exception, match="more than 4 all"):
        documents.listed(rows, {"n": F.col("n")}, [F.col("n")], "all").collect()
