"""The pipeline's result tells the mix."""

import corpus_pipeline
import pytest

from tidemark.llm import mixing
from tidemark.llm.bpe import LEAF


@pytest.fixture
def many_files(spark):
    """Several files, read in several splits."""
    own = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "200k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_positions_follow_the_schedule(spark, many_files, monkeypatch, tmp_path):
    sf = "/root/testdata/sf0.01"
    monkeypatch.setattr(mixing.mixed_documents, "__defaults__", (None, 5000))
    docs = spark.read.parquet(f"{sf}/documents.parquet").dropDuplicates(["doc_id"])
    given = tmp_path / "given"
    corpus_pipeline.mix_sources(spark, docs, sf).write.parquet(str(given))
    assert len(list(given.glob("part-*"))) > 1
    order = {r.doc_id: (r.slot, r.hash % 2**64 >> 1, r.hash) for r in mixing.mix(docs, block=5000).collect()}
    assert docs.filter(f"length(text) > {LEAF}").count() > 0
    rows = sorted(corpus_pipeline.encode(spark, spark.read.parquet(str(given)), sf).select("doc_id", "position").collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(len(order)))
    got = [order[r.doc_id] for r in rows]
    assert got == sorted(order.values())
