"""Very long texts, nulls in any column, repeated rows, ties, empty tables and clashing names, for operators and stages together."""

import hashlib

import corpus_pipeline
import numpy as np
import pytest

from tests.llm.test_bpe import LIBRARY
from tests.llm.test_secrets import base, digest
from tidemark.llm import bpe, crf, licenses, media, mixing, rules, secrets, simhash, tokenfile, toxicity

WORDS = " ".join(f"wort{i % 5003} grün{i}" for i in range(120_000))
LONG = f"{WORDS}\npassword = abcdefgh1 {licenses.TEMPLATES['GPL-3.0-statement']}\n" + "last line here, " * 3
NAMES = ["row", "i", "n", "range", "size", "hash", "slot", "start", "block", "label", "u", "x", "at", "w", "score", "spans", "matches", "ids", "leaf", "digest", "shard", "part", "file", "position", "kept", "fp"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "de", "a"), (2, LONG, "de", "a"), (3, None, None, None), (4, "", "en", None), (4, "", "en", None), (None, "no id here", None, "b"), (5, " \n\t ", "en", "b")]
    fields = "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in NAMES)
    return spark.createDataFrame([(*r, *NAMES[:-1], None) for r in rows], fields).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, None), (3, 0, 1), (4, None, 1), (None, 0, 0), (99, 1, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")


IDS = [0, 1, 2, 3, 4, 4, 5]


def ids_of(df):
    return sorted(r.doc_id or 0 for r in df.collect())


def test_secrets(docs):
    rows = secrets.secret_report(docs).collect()
    assert sorted(r.doc_id or 0 for r in rows) == IDS
    assert all((r.n_assign, r.base_sha256) == ((1, digest(base(LONG))) if r.doc_id in (1, 2) else (0, digest([]))) for r in rows)
    masked = secrets.redact_secrets(docs)
    assert masked.schema == docs.schema and {r.text[-200:].count("abcdefgh1") for r in masked.collect() if r.doc_id in (1, 2)} == {0}


def test_encoding(docs):
    want = np.array(LIBRARY.encode(LONG, add_special_tokens=False).ids, "<u4").tobytes()
    rows = bpe.encoding_report(docs).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows if r.doc_id in (1, 2, 3, 4, 5)) == [(1, len(want) // 4), (2, len(want) // 4), (3, 0), (4, 0), (4, 0), (5, len(LIBRARY.encode(" \n\t ", add_special_tokens=False).ids))]
    assert {r.ids_sha256 for r in rows if r.doc_id in (1, 2)} == {hashlib.sha256(want).hexdigest()}


def test_models(docs, labels):
    for scores in (crf.quality_scores(docs, labels), toxicity.toxicity_scores(docs, labels)):
        rows = scores.collect()
        assert sorted(r.doc_id or 0 for r in rows) == IDS and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1 == len({r.score for r in rows if r.doc_id in (3, 4)})


def test_media_mixing_and_files(docs):
    assert ids_of(media.media_report(docs)) == IDS
    rows = mixing.mix_report(docs).collect()
    assert sorted(r.doc_id or 0 for r in rows) == IDS
    assert sorted(r.block for r in rows if r.source == "a") == [0, 1] and {r.block for r in rows if r.source is None} == {0}
    files = sorted(tokenfile.token_file_report(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id or 0 for r in files] == IDS and all(b.start == a.start + a.n_tokens for a, b in zip(files, files[1:], strict=False))


def test_near_duplicates_rules_and_licenses(docs):
    assert sorted((r.doc_id or 0, r.component_id) for r in simhash.fingerprint_report(docs).collect())[1:] == [(1, 1), (2, 1), (3, 3), (4, 3), (4, 3), (5, 3)]
    assert ids_of(simhash.drop_near_duplicates(docs)) == [0, 1, 3]
    assert sorted((r.doc_id or 0) for r in rules.quality_verdicts(docs).collect() if r.kept) == [1, 2]
    assert sorted((r.doc_id or 0, r.licenses) for r in licenses.license_report(docs).collect() if r.n_matches) == [(1, "GPL-3.0-statement"), (2, "GPL-3.0-statement")]


def test_empty_tables(docs, labels):
    none = docs.limit(0)
    for df in (secrets.secret_report(none), bpe.encoding_report(none), crf.quality_scores(none, labels.limit(0)), media.media_report(none), mixing.mix_report(none), simhash.fingerprint_report(none),
               rules.quality_verdicts(none), tokenfile.token_file_report(none), licenses.license_report(none), toxicity.toxicity_scores(none, labels)):
        assert df.count() == 0


def test_stages(spark, docs, tmp_path):
    """Whole stages over these rows, each written and read again: columns stay, and one copy of the long text comes out, masked."""
    kept = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, "")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.schema == docs.schema
        out.write.parquet(str(tmp_path / str(k)))
        kept = spark.read.schema(out.schema).parquet(str(tmp_path / str(k)))
    (row,) = kept.collect()
    text = LONG.replace("password = abcdefgh1", "[SECRET]")
    assert (row.doc_id, row.position, row.decoded_sha256) == (1, 0, hashlib.sha256(text.encode()).hexdigest())
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, "").count() == 0
