import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.test_rules import slow_verdicts
from tests.llm.test_simhash import slow_components, slow_fingerprint
from tidemark.llm import mixing, secrets


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    given = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    verdicts = slow_verdicts(given, 100)
    texts = {i: t for i, t, *_ in given if verdicts[i]}
    comps = slow_components({i: slow_fingerprint(t) for i, t in texts.items()})
    want = {i: secrets.masked(t, "[SECRET]") for i, t in texts.items() if comps[i] == i}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert rows.keys() == want.keys()
    sources = {i: source for i, _, _, source in given}
    mixed = mixing.mix(spark.createDataFrame([(i, t, sources[i]) for i, t in want.items()], "doc_id long, text string, source string"))
    order = [r.doc_id for r in mixed.orderBy(*mixing.order()).collect()]
    assert [r.doc_id for r in sorted(rows.values(), key=lambda r: r.position)] == order and sorted(r.position for r in rows.values()) == list(range(len(order)))
    for i, text in want.items():
        ids = np.array(library.encode(text, add_special_tokens=False).ids, "<u4")
        assert (rows[i].n_tokens, bytes(rows[i].ids)) == (len(ids), ids.tobytes())
        assert rows[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(40), "/root/testdata/sf0.001").schema == docs.schema
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
