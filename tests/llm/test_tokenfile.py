import io
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, tokenfile
from tidemark.llm.shared import new_path

VOCABULARY = "word_bpe_49k.json"
LIBRARY = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))

ODD = ["", " ", "\n", "a", "It's  A\tTEST\n", "x　y\xa0z \xa0 w", "<|endoftext|> a<|startoftext|>b", "日本語 テキスト", "é́ e ́a", "ΣΑΣ'Α ΟΔΟΣ. İstanbul", "a\x1cb \x1c c\x0bd\x0ce", "3.14%%% don't 'tis we'll", "ﬁ ½ ² x²y", "word*** word### | a|b", "\x00 \x7f \x85x", "-" * 700 + "a" * 700]


def library(text: str) -> bytes:
    return np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_words_as_the_library():
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab'.é 1\n　Σ<|>́") for _ in range(rng.randint(1, 60))) for _ in range(600)]
    assert bpe.word_encoder(VOCABULARY).encode_many([t.encode() for t in texts]) == [library(t) for t in texts]


@pytest.mark.parametrize("width,sizes", [(2, [0, 1, 5, tokenfile.CHUNK - 6, 3, 2 * tokenfile.CHUNK + 1, 0, 9]), (4, [1]), (4, []), (2, [tokenfile.CHUNK])])
def test_round_trip(width, sizes, monkeypatch):
    monkeypatch.setattr(tokenfile, "TABLE", 3)
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 1 << (8 * width), n, dtype=np.uint64).astype("<u4") for n in sizes]
    out = io.BytesIO()
    writer = tokenfile.TokenWriter(out, width)
    for k, ids in enumerate(docs):
        writer.append(k if k else None, ids)
    writer.close()
    reader = tokenfile.TokenReader(pa.BufferReader(out.getvalue()))
    back = list(reader.each())
    assert [b[0] for b in back] == [k or None for k in range(len(docs))]
    assert all((a == b[2]).all() for a, b in zip(docs, back, strict=True))
    every = np.concatenate([*docs, np.zeros(0, "<u4")])
    for start, n in ((0, len(every)), (len(every) // 3, len(every) // 2), (0, 0)):
        assert (reader.ids(start, n) == every[start : start + n]).all()


def test_damage_is_found():
    out = io.BytesIO()
    writer = tokenfile.TokenWriter(out)
    writer.append(1, np.arange(1000, dtype="<u4"))
    writer.close()
    raw = bytearray(out.getvalue())
    raw[14] ^= 255
    with pytest.raises(Exception):
        list(tokenfile.TokenReader(pa.BufferReader(bytes(raw))).each())


def test_documents(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    rows = {r.doc_id: r for r in tokenfile.token_file_report(spark.read.parquet(path)).collect()}
    start = 0
    for i, text in duckdb.sql(f"select doc_id, text from '{path}' order by doc_id").fetchall():
        ids = library(text) + np.array([1], "<u4").tobytes()
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


def test_nulls_repeats_and_none(spark):
    docs = spark.createDataFrame([(5, "b c", 1), (5, "b c", 2), (2, None, 3), (None, "a", 4), (7, "", 5)], "doc_id long, text string, start int")
    rows = sorted(((r.start, r.doc_id, r.n_tokens) for r in tokenfile.token_file_report(docs).collect()))
    assert rows == [(0, None, 2), (2, 2, 1), (3, 5, 3), (6, 5, 3), (9, 7, 1)]
    assert tokenfile.token_file_report(docs.limit(0)).count() == 0


def test_files_roll(spark):
    """Small files give what large ones give; a text of a million words is one document."""
    long = "Word é, two. " * 350_000
    docs = spark.createDataFrame([(i, "a b c " * (i % 9), "x") for i in range(300)] + [(300, long, "y")], "doc_id long, text string, part string").coalesce(1)
    folder = new_path(spark, "tokens")
    files = tokenfile.write_token_files(docs, folder, parts=2, roll=500)
    assert files.count() > 6
    start = 0
    for r in sorted(tokenfile.read_token_files(files, folder).collect(), key=lambda r: r.doc_id):
        ids = library(long if r.doc_id == 300 else "a b c " * (r.doc_id % 9)) + np.array([1], "<u4").tobytes()
        assert (r.start, bytes(r.ids)) == (start, ids)
        start += len(ids) // 4


def test_ranges_follow_the_size(spark, monkeypatch, tmp_path):
    from tidemark.llm import media, shared

    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [shared.ranges_for(spark, n) for n in (None, 0, shared.RANGE_BYTES, 100 * shared.RANGE_BYTES + 1)] == [least, least, least, 101]
    monkeypatch.setattr(shared, "RANGE_BYTES", 100)
    docs = spark.createDataFrame([(i, "word " * 20) for i in range(60)], "doc_id long, text string")
    files = tokenfile.write_token_files(docs, "file://" + str(tmp_path / "ids"))
    assert files.count() > 4 * least
    index = spark.createDataFrame([("s", i * 50, 50) for i in range(100)], "shard string, offset long, length long")
    assert media.by_shard(index).rdd.getNumPartitions() == 50
