import hashlib
import random
import time

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe

VOCABULARY = "byte_bpe_50k.json"
LIBRARY = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))

ODD = [
    "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "\n\na", "x  y", "x　 y z", "tab\t\tx", "it's he'll I'M 'tis", "a.b 3.14 10%%", "é́ à la carte",
    "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "日本語のテキスト 中文", "😀 😀😀", "a\x1c b\x85 c", "x" * 5000, "ab" * 9000 + " end", "1" * 4000, "!" * 3000 + "a", " " * 3000 + "a" + " " * 500,
    "ñandú" * 3000, "字" * 9000, "a" * 8000 + "<|endoftext|>" + "b" * 8000,
]


def library(text: str) -> list[int]:
    return LIBRARY.encode(text, add_special_tokens=False).ids


def own(text: str, leaf: int) -> list[int]:
    e = bpe.encoder(VOCABULARY)
    leaves = e.leaves(text, leaf)
    assert "".join(leaves) == text
    parts = [(t, np.frombuffer(i, "<u4")) for t, i in zip(leaves, e.encode_many(leaves), strict=True)]
    return e.concatenate(parts).tolist()


@pytest.mark.parametrize("k", range(len(ODD)))
def test_odd_texts(k):
    text = ODD[k]
    for leaf in (7, 64, 1000, 10**6):
        assert own(text, leaf) == library(text)
    assert bpe.decode(np.array(library(text), "<u4").tobytes(), bpe.vocabulary_path(VOCABULARY)) == LIBRARY.decode(library(text), skip_special_tokens=False)


def test_random_texts():
    rng = random.Random(7)
    alphabets = ["ab", "the in of ing tion", "aé ñ'stl. \n", "01 a.", "xyz<|endoftext|> ", "’'s \t\r\n", "日本 a語"]
    for _ in range(400):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(1, 300)))
        assert own(text, rng.choice([3, 10, 40])) == library(text)


def test_unbroken_runs_of_letters():
    rng = random.Random(8)
    syllables = ["tion", "ing", "er", "th", "un", "a", "e", "qu", "str", "ab"]
    for _ in range(12):
        text = "".join(rng.choice(syllables) for _ in range(6000))
        assert own(text, 5000) == library(text)


def test_contractions_and_white_space_at_every_cut():
    rng = random.Random(9)
    alphabets = ["'lrve ", "ab", " \n\t\u3000\xa0", "!?'\"", "xyz<|endoftext|>", "\x1c\x85 b", "\u0663\u09e72 x", "\u13e3\u1c90\U0001e900 \U0001f600"]
    for _ in range(800):
        some = rng.sample(alphabets, rng.randint(1, 4))
        text = "".join(rng.choice(rng.choice(some)) for _ in range(rng.randint(1, 200)))
        assert own(text, rng.choice([1, 2, 3, 10])) == library(text)


def test_joins_take_time_in_proportion():
    """Texts of 2 MB, some without any certain boundary; once the library has read them, joins take no longer."""
    rng, n = random.Random(10), 2_000_000
    mixed = "".join(rng.choice("!?.,;#") for _ in range(n))
    for text in ("<|endoftext|>" * (n // 13), "a" * n, "x, " + "a" * n, "!" * n, mixed, " " * n, "字、" * (n // 10), "word " * (n // 5)):
        want, begin = library(text), time.monotonic()
        assert own(text, bpe.LEAF) == want
        assert time.monotonic() - begin < 30


def test_documents(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(path)
    rows = {r.doc_id: r for r in bpe.encoding_report(docs).collect()}
    texts = dict(duckdb.sql(f"select doc_id, text from '{path}'").fetchall())
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        ids = library(text)
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_nulls_repeats_and_long_rows(spark):
    long = "word " * 9000 + "x" * 40000
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, long, "c"), (3, long, "d"), (None, "hi there", "e"), (None, long, "f")], "doc_id long, text string, ids string")
    rows = sorted((r.doc_id or 0, bytes(r.ids)) for r in bpe.encode_documents(docs, leaf=1000).collect())
    want = lambda t: np.array(library(t), "<u4").tobytes()
    assert len(rows) == 6
    assert rows == sorted([(1, b""), (2, b""), (3, want(long)), (3, want(long)), (0, want("hi there")), (0, want(long))])


def test_no_documents(spark):
    assert bpe.encoding_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
