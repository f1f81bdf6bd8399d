import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import lexical
from tidemark.scratch import saved

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def slow_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow_search(docs, items, top=10):
    """Rows (item_id, rank, doc_id, score) by scoring every document for every item."""
    counted = [(i, Counter(slow_terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, tokens = len(counted), sum(c.total() for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c in counted:
            m = 100 - 90 + (90 * c.total() * n_docs) // tokens
            score = 0
            for w in set(slow_terms(text)) & c.keys():
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m))
            if score > 0 and doc_id is not None:
                scored.append((-score, doc_id))
        out += [(item_id, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scored)[:top])]
    return out


key = lambda r: tuple(map(str, r))


def found(spark, docs, items, shard=lexical.SHARD, **more):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.search(saved(lexical.index_documents(docs, shard), "index"), items, **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(key, got.collect()))


@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 300)))
@settings(deadline=None)
def test_packed_numbers(values):
    data, end = lexical.packed(np.array(values, np.uint64))
    assert lexical.unpacked(data.tobytes()).view(np.uint64).tolist() == values and len(end) == len(values)


def test_merge_finds_the_best():
    rng = random.Random(5)
    for _ in range(600):
        n, k = rng.randint(1, 60), rng.randint(1, 6)
        lists, score = [], defaultdict(int)
        for _ in range(rng.randint(1, 7)):
            docs = sorted(rng.sample(range(n), rng.randint(1, n)))
            gain = [rng.randint(0, rng.choice([1, 5, 40])) for _ in docs]
            lists.append((np.array(docs), np.array(gain), max(gain)))
            for d, g in zip(docs, gain):
                score[d] += g
        best, ids = lexical.Best(k), np.arange(n) * 3 - 50
        for low in range(0, n, 20):  # shard after shard
            part = []
            for docs, gain, _ in lists:
                own = (docs >= low) & (docs < low + 20)
                if own.any():
                    part.append((docs[own] - low, gain[own], int(gain[own].max())))
            lexical.merge(part, ids[low : low + 20], best)
        want = sorted(((s, -(3 * d - 50)) for d, s in score.items() if s > 0), reverse=True)[:k]
        assert sorted(best.heap, reverse=True) == want


def test_random_documents(spark):
    rng = random.Random(1)
    words = [*"abcdefgh", "Äb", "ß", "word", "Word9", "x-y", "日本"]
    text = lambda most: rng.choice([" ", "\x7f", "_", ", "]).join(rng.choice(words[: rng.choice([3, 14])]) for _ in range(rng.randint(0, most)))
    docs = [(i - 40, text(30)) for i in range(300)] + [(7, "a b c"), (7, "a b c"), (7, "a b c"), (1000, None), (None, "a word"), (1001, "")]
    items = [(i, text(12)) for i in range(40)] + [(3, "a a b"), (3, "a a b"), (None, "word"), (50, None), (51, "unheard")]
    want = sorted(map(key, slow_search(docs, items)))
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, shard=60, per_block=7) == want
    assert found(spark, docs, items, shard=1, per_block=7, top=3) == sorted(map(key, slow_search(docs, items, 3)))


def test_terms_too_many_to_send(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BROADCAST", 0)
    docs, items = [(i, f"w{i % 7} w{i % 5} w{i}") for i in range(100)], [(i, f"w{i} w{i + 1} w{50 + i}") for i in range(9)]
    assert found(spark, docs, items) == sorted(map(key, slow_search(docs, items)))


def test_empty_tables_and_other_columns(spark):
    assert found(spark, [], [(1, "a")]) == found(spark, [(1, "a")], []) == found(spark, [(1, None)], [(1, None)]) == []
    docs = spark.createDataFrame([(1, "a b", "s", 2), (2, "b", "t", 3)], "doc_id long, text string, shard string, term long")
    items = spark.createDataFrame([(5, "A", 1.0)], "item_id long, text string, score double")
    got = lexical.search_report(docs, items).collect()
    assert [tuple(r) for r in got] == slow_search([(1, "a b"), (2, "b")], [(5, "A")])
