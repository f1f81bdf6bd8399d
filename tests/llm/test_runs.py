import hashlib
import random
import zlib
from fractions import Fraction

from tidemark.llm import queries, runs

SF = "/root/testdata/sf0.001"


def slow_runs(words):
    """By comparing every word with the one a period before, for every period."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length, run = j - i + q, words[i : j + q]
            if j > i and length >= max(6, 4 * q) and not any(run[p:] == run[:-p] for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_report(doc_id, text):
    words = [w for w in "".join(" " if c in "\t\n\v\f\r " else c for c in text or "").split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = slow_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digests = (sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digests)


def random_words(rng):
    n, k = rng.choice([0, 1, 5, 6, 7, 12, 30, 60, 120]), rng.choice([1, 2, 3, 5])
    words = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 10)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_random_texts(monkeypatch):
    rng = random.Random(3)
    for alone in (2048, 20):
        monkeypatch.setattr(runs, "ALONE", alone)
        for _ in range(400):
            texts = [random_words(rng) for _ in range(rng.randint(1, 6))]
            assert runs.find_runs([runs.numbered([b"%d" % x for x in t]) for t in texts]) == [slow_runs(t) for t in texts]


def test_repetitive_words():
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 600:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for text in (fibonacci[-1], "ab" * 300, "a" * 500 + "b" * 500, ("aab" * 9 + "c") * 9, "abcabcabcabcabcabab" * 7):
        assert runs.find_runs([runs.numbered([c.encode() for c in text])])[0] == slow_runs(text)


def test_long_text():
    words = [b"%d" % (i % 7001 if i < 60_000 else i) for i in range(200_000)]
    assert runs.find_runs([runs.numbered(words)]) == [[(0, 60_000, 7001)]]


def test_collapsed_words():
    words = "x y a b a b a b a b c".encode().split()
    found = runs.find_runs([runs.numbered(words)])[0]
    assert found == [(2, 8, 2)]
    assert runs.collapsed(words, found) == b"x y a b c".split()


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = queries.op11_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(slow_report(r.doc_id, r.text) for r in docs)


def test_defined_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \n", 0), (4, "a " * 9, 0), (4, "a " * 9, 0), (None, "b c " * 40, 0), (5, "d e\x1cf " * 12 + "g " * 9, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, runs.runs_report(docs).collect())) == sorted(key(slow_report(i, t)) for i, t, _ in rows)
    found = {r.doc_id: r for r in runs.document_runs(docs).collect()}
    assert found[1].runs == [] and found[1].collapsed == "" and found[4].collapsed == "a" and tuple(found[4].runs[0]) == (0, 9, 1)
    assert runs.runs_report(docs.limit(0)).count() == runs.document_runs(docs.limit(0)).count() == 0
