import hashlib
import random
import re

import duckdb

from tidemark.llm import secrets

KINDS = [
    ("assign", re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def base(text):
    found = [(m.start(), k, name, m.end()) for k, (name, pattern, good) in enumerate(KINDS) for m in pattern.finditer(text) if good(m)]
    return [(s, name, e) for s, _, name, e in sorted(found)]


def own(text):
    return [s for s in secrets.find_spans(text) if s[1] in ("assign", "access", "hex")]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


def test_random_texts():
    rng = random.Random(1)
    pieces = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "apitoken", "secretoken", "=", ":", " ", '"', "'", "abcdefgh", "x" * 9, "AKIA", "AKIAABCDEFGH1234", "0123456789abcdef", "deadbeef" * 4, "é", "ſecret", "toKen", "\n", "a1", "-", "/"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 25)))
        assert own(text) == base(text), text


def test_checksums_decide():
    body = "abcdefghijklmnopqrstuvwxyz0123"
    good, bad = body + secrets.checksum(body), body + "000000"
    text = f"ghp_{good} ghp_{bad} npm_{good} xghs_{good}z"
    assert [s[1] for s in secrets.find_spans(text)] == ["github", "npm"]
    assert secrets.masked(text, "#") == f"# ghp_{bad} # xghs_{good}z"


def test_documents(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = {r.doc_id: r for r in secrets.secret_report(spark.read.parquet(path)).collect()}
    for i, text in duckdb.sql(f"select doc_id, text from '{path}'").fetchall():
        spans = base(text)
        r = rows[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == digest(spans)


def test_rows_and_redaction(spark):
    docs = spark.createDataFrame(
        [(1, None, "x", 0), (2, "", "y", 0), (3, "my token = abcdefgh1 and more", "z", 29), (3, "my token = abcdefgh1 and more", "z", 29), (None, "plain", None, 5)],
        "doc_id long, text string, spans string, n_chars long",
    )
    assert sorted((r.doc_id or 0, r.spans) for r in secrets.secret_report(docs).collect()) == [(0, ""), (1, ""), (2, ""), (3, "assign:3:20"), (3, "assign:3:20")]
    out = secrets.redact_secrets(docs)
    assert out.schema == docs.schema
    assert sorted((r.doc_id or 0, r.text, r.n_chars) for r in out.collect() if r.text) == [(0, "plain", 5)] + [(3, "my [SECRET] and more", 20)] * 2
    assert secrets.secret_report(docs.limit(0)).count() == 0 and secrets.redact_secrets(docs.limit(0)).count() == 0
