"""Secret scan: keyword automaton, anchored expressions at its hits, checksums inside the tokens.

One Aho-Corasick automaton holds every keyword in all its ASCII spellings, so a text is read once
however many kinds there are. An expression is tried only where a keyword begins, which finds the
same leftmost matches as searching the whole text, since each of them starts with a keyword. Long
hexadecimal runs have no keyword; for them a single linear expression reads the text. Provider tokens
that carry a CRC32 of their own are reported only if it holds.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import by_batch, id_text, small_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")

KEYWORDS = {
    "assign": ["password", "passwd", "secret", "token", "apikey", "api_key"],
    "access": ["AKIA"],
    "github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "npm": ["npm_"],
}
#: The contract's kinds, in its order, before those of the method.
KINDS = ["assign", "access", "hex", "github", "npm"]
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            spellings = product(*({c, c.upper()} for c in word)) if kind == "assign" else [word]
            for spelling in spellings:
                made.add_word("".join(spelling), (kind, len(word)))
    made.make_automaton()
    return made


def checksum(body: str) -> str:
    """CRC32 of the random part as six base-62 digits."""
    rest, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        rest, digit = divmod(rest, 62)
        digits = BASE62[digit] + digits
    return digits


def _valid(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[2]) >= 8
    if kind == "access":
        return len(match[0]) >= 16
    return checksum(match[1]) == match[2]


def find_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, by start, then kind as listed."""
    found, after = [], {}
    expression = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM}
    for start, kind in sorted((end + 1 - n, kind) for end, (kind, n) in automaton().iter(text)):
        if start >= after.get(kind, 0) and (match := expression[kind].match(text, start)):
            after[kind] = match.end()  # a match that fails the test still hides what it covers
            if _valid(kind, match):
                found.append((start, kind, match.end()))
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans``, one row for each row of ``docs``.

    A null or empty text has no spans; repeated rows give repeated results; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("spans", _SPAN_TYPE)])

    def scan(batch: pa.RecordBatch) -> dict:
        spans = [[{"kind": k, "start": s, "end": e} for s, k, e in find_spans(t)] for t in batch["text"].to_pylist()]
        return {"doc_id": batch["doc_id"], "spans": spans}

    return id_text(docs).mapInArrow(by_batch(scan, schema), f"doc_id long, spans {SPANS}")


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan_secrets(docs).select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


def masked(text: str, mask: str) -> str:
    """``text`` with each stretch of overlapping spans replaced by ``mask``."""
    out, at = [], 0
    for start, _, end in find_spans(text):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret masked in ``text``; ``n_chars`` follows where it is a column.

    Texts without secrets, null texts and all other columns stay as they are; repeated rows are masked alike,
    and an empty table stays empty.
    """

    def redact(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [t if t is None else masked(t, mask) for t in batch["text"].to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = small_batches(docs).mapInArrow(redact, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
