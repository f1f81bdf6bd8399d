"""Small text functions of the connectors: redaction, hashes, names, links, shares."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What is redacted, and with what.
REDACTED = "[REDACTED]"
AUTHORIZATION = r"(?i)(authorization\s*[:=]\s*bearer\s+)[^\s,;]+"
BEARER = r"(?i)(bearer\s+)[A-Za-z0-9._-]+"


#: White space of all scripts, as the inside of a class for Java's and Python's patterns: ``\\s`` is ASCII there or not, as they like.
WHITE = "\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"


def redacted(value: Column, secrets: list[str] = ()) -> Column:
    """Known secrets, authorization headers and bearer tokens replaced."""
    for secret in filter(None, secrets):
        value = F.replace(value, F.lit(secret), F.lit(REDACTED))
    value = F.regexp_replace(value, AUTHORIZATION, f"$1{REDACTED}")
    return F.regexp_replace(value, BEARER, f"$1{REDACTED}")


@F.pandas_udf(StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def compatible(value: Column) -> Column:
    """NFKC, white space squeezed, trimmed. Only texts beyond ASCII go through Python.

    After the squeeze all white space is single spaces, which is what ``trim`` cuts.
    """
    normal = F.when(value.rlike(r"[^\x00-\x7f]"), _nfkc(value)).otherwise(value)
    return F.trim(F.regexp_replace(normal, f"[{WHITE}]+", " "))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


#: One link of a Link header (RFC 8288): a target and parameters with quoted or plain values, in any order.
_LINK = r'<[^>]*>(?:\s*;\s*[^\s=;,]+(?:\s*=\s*(?:"[^"]*"|[^\s;,"]+))?)*'
_LAST = r'(?i);\s*rel\s*=\s*(?:"(?:[^"]*\s)?last(?:\s[^"]*)?"|last(?=\s*(?:;|\z)))'


def page_count(link: Column, found: Column) -> Column:
    """Pages from the page number of a Link header's last page; without one, the rows on the page."""
    links = F.filter(F.regexp_extract_all(link, F.lit(_LINK), 0), lambda one: one.rlike(_LAST))
    page = F.regexp_extract(F.get(links, F.lit(0)), r"[?&]page=([0-9]+)(?=[&#>])", 1).try_cast("long")
    return F.when(found == 0, F.lit(0)).when(page > 0, page).otherwise(found).cast("long")


def shares(counts: Column) -> Column:
    """A map of counts as shares to six places; empty if they add up to nothing."""
    total = F.aggregate(F.map_values(counts), F.lit(0).cast("double"), lambda a, b: a + b)
    return F.when(total > 0, F.transform_values(counts, lambda k, v: F.round(v / total, 6))).otherwise(F.create_map().cast("map<string,double>"))


def compact(number: Column) -> Column:
    """1234 as 1.2K, 5600000 as 5.6M; one place at most."""
    scaled = lambda by, unit: F.concat(F.regexp_replace(F.format_number(number / by, 1), r"\.0\z", ""), F.lit(unit))
    return F.when(number < 1000, number.cast("string")).when(number < 999_950, scaled(1e3, "K")).when(number < 999_950_000, scaled(1e6, "M")).otherwise(scaled(1e9, "B"))


def monday(date: Column) -> Column:
    return F.to_date(F.date_trunc("week", date))


def iso_midnight(date: Column) -> Column:
    return F.date_format(date.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def ordinal(decision: Column) -> Column:
    """A model's decision as a score."""
    return F.when(decision == "ai-related", 1.0).when(decision == "review", 0.5).when(decision == "not-ai", 0.0)
