"""Keywords: normal forms and tests as column expressions, extraction from texts as an Arrow pass.

White space is that of all scripts (``text.WHITE``), other classes are ASCII: word boundaries are look-arounds, since Java's own also see letters of
other scripts. Extraction looks at every token of every text; as expressions this took ten times as
long, so a vectorized function does it with one compiled pattern for each step and a memory of tokens.
So do normal forms, whose five patterns the engine repeated for each alias.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .lexicon import Lexicon
from .text import WHITE

# The token pattern, and the normal forms below.
TOKEN = "[a-z0-9]+(?:-[a-z0-9]+)*"
_WORD = "[A-Za-z0-9_]"
#: Tokens that a worker remembers, and their greatest length.
REMEMBERED, SHORT = 1 << 16, 64
#: Where keywords are looked for.
SOURCES = ("topics", "description", "readme")


def _words(words) -> Column:
    return F.array(*(F.lit(w) for w in sorted(words))) if words else F.array().cast("array<string>")


_KEPT, _SPACES = b"abcdefghijklmnopqrstuvwxyz0123456789-", b"\t\n\x0b\f\r _/"
_HYPHENS = bytes.maketrans(_SPACES, b"-" * len(_SPACES))
_GONE = bytes(set(range(256)) - set(_KEPT + _SPACES))
_SPACED = bytes(b if b in _KEPT else 32 for b in range(256))
_WIDE, _RUN = re.compile(f"[{WHITE}]"), re.compile(b"--+")


def normal_form(text: str) -> str:
    """Lower case with hyphens for white space, slashes and underscores; other characters go."""
    text = text.lower()
    if not text.isascii():
        text = _WIDE.sub("-", text)
    return _RUN.sub(b"-", text.encode("ascii", "ignore").translate(_HYPHENS, _GONE)).strip(b"-").decode("ascii")


def normalized(value: Column, lexicon: Lexicon) -> Column:
    """The normal form with aliases resolved; null stays null."""
    aliases = lexicon.aliases

    @F.pandas_udf(StringType())
    def normalize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            forms = (None if t is None else normal_form(t) for t in texts)
            yield pd.Series([aliases.get(f, f) for f in forms], dtype=object)

    return normalize(value)


def searchable(text: Column) -> Column:
    """Camel case split, lower case, links gone, underscores and slashes as hyphens."""
    text = F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1-$2"))
    return F.regexp_replace(F.regexp_replace(text, f"https?://[^{WHITE}]+", " "), "[_/]+", "-")


def is_signal(keyword: Column, lexicon: Lexicon) -> Column:
    return keyword.isin(*lexicon.signals) | F.arrays_overlap(F.split(keyword, "-"), _words(lexicon.signal_parts)) | keyword.startswith(lexicon.signal_prefix)


def is_compound(keyword: Column, lexicon: Lexicon) -> Column:
    """Two or three parts of two letters or more, none a stopword, the first ``ai`` or one an anchor."""
    parts = F.split(keyword, "-")
    anchored = (parts[0] == "ai") | F.arrays_overlap(parts, _words(lexicon.anchors))
    good = F.forall(parts, lambda p: (F.length(p) >= 2) & ~p.isin(*lexicon.stopwords))
    return keyword.contains("-") & ~keyword.rlike("[0-9]") & F.size(parts).between(2, 3) & anchored & good


def is_modifier(keyword: Column, lexicon: Lexicon) -> Column:
    return keyword.rlike(r"^[a-z]{3,}\z") & ~keyword.isin(*(lexicon.stopwords | lexicon.generic | lexicon.anchors))


class _Known(dict):
    """What has been worked out for short words: the word's own result, or an empty text."""

    def __init__(self, of: Callable[[str], str]):
        self.of = of

    def __missing__(self, word: str) -> str:
        found = self.of(word)
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


class Extractor:
    """Keywords of texts and how often each is there: phrases, tokens (signals and useful compounds) and bigrams (a modifier before a flexible suffix)."""

    # The capital comes first in its pattern: patterns that begin with a plain class are searched fast.
    _CAMEL, _LINK, _JOIN = re.compile("[A-Z](?<=[a-z0-9].)"), re.compile(f"https?://[^{WHITE}]+"), re.compile("[_/]+")

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.aliases = lexicon, lexicon.aliases
        self.known, self.named = _Known(self._of_token), _Known(self._of_topic)
        self.suffixes = {s for s in lexicon.suffixes if s not in lexicon.aliases} | {a for a, k in lexicon.aliases.items() if k in lexicon.suffixes}
        self.never = lexicon.stopwords | lexicon.generic | lexicon.anchors
        #: The words without a hyphen that are keywords: others must be compounds.
        self.single = {w for w in lexicon.signals | self.aliases.keys() if "-" not in w and self._of_token(w)}
        self.phrases = []
        for phrase in lexicon.phrases:
            first, *rest = map(re.escape, phrase.split(" "))  # a pattern that begins with a plain word is searched fast
            pattern = re.compile("[ -]+".join([f"{first}(?<!{_WORD}{first})", *rest]) + f"(?!{_WORD})")
            self.phrases.append((pattern, self._alias(phrase.replace(" ", "-"))))
        #: The same for texts in UTF-8, and whether a phrase has letters beyond ASCII, whose case bytes don't tell.
        self.in_bytes, self.wide = [(re.compile(p.pattern.encode()), k) for p, k in self.phrases], not all(map(str.isascii, lexicon.phrases))

    def _alias(self, word: str) -> str:
        return self.aliases.get(word, word)

    def _of_token(self, token: str) -> str:
        x, word = self.lexicon, self._alias(token)
        parts = word.split("-")
        compound = 2 <= len(parts) <= 3 and (parts[0] == "ai" or not x.anchors.isdisjoint(parts)) and all(len(p) >= 2 and p not in x.stopwords and not re.search("[0-9]", p) for p in parts)
        return word if word in x.signals or compound else ""

    def _of_topic(self, topic: str) -> str:
        keyword = self._alias(normal_form(topic))
        return "" if keyword in self.lexicon.generic else keyword

    def searchable(self, text: str) -> str:
        text = self._CAMEL.sub(r"-\g<0>", text).lower()
        if "://" in text:
            text = self._LINK.sub(" ", text)
        return self._JOIN.sub("-", text) if "_" in text or "/" in text else text

    @staticmethod
    def words(found: str) -> list[str]:
        """The matches of ``TOKEN``, by one byte translation: hyphens that don't stand alone between two letters or digits are spaces."""
        plain = found.encode("ascii", "replace").translate(_SPACED)
        if b"--" in plain:
            plain = _RUN.sub(b" ", plain)
        return plain.replace(b" -", b" ").replace(b"- ", b" ").strip(b"-").decode("ascii").split()

    def of_phrases(self, text: str) -> list[str]:
        return [keyword for pattern, keyword in self.phrases for _ in pattern.finditer(text)]

    def of_tokens(self, words: list[str], each: Counter[str]) -> Iterator[tuple[str, int]]:
        for word in (*(self.single & each.keys()), *(w for w in each if "-" in w)):
            if keyword := self.known[word]:
                yield keyword, each[word]

    def of_topics(self, topics: list[str | None]) -> list[str]:
        return [k for k in map(self.named.__getitem__, filter(None, topics)) if k]

    def bigram(self, word: str, suffix: str) -> str:
        """The keyword of a word before a suffix; empty if the word is no modifier."""
        a = self._alias(word)
        return self._alias(f"{a}-{self._alias(suffix)}") if len(a) > 2 and a.isascii() and a.isalpha() and a not in self.never else ""

    def of_bigrams(self, words: list[str], each: Counter[str]) -> Iterator[tuple[str, int]]:
        for suffix in self.suffixes & each.keys():
            before, i = [], 0
            for _ in range(each[suffix]):
                i = words.index(suffix, i) + 1
                before.append(words[i - 2] if i > 1 else "")
            for word, times in Counter(before).items():
                if keyword := self.bigram(word, suffix):
                    yield keyword, times

    def of_words(self, words: list[str], each: Counter[str]) -> Iterator[tuple[str, int]]:
        return ((self._alias(word), times) for word, times in each.items())

    def __call__(self, text: str, steps: tuple[str, ...]) -> dict[str, int]:
        n: dict[str, int] = {}
        if not text:
            return n
        found = self.searchable(text)
        if "phrases" in steps:
            n.update(Counter(self.of_phrases(found)))
        words = self.words(found) if steps != ("phrases",) else []
        each = Counter(words)
        for step, of in (("tokens", self.of_tokens), ("words", self.of_words), ("bigrams", self.of_bigrams)):
            if step in steps:
                for keyword, times in of(words, each):
                    n[keyword] = n.get(keyword, 0) + times
        return n


def text_keywords(text: Column, lexicon: Lexicon, steps: tuple[str, ...] = ("phrases", "tokens", "bigrams")) -> Column:
    """All keywords of a text (null: none), with repeats: a hyphenated phrase counts as phrase and as token. Step ``words``: every token, keyword or not. Repeats stand together."""

    @F.pandas_udf(ArrayType(StringType()))
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        keywords = Extractor(lexicon)
        for texts in batches:
            yield pd.Series([list(Counter(keywords(t, steps)).elements()) if t else [] for t in texts])

    return extract(text)


def label(keyword: Column, lexicon: Lexicon) -> Column:
    """Parts capitalised, acronyms in capitals."""
    return F.array_join(
        F.transform(F.split(keyword, "-"), lambda p: F.when(p.isin(*lexicon.acronyms), F.upper(p)).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30)))), " "
    )


def district(keyword: Column, lexicon: Lexicon) -> Column:
    """The first district one of whose words is the keyword or one of its parts."""
    parts, out = F.split(keyword, "-"), F.lit(lexicon.other)
    for name, words in reversed(lexicon.districts.items()):
        out = F.when(keyword.isin(*words) | F.arrays_overlap(parts, _words(words)), name).otherwise(out)
    return out
