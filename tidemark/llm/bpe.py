"""Byte-pair encoding and decoding, with tree concatenation for long texts.

A vocabulary file is read once in each Python worker. The merges run in tiktoken, whose ranks are made
from the file: a merge's rank is the id of the token that it makes, which is how these vocabularies
are numbered. Tests hold the ids against the tokenizers library.

A long text is cut into leaves anywhere, even inside a word. The leaves are rows of their own, so
tasks encode them in parallel; then neighbours are joined level by level. The splitting rule reads a
text from left to right and cuts it into pieces; a piece that ends two characters or more before the end
of what was read stays the same whatever follows. At each join a window of tokens around it is encoded again and grown until both
sides agree with it:

* on the left it begins where the left side's last piece begins, or inside that piece (a long run) at a
  token which the window gives again;
* on the right it ends where a piece begins both in the window and in the right side's own reading,
  from where on both readings are the same, or inside the right side's first piece at a token which the
  window gives again.

A sequence of byte-pair tokens is the encoding of a piece exactly if every neighbouring pair is the
encoding of the pair's text; each pair in the result lies in one of three encodings, so the result is
what encoding the whole piece gives. A join takes next to no time where both sides agree soon. Where
they never do (one letter millions of times, at an odd place), it encodes the piece again, so the whole
text is encoded about as many times as the tree has levels.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from .shared import by_batch, id_text

#: Characters of a leaf; longer texts are cut.
LEAF = 16_384
#: A worker's cache of words is emptied beyond this size.
WORDS = 400_000
#: Characters or bytes of texts that are split at a time.
GROUP = 1 << 20
#: Tokens on either side of a join that are read at first, and beyond which all of the piece is.
NEAR, FAR = 16, 1024
#: Leaves begin at multiples of this, so that in long repetitions tokens mostly begin there too.
STEP = 240
#: Characters at a leaf's ends that are searched for its first and last piece before the whole leaf is.
EDGE = 256

#: Characters after a piece's beginning that the splitting rule may need to see before it begins another there ("'ll").
SEEN = 2

#: Letters in every version of Unicode, which no normal form changes and whose lower case is one letter.
_LETTER = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
#: The byte-level splitting rule, and how a vocabulary file states it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: Where the splitting rule cuts whatever stands around: after letters, after digits, and after
#: punctuation before a space or a digit.
_SURE = re.compile(rf"(?<=[{_LETTER}])(?=[\x00-@\[-`{{-\x7f])|(?<=[0-9])(?=[\x00-/:-\x7f])|(?<=[!-/:-@\[-`{{-~])(?=[ \t\n\r0-9])")


def vocabulary_path(name: str) -> str:
    """The place of one of the installed public vocabulary files, or ``name`` itself if it is a path."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The byte of every character that byte-level vocabularies write: printable ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


@lru_cache(4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of every token of a byte-level vocabulary, by id."""
    with open(path, encoding="utf-8") as file:
        read = json.load(file)
    alphabet = byte_alphabet()
    known = {i: bytes(alphabet[c] for c in token) for token, i in read["model"]["vocab"].items()}
    known |= {t["id"]: t["content"].encode() for t in read["added_tokens"]}
    return [known.get(i, b"") for i in range(max(known) + 1)]


def decode(ids: bytes, path: str) -> str:
    """What the library's decode gives without skipping special tokens."""
    return b"".join(map(token_bytes(path).__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class Part(NamedTuple):
    """A text with its tokens: the end of its first piece and the beginning of its last, in characters and tokens."""

    text: str
    ids: np.ndarray
    first: tuple[int, int]
    last: tuple[int, int]


class Encoder:
    """A byte-level vocabulary; ids are little-endian unsigned 32-bit numbers."""

    def __init__(self, name: str):
        path = vocabulary_path(name)
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        if read["normalizer"] or read["pre_tokenizer"] != BYTE_LEVEL:
            raise ValueError(f"{name} isn't a plain byte-level vocabulary")
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in read["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in read["added_tokens"]}
        self.core = tiktoken.Encoding(name, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self.special = list(special)
        self.specials = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.bytes = token_bytes(path)
        self.sizes = np.array([len(b) for b in self.bytes])
        self.pieces = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)

    def encode(self, text: str) -> np.ndarray:
        """What the library gives; special tokens in the text count as such."""
        return self.core.encode_to_numpy(text, allowed_special="all")

    def encode_many(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t).tobytes() for t in texts]

    def _before_special(self, text: str, at: int) -> int:
        """``at``, or the beginning of the special token that it lies in."""
        for s in self.special:
            found = text.find(s, max(0, at - len(s) + 1), at + len(s) - 1)
            if 0 <= found < at:
                at = found
        return at

    def _after_special(self, text: str, at: int) -> int:
        """``at``, or the end of the special token that it lies in; at most the text's end."""
        for s in self.special:
            found = text.find(s, max(0, at - len(s) + 1), at + len(s) - 1)
            if 0 <= found < at:
                at = found + len(s)
        return min(at, len(text))

    def leaves(self, text: str, leaf: int = LEAF) -> list[str]:
        """``text`` cut into halves of halves of at most ``leaf`` characters, never inside a special token."""
        if len(text) <= leaf:
            return [text]
        cut = len(text) // 2
        cut = self._before_special(text, cut - cut % STEP or cut)
        if not cut:
            return [text]
        return self.leaves(text[:cut], leaf) + self.leaves(text[cut:], leaf)

    def starts(self, text: str) -> list[int]:
        """Where the pieces of a text begin: special tokens, and what the library's splitting rule gives between them."""
        out, at = [], 0
        for s in self.specials.finditer(text):
            out += [at + a for _, (a, _) in self.pieces.pre_tokenize_str(text[at : s.start()])]
            out.append(s.start())
            at = s.end()
        return out + [at + a for _, (a, _) in self.pieces.pre_tokenize_str(text[at:])]

    def _tokens(self, ids: np.ndarray, text: str) -> int:
        """How many of the first ``ids`` make up ``text``."""
        size = len(text.encode())
        return int(np.searchsorted(np.cumsum(self.sizes[ids]), size)) + 1 if size else 0

    def part(self, text: str, ids: np.ndarray) -> Part:
        """A leaf with its tokens."""
        head = text[: self._after_special(text, EDGE)]
        starts = self.starts(head)
        if len(starts) < 2 and len(head) < len(text):
            starts = self.starts(text)
        first = starts[1] if len(starts) > 1 else len(text)
        tail = max(0, len(text) - EDGE)
        sure = [m.start() for m in _SURE.finditer(text, tail)]
        begin = self._before_special(text, sure[-1]) if sure else 0
        last = begin + max((s for s in self.starts(text[begin:]) if begin + s <= len(text) - SEEN), default=0)
        return Part(text, ids, (first, self._tokens(ids, text[:first])), (last, self._tokens(ids, text[:last])))

    def _text(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode()

    def _inside(self, token: int) -> bool:
        """Whether a token begins inside a character."""
        return 0x80 <= self.bytes[token][0] < 0xC0

    def join(self, a: Part, b: Part) -> Part:
        """Two neighbouring texts as one."""
        if not a.text or not b.text:
            return b if not a.text else a
        n = NEAR
        while True:
            i, j = max(a.last[1], len(a.ids) - n), min(len(b.ids), n)
            while self._inside(a.ids[i]):
                i -= 1
            while j < len(b.ids) and self._inside(b.ids[j]):
                j += 1
            if (joined := self._join(a, i, b, j)) is not None:
                return joined
            n = 4 * n if n < FAR else len(a.ids) + len(b.ids)

    def _join(self, a: Part, i: int, b: Part, j: int) -> Part | None:
        """The join by a window from ``a``'s token ``i`` to before ``b``'s token ``j``, or None if it doesn't agree."""
        left, right = self._text(a.ids[i:]), self._text(b.ids[:j])
        cut, end = len(left), len(right)
        more = b.text[end : self._after_special(b.text, min(end + SEEN, len(b.text)))]
        read = self.starts(left + right + more)
        own = {cut + s for s in self.starts(right + more)}
        if end == len(b.text):
            read, own = [*read, cut + end], own | {cut + end}
        common = next((s for s in read if cut <= s <= cut + end and s in own), None)
        if common is not None:
            to, drop = common - cut, self._tokens(b.ids[:j], right[: common - cut])
        else:
            to, drop = end, j
            if j >= b.first[1] or read[-1] >= cut + end or self.starts(left + right) != read:
                return None
        window, inner = left + right[:to], [s for s in read if 0 < s < cut + to]
        if self.starts(window) == [0, *inner]:
            middle = self.encode(window)
        else:  # white space at its end isn't one piece once something follows
            middle = np.concatenate([self.encode(window[s:t]) for s, t in zip([0, *inner], [*inner, len(window)], strict=True)])
        if (i > a.last[1] and middle[0] != a.ids[i]) or (common is None and middle[-1] != b.ids[j - 1]):
            return None
        at = lambda s: (len(a.text) - cut + s, i + self._tokens(middle, window[:s]))
        behind = lambda edge: (len(a.text) + edge[0], i + len(middle) + edge[1] - drop)
        if a.last[0]:
            first = a.first
        else:
            first = at(inner[0]) if inner else behind((to, drop) if common is not None else b.first)
        if to <= b.last[0] <= len(b.text) - SEEN:
            last = behind(b.last)
        else:
            kept = [s for s in inner if s <= cut + len(b.text) - SEEN]
            last = at(kept[-1]) if kept else a.last
        return Part(a.text + b.text, np.concatenate([a.ids[:i], middle, b.ids[drop:]]), first, last)

    def concatenate(self, leaves: list[tuple[str, np.ndarray]]) -> np.ndarray:
        """The encoding of neighbouring texts from theirs, joined level by level."""
        parts = [self.part(*leaf) for leaf in leaves]
        while len(parts) > 1:
            parts = [self.join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0].ids


class WordEncoder:
    """A vocabulary that lower-cases and drops white space: every word between ASCII white space is encoded on its own.

    Normalization and splitting act within a word, so a word gives the same ids wherever it stands. Words
    are looked up first. New ones of printable ASCII and Latin letters, which no normal form changes, are
    split by expression and merged together: a character that no word has ends each part, so that a
    token with it is the vocabulary's token at a word's end. All other words go to the library.
    """

    _PLAIN = re.compile(rf"[\n!-~{_LETTER}]*")
    _PART = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|\n|[^\n{_LETTER}0-9]+")
    _END = "\0"

    def __init__(self, name: str):
        path = vocabulary_path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        if [n["type"] for n in read["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or read["model"]["end_of_word_suffix"] != "</w>":
            raise ValueError(f"{name} isn't a vocabulary of lower-case words")
        alphabet, end = byte_alphabet(), self._END.encode()
        ranks = {}
        for token, i in read["model"]["vocab"].items():
            body = token.removesuffix("</w>")
            ranks[bytes(alphabet[c] for c in body) + end * (body != token)] = i
        self.core = tiktoken.Encoding(name, pat_str=f"[^{self._END}]+{self._END}", mergeable_ranks=ranks, special_tokens={})
        self.line = ranks[b"\n" + end]
        self.special = [t["content"] for t in read["added_tokens"]]
        #: Bytes that hold any id.
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.words: dict[bytes, bytes] = {}

    def _new(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Words are merged one a line; lines end where the token of a line's end is."""
        text = b"\n".join([*words, b""]).decode()
        if self._PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            ids = self.core.encode_to_numpy(self._END.join([*self._PART.findall(text.lower()), ""]))
            ends, raw = (4 * np.flatnonzero(ids == self.line)).tolist(), ids.tobytes()
            return {w: raw[a + 4 : b] for w, a, b in zip(words, [-4, *ends], ends, strict=False)}
        texts = {w: w.decode() for w in words}
        plain = [w for w, t in texts.items() if self._PLAIN.fullmatch(t) and not any(s in t for s in self.special)]
        other = list(texts.keys() - set(plain))
        found = self.tokenizer.encode_batch_fast([texts[w] for w in other], add_special_tokens=False)
        out = {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(other, found, strict=True)}
        return out | self._new(plain) if plain else out

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        """What the library gives for each text in UTF-8, as unsigned 32-bit little-endian ids."""
        return in_groups(self._encode_group, texts)

    def _encode_group(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        found = [list(map(self.words.get, ws)) for ws in split]
        new = {w for ws, ids in zip(split, found, strict=True) if None in ids for w, i in zip(ws, ids, strict=True) if i is None}
        if new:
            fresh = self._new(list(new))
            for k, ids in enumerate(found):
                if None in ids:
                    found[k] = [fresh[w] if i is None else i for w, i in zip(split[k], ids, strict=True)]
            if len(self.words) + len(fresh) > WORDS:
                self.words.clear()
            self.words.update(fresh)
        return [b"".join(ids) for ids in found]


def in_groups(encode_group, texts: list) -> list[bytes]:
    """``encode_group`` of the texts, about GROUP characters at a time: split texts take many times their size."""
    out, first, size = [], 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= GROUP:
            out += encode_group(texts[first : k + 1])
            first, size = k + 1, 0
    return out + encode_group(texts[first:])


@lru_cache(4)
def word_encoder(name: str) -> WordEncoder:
    return WordEncoder(name)


@lru_cache(4)
def encoder(name: str) -> Encoder:
    """One for each vocabulary in a worker."""
    return Encoder(name)


def encode_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", leaf: int = LEAF, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the long columns ``keep`` and ``ids`` (binary, unsigned 32-bit little-endian), one row for each row of ``docs``.

    A null or empty text has no ids, repeated rows give repeated results, and no documents give none.
    Texts over ``leaf`` characters are encoded by tree concatenation: only their leaves are shuffled, once
    to spread the work and once to meet at their document. They meet by id, ``keep`` and the text's
    SHA-256, which a task that is run again gives again; equal rows are joined once and given as often.
    """
    texts, named = id_text(docs, keep), ["doc_id", *keep]
    out = pa.schema([*((c, pa.int64()) for c in named), ("ids", pa.binary())])
    parts = pa.schema([*((c, pa.int64()) for c in named), ("digest", pa.binary()), ("leaf", pa.int32()), ("text", pa.string())])
    columns = ", ".join(f"{c} long" for c in named)
    key = [*named, "digest"]

    def whole(batch: pa.RecordBatch) -> dict:
        return {c: batch[c] for c in named} | {"ids": encoder(vocabulary).encode_many(batch["text"].to_pylist())}

    def split(batches):
        for batch in batches:
            for *ns, text in zip(*(batch[c].to_pylist() for c in (*named, "text")), strict=True):
                leaves, digest = encoder(vocabulary).leaves(text, leaf), hashlib.sha256(text.encode()).digest()
                same = {c: [n] * len(leaves) for c, n in zip(key, (*ns, digest), strict=True)}
                yield pa.RecordBatch.from_pydict(same | {"leaf": range(len(leaves)), "text": leaves}, schema=parts)

    def encode(batch: pa.RecordBatch) -> dict:
        return {c: batch[c] for c in parts.names} | {"ids": encoder(vocabulary).encode_many(batch["text"].to_pylist())}

    def concatenate(batches):
        held, now, times = [], None, 0

        def done():
            ids = encoder(vocabulary).concatenate(held).tobytes()
            return pa.RecordBatch.from_pydict({c: [n] * times for c, n in zip(named, now, strict=False)} | {"ids": [ids] * times}, schema=out)

        for batch in batches:
            for *k, at, text, ids in zip(*(batch[c].to_pylist() for c in (*key, "leaf", "text", "ids")), strict=True):
                if held and now != k:
                    yield done()
                    held, times = [], 0
                now, times = k, times + (at == 0)
                if at == len(held):  # not a repeated row's
                    held.append((text, np.frombuffer(ids, "<u4")))
        if held:
            yield done()

    short = texts.filter(F.length("text") <= leaf).mapInArrow(by_batch(whole, out), f"{columns}, ids binary")
    leaves = texts.filter(F.length("text") > leaf).mapInArrow(split, f"{columns}, digest binary, leaf int, text string").repartition(*key, "leaf")
    encoded = leaves.mapInArrow(by_batch(encode, parts.append(pa.field("ids", pa.binary()))), f"{columns}, digest binary, leaf int, text string, ids binary")
    long = encoded.repartition(*key).sortWithinPartitions(*key, "leaf").mapInArrow(concatenate, f"{columns}, ids binary")
    return short.unionByName(long)


def decode_documents(encoded: DataFrame, vocabulary: str = "byte_bpe_50k.json", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the long columns ``keep``, ids and the text that ``ids`` stand for.

    ``encoded`` is what ``encode_documents`` gives: no ids are the empty text, repeated rows are decoded
    alike, an empty table gives no rows; null ids, and ids that the vocabulary hasn't, are an error.
    """
    named = ["doc_id", *keep]
    schema = pa.schema([*((c, pa.int64()) for c in named), ("ids", pa.binary()), ("decoded", pa.string())])

    def make(batch: pa.RecordBatch) -> dict:
        path = vocabulary_path(vocabulary)
        return {c: batch[c] for c in (*named, "ids")} | {"decoded": [decode(i, path) for i in batch["ids"].to_pylist()]}

    return encoded.select(*named, "ids").mapInArrow(by_batch(make, schema), ", ".join(f"{c} long" for c in named) + ", ids binary, decoded string")


def encoding_report(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    return decode_documents(encode_documents(docs, vocabulary), vocabulary).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
