"""Keywords and words of whole Arrow batches, counted.

All texts of a batch are one piece of bytes, a line break after each: it is lowered and cut by byte translation, its words are
one Arrow array, and what is asked of a word is asked once for each distinct word. ``keywords.Extractor`` defines what is found
in a text; texts with links, camel case and the like are prepared by it first.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .keywords import _SPACED, SOURCES, Extractor, normal_form
from .lexicon import Lexicon
from .text import WHITE

_UPPER, _LOWER = string.ascii_uppercase.encode(), string.ascii_lowercase.encode()
_CASES = bytes.maketrans(_UPPER + b"_/", _LOWER + b"--")
#: 1 for what a capital may follow in camel case, 2 for capitals.
_KINDS = bytes(1 if b in _LOWER + b"0123456789" else 2 if b in _UPPER else 0 for b in range(256))
_RUN, _JOINS = re.compile(b"--+"), re.compile(b"[_/][_/]")
#: The characters beyond ASCII whose lower case holds ASCII letters.
FOLDED = ("İ", "K")
#: What a normal form may have a hyphen for, and the bytes that it has nothing for otherwise.
_ODD = "[\x00-\x20\x7f/_" + WHITE.encode().decode("unicode_escape") + "".join(FOLDED) + r"\-]"
_NO_WORD = bytes(b for b in range(256) if not (b == 10 or bytes([b]).isalnum()))
#: Sources in their own order, which is that of the rows of an id.
ORDERED = tuple(sorted(SOURCES))


def _joined(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """Texts as one piece, a line break after each, and where these are."""
    whole = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(texts)], pa.int64()), texts.cast(pa.large_binary())), pa.scalar(b"\n", pa.large_binary()))
    data = whole[0].as_py() + b"\n" if len(texts) else b""
    return data, np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64) + 1) - 1


class _Texts:
    """The searchable texts of an array as bytes, and its words: ``tokens[j]`` is the number of the j-th word in ``words``."""

    def __init__(self, texts: pa.Array, find: Extractor):
        texts = texts.fill_null("")
        data, self.ends = _joined(texts)
        if (rows := self._odd(data, texts, find)).size:
            mask = np.zeros(len(texts), bool)
            mask[rows] = True
            prepared = pa.array([find.searchable(t) for t in texts.take(pa.array(rows)).to_pylist()], texts.type)
            data, self.ends = _joined(pc.replace_with_mask(texts, pa.array(mask), prepared))
        self.found = data.translate(_CASES)
        tokens, starts = self._tokens(self.found)
        self.bounds = np.searchsorted(starts, self.ends)  # the first word after each text
        coded = tokens.dictionary_encode()
        self.words, self.tokens = coded.dictionary, coded.indices.to_numpy()

    def _odd(self, data: bytes, texts: pa.Array, find: Extractor) -> np.ndarray:
        """The rows that byte translation alone doesn't make searchable."""
        if find.wide:
            return np.arange(len(texts))
        kinds = np.frombuffer(data.translate(_KINDS), np.uint8)
        at = [np.flatnonzero((kinds[:-1] == 1) & (kinds[1:] == 2))]
        if b"_" in data or b"/" in data:
            at.append(self._places(_JOINS, data))
        at += [self._places(re.compile(b), data) for c in FOLDED if (b := c.encode()) in data]
        return np.unique(np.searchsorted(self.ends, np.concatenate(at)))

    @staticmethod
    def _places(pattern: re.Pattern[bytes], data: bytes) -> np.ndarray:
        return np.array([m.start() for m in pattern.finditer(data)], np.int64)

    @staticmethod
    def _tokens(found: bytes) -> tuple[pa.Array, np.ndarray]:
        """The matches of ``keywords.TOKEN`` and where each begins: hyphens that don't stand alone between two letters or digits are spaces."""
        plain = found.translate(_SPACED)
        if b"--" in plain:
            plain = _RUN.sub(lambda m: b" " * len(m[0]), plain)
        plain = plain.replace(b" -", b"  ").replace(b"- ", b"  ")
        plain = b" " + plain[1:] if plain[:1] == b"-" else plain
        letters = np.frombuffer(plain, np.uint8)
        inside = letters != 32
        edges = np.flatnonzero(np.diff(inside, prepend=False))  # the last byte is a space
        starts, stops = edges[::2], edges[1::2]
        offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters[inside])), starts

    def of_token(self, at: np.ndarray) -> np.ndarray:
        """The rows of words by their places."""
        return np.searchsorted(self.bounds, at, "right")

    def among(self, words) -> pa.Array:
        return pc.is_in(self.words, value_set=pa.array(sorted(words), self.words.type))

    def places(self, numbers: np.ndarray) -> np.ndarray:
        """Where these words stand."""
        wanted = np.zeros(len(self.words), bool)
        wanted[numbers] = True
        return np.flatnonzero(wanted[self.tokens])


def _strings(data: bytes, ends: int) -> pa.Array:
    """The pieces of ``data`` before each byte ``ends``, the last one."""
    letters = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(letters == ends)
    offsets = np.concatenate([[0], at - np.arange(len(at))]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(letters[letters != ends]))


#: Rows, and for each the number of a keyword among those of the last array, in which null is no keyword.
Found = tuple[np.ndarray, np.ndarray, pa.Array]


def _of_texts(texts: pa.Array, find: Extractor) -> Iterator[Found]:
    """Phrases, tokens and bigrams, as ``Extractor`` has them; a row for each time."""
    t = _Texts(texts, find)
    for pattern, keyword in find.in_bytes:
        at = t._places(pattern, t.found)
        yield np.searchsorted(t.ends, at), np.zeros(len(at), np.int64), _array([keyword])
    numbers = np.flatnonzero(pc.or_(pc.match_substring(t.words, "-"), t.among(find.single)).to_numpy(zero_copy_only=False))
    keywords = [find.known[w] or None for w in t.words.take(pa.array(numbers)).to_pylist()]
    at = t.places(numbers)
    yield t.of_token(at), np.searchsorted(numbers, t.tokens[at]), _array(keywords)
    at = t.places(np.flatnonzero(t.among(find.suffixes).to_numpy(zero_copy_only=False)))
    rows = t.of_token(at)
    inside = (at > 0) & (t.of_token(at - 1) == rows)
    at, rows = at[inside], rows[inside]
    k = max(1, len(t.words))
    pairs, which = np.unique(t.tokens[at - 1].astype(np.int64) * k + t.tokens[at], return_inverse=True)
    before, after = (t.words.take(pa.array(n)).to_pylist() for n in np.divmod(pairs, k))
    yield rows, which, _array([find.bigram(b, a) or None for b, a in zip(before, after, strict=True)])


def _array(keywords: list[str | None]) -> pa.Array:
    return pa.array(keywords, pa.large_string())


def _aliased(words: pa.Array, lexicon: Lexicon) -> pa.Array:
    return pc.coalesce(_array(list(lexicon.aliases.values())).take(pc.index_in(words, value_set=_array(list(lexicon.aliases)))), words)


def _normal_forms(texts: pa.Array) -> pa.Array:
    """``normal_form`` of texts, none null: those that hold nothing that becomes a hyphen only lose bytes."""
    odd = pc.match_substring_regex(texts, _ODD)
    plain = _strings(_joined(texts.filter(pc.invert(odd)))[0].translate(_CASES, _NO_WORD), 10)
    odd_ones = _array([normal_form(t) for t in texts.filter(odd).to_pylist()])
    return pc.replace_with_mask(pc.replace_with_mask(texts, pc.invert(odd), plain), odd, odd_ones)


def _of_topics(topics: pa.Array, find: Extractor) -> Found:
    """Each topic that is there is looked at once."""
    named = pc.list_flatten(topics).cast(pa.large_string()).dictionary_encode()
    keywords = _aliased(_normal_forms(named.dictionary), find.lexicon)
    gone = pc.is_in(keywords, value_set=_array(["", *find.lexicon.generic]))
    rows, numbers = pc.list_parent_indices(topics), named.indices
    if numbers.null_count:
        rows, numbers = rows.filter(numbers.is_valid()), numbers.drop_null()
    return rows.to_numpy(), numbers.to_numpy(), pc.if_else(gone, pa.scalar(None, pa.large_string()), keywords)


def _signals(keywords: pa.Array, lexicon: Lexicon) -> pa.Array:
    """``keywords.is_signal`` of an array."""
    found = pc.or_(pc.is_in(keywords, value_set=_array(sorted(lexicon.signals))), pc.starts_with(keywords, lexicon.signal_prefix))
    parts = "|".join(map(re.escape, sorted(lexicon.signal_parts)))
    return pc.or_(found, pc.match_substring_regex(keywords, rf"(?:^|-)(?:{parts})(?:-|$)")) if parts else found


def _groups(ids: pa.Array) -> np.ndarray:
    """Numbers of the ids: 0, 1, ...; rows of one id that follow one another have the same."""
    numbers = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.cumsum(np.diff(numbers, prepend=numbers[:1]) != 0)


_NAMES = ["id", "source", "keyword", "occurrences", "first"]


#: Rows of texts that a worker works on at a time.
AT_ONCE = 250


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``AT_ONCE`` rows; what Arrow keeps for later goes back after each batch, so a worker's memory doesn't grow with their number."""
    for batch in batches:
        for k in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(k, AT_ONCE)
        pa.default_memory_pool().release_unused()


def _counted(batch: pa.RecordBatch, find: Extractor, signals: bool) -> tuple[pa.RecordBatch, np.ndarray]:
    """A batch's rows by id, source and keyword, as its ids follow one another; and the number of each row's id."""
    group, parts, keywords, before = _groups(batch.column("id")), [], [], 0
    for s, source in enumerate(ORDERED):
        column = batch.column(source)
        for rows, numbers, some in [_of_topics(column, find)] if source == "topics" else _of_texts(column, find):
            parts.append((group[rows] * len(ORDERED) + s, numbers.astype(np.int64) + before))
            keywords.append(some)
            before += len(some)
    over, code = map(np.concatenate, zip(*parts, strict=True))
    coded = pa.concat_arrays(keywords).dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    names, rank = coded.dictionary.take(order), np.full(len(order) + 1, -1)
    rank[order.to_numpy()] = np.arange(len(order))
    if signals:
        rank[order.filter(pc.invert(_signals(names, find.lexicon))).to_numpy()] = -1
    rank = rank[coded.indices.fill_null(len(order)).to_numpy()[code]]
    k = max(1, len(names))
    keys, times = np.unique((over * k + rank)[rank >= 0], return_counts=True)
    over, rank = np.divmod(keys, k)
    g, s = np.divmod(over, len(ORDERED))
    first = np.zeros(len(keys), bool)
    first[np.unique(g * k + rank, return_index=True)[1]] = True
    ids = batch.column("id").take(pa.array(np.searchsorted(group, g)))
    columns = [ids, pa.array(ORDERED).take(pa.array(s)), names.take(pa.array(rank)).cast(pa.string()), pa.array(times, pa.int64()), pa.array(first)]
    return pa.RecordBatch.from_arrays(columns, _NAMES), g


def _added(a: pa.RecordBatch, b: pa.RecordBatch) -> pa.RecordBatch:
    """The rows of one id from two batches as one."""
    n: dict[tuple[str, str], int] = {}
    for part in (a, b):
        for source, keyword, times in zip(*(part.column(c).to_pylist() for c in _NAMES[1:4]), strict=True):
            n[source, keyword] = n.get((source, keyword), 0) + times
    rows, seen = sorted(n), set()
    first = [not (k in seen or seen.add(k)) for _, k in rows]
    ids = (a if a.num_rows else b).column("id")
    columns = [ids.take(pa.array([0] * len(rows), pa.int64())), pa.array([s for s, _ in rows], pa.string()), pa.array([k for _, k in rows], pa.string()), pa.array([n[r] for r in rows], pa.int64()), pa.array(first, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def counted_keywords(lexicon: Lexicon, signals: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: id, source, keyword, occurrences, first from id, topics, description, readme.

    Rows of an id that follow one another add up, also from batch to batch; ``first`` marks one row for each id and keyword.
    Rows come in the order of the ids, then by source and keyword. ``signals``: only keywords that are signals.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held, of = Extractor(lexicon), None, None
        for batch in _parts(batches):
            rows, g = _counted(batch, find, signals)
            ids = batch.column("id")
            last = _groups(ids)[-1]
            if held is not None and of.equals(ids[0]):
                cut = np.searchsorted(g, 1)
                held, rows, g = _added(held, rows.slice(0, cut)), rows.slice(cut), g[cut:]
                if not last:
                    continue
            if held is not None:
                yield held
            cut = np.searchsorted(g, last)
            held, of = rows.slice(cut), ids[-1]
            yield rows.slice(0, cut)
        if held is not None:
            yield held

    return count


def counted_words(lexicon: Lexicon) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: word, n from description, readme; a word is one row for each part of a batch and column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Extractor(lexicon)
        for batch in _parts(batches):
            for c in ("description", "readme"):
                t = _Texts(batch.column(c), find)
                words = _aliased(t.words, lexicon)
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(np.bincount(t.tokens, minlength=len(words)), pa.int64())], ["word", "n"])

    return count
