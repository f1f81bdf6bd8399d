"""Periodic runs of words by partition refinement.

Positions whose factors of length l are equal form a class. Classes of length l + 1 come from those of
length l: position i moves by the class of i + 1. Of the parts into which a class falls, all but a largest
one split their predecessors in the next round (the others' predecessors then part by themselves), so each
position takes part O(log n) times, whatever the text. Members of a class are linked in text order. Two
neighbouring members at a distance equal to l are a square with a primitive root, since any occurrence
between them would be nearer; squares at consecutive positions are one run, from the first to the last
plus 2 l words.

A batch of short texts is refined at once, each with words and an end mark of its own, so one round of
array operations serves all of them. No round is needed beyond a fourth of a text's words, and rounds in
which nothing splits and no neighbours have that distance are skipped. A text is never cut: memory grows
with the longest text (about 150 bytes a word).
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import by_batch, id_text

#: A run has at least so many words, and at least so many periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: A text of so many words is refined alone: it needs many rounds, in most of which one position splits off.
ALONE = 2048


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each of the slices, one after another."""
    total = int(size.sum())
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(total)


class Refinement:
    """The classes of positions by their factors of length ``level``, first 1; ``word`` has ids below its length.

    ``limit`` has for every position the largest distance that matters. The members of class c are
    ``order[start[c] : start[c] + size[c]]``; ``after`` and ``before`` link them in text order, -1 at the ends.
    """

    def __init__(self, word: np.ndarray, limit: np.ndarray):
        n = len(word)
        self.level, self.limit = 1, limit
        self.order = np.argsort(word, kind="stable")
        sorted_words = word[self.order]
        first = np.ones(n, bool)
        first[1:] = sorted_words[1:] != sorted_words[:-1]
        self.slot, self.label = np.empty(n, np.int64), np.empty(n, np.int64)
        self.slot[self.order] = np.arange(n)
        self.label[self.order] = np.cumsum(first) - 1
        self.start = np.zeros(n + 1, np.int64)
        self.size = np.zeros(n + 1, np.int64)
        self.classes = int(first.sum())
        self.start[: self.classes] = np.flatnonzero(first)
        self.size[: self.classes] = np.diff(np.append(self.start[: self.classes], n))
        self.after, self.before = np.full(n, -1), np.full(n, -1)
        self.events: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # (next distance, number, distances, positions)
        self.made = 0
        left, right = self.order[:-1][~first[1:]], self.order[1:][~first[1:]]
        self._link(left, right)
        self.splitters = np.arange(n)  # at first, every class splits

    def _link(self, left: np.ndarray, right: np.ndarray) -> None:
        """Neighbours from now on. Those at a distance that may still matter wait for the level of that length."""
        fresh = self.after[left] != right
        self.after[left], self.before[right] = right, left
        left = left[fresh]
        distance = self.after[left] - left
        due = (distance >= self.level) & (distance <= self.limit[left])
        if due.any():
            left, distance = left[due], distance[due]
            by = np.argsort(distance, kind="stable")
            self.made += 1
            heapq.heappush(self.events, (int(distance[by[0]]), self.made, distance[by], left[by]))

    def squares(self) -> np.ndarray:
        """Positions where a square with a primitive root of ``level`` words begins, ascending."""
        found = []
        while self.events and self.events[0][0] <= self.level:
            at, made, distance, left = heapq.heappop(self.events)
            cut = int(np.searchsorted(distance, at, "right"))
            if at == self.level:
                found.append(left[:cut])
            if cut < len(left):
                heapq.heappush(self.events, (int(distance[cut]), made, distance[cut:], left[cut:]))
        if not found:
            return np.empty(0, np.int64)
        at = np.unique(np.concatenate(found))
        return at[self.after[at] == at + self.level]

    def advance(self) -> bool:
        """To the next level at which anything may be found; False if there is none."""
        if len(self.splitters):
            self.level += 1
            self._refine()
        elif self.events:
            self.level = self.events[0][0]
        return bool(len(self.splitters) or self.events)

    def _refine(self) -> None:
        if len(self.splitters) == 1:
            return self._split_off(int(self.splitters[0]) - 1)
        splitter = self.splitters[self.splitters > 0]
        moved = splitter - 1
        several = (self.size[self.label[moved]] > 1) & (self.limit[moved] >= self.level)
        splitter, moved = splitter[several], moved[several]
        self.splitters = np.empty(0, np.int64)
        if not len(moved):
            return
        by = np.lexsort((moved, self.label[splitter], self.label[moved]))
        splitter, moved = splitter[by], moved[by]
        parent, part = self.label[moved], self.label[splitter]
        new_parent = np.append(True, parent[1:] != parent[:-1])
        new_part = new_parent | np.append(True, part[1:] != part[:-1])
        at = np.flatnonzero(new_part)  # parts, each a slice of moved
        count = np.diff(np.append(at, len(moved)))
        of = np.cumsum(new_parent[at]) - 1  # number of each part's parent
        parents = parent[np.flatnonzero(new_parent)]
        heads = np.flatnonzero(new_parent[at])  # each parent's first part
        gone = np.add.reduceat(count, heads)
        rest = self.size[parents] - gone
        # a largest part of each parent: the last by size, then place
        ranked = np.lexsort((count, of))
        largest = ranked[np.append(heads[1:], len(at)) - 1]
        # where all members move, a largest part stays as it is, as the rest
        stays = np.zeros(len(at), bool)
        stays[largest[rest == 0]] = True
        rest = np.where(rest == 0, count[largest], rest)
        # splitters of the next round: all but a largest of the parts and the rest
        small = ~stays
        over = count[largest] > rest
        small[largest[over]] = False
        small_rest = parents[over]
        goes = np.repeat(~stays, count)
        if goes.any():
            next_splitters = moved[np.repeat(small, count)]
            self._move(moved[goes], np.flatnonzero(~stays), count, of, parents)
            self.splitters = np.concatenate([next_splitters, self.order[_spans(self.start[small_rest], self.size[small_rest])]])

    def _split_off(self, at: int) -> None:
        """``_refine`` for the one position ``at``, as at the end of a long run, round after round."""
        parent = int(self.label[at]) if at >= 0 else -1
        if at < 0 or self.size[parent] == 1 or self.limit[at] < self.level:
            self.splitters = np.empty(0, np.int64)
            return
        left, right = int(self.before[at]), int(self.after[at])
        if left >= 0 and right >= 0:
            self._link(np.array([left]), np.array([right]))
        elif left >= 0:
            self.after[left] = -1
        else:
            self.before[right] = -1
        self.size[parent] -= 1
        hole, slot = int(self.slot[at]), int(self.start[parent] + self.size[parent])
        stranger = int(self.order[slot])
        self.order[hole], self.slot[stranger] = stranger, hole
        self.order[slot], self.slot[at] = at, slot
        self.size[self.classes], self.start[self.classes], self.label[at] = 1, slot, self.classes
        self.classes += 1
        self.before[at] = self.after[at] = -1
        self.splitters = np.array([at])

    def _move(self, moved: np.ndarray, parts: np.ndarray, count: np.ndarray, of: np.ndarray, parents: np.ndarray) -> None:
        """Parts, each given by its members in text order, leave their parents and become classes."""
        count, of = count[parts], of[parts]
        # out of the parents' lists: stretches of neighbours at once
        parent = np.repeat(parents[of], count)
        by = np.lexsort((moved, parent))
        listed = moved[by]
        broken = np.append(True, self.after[listed[:-1]] != listed[1:])
        left = self.before[listed[broken]]
        right = self.after[listed[np.append(np.flatnonzero(broken)[1:] - 1, len(listed) - 1)]]
        both = (left >= 0) & (right >= 0)
        self.after[left[(left >= 0) & (right < 0)]] = -1
        self.before[right[(right >= 0) & (left < 0)]] = -1
        self._link(left[both], right[both])
        # members of the moved parts to the end of their parents' slots
        gone = np.bincount(of, weights=count, minlength=len(parents)).astype(np.int64)
        tail = self.start[parents] + self.size[parents] - gone
        slots = _spans(tail, gone)  # in order of parents, as moved is
        mark = np.zeros(len(slots), bool)
        begin = np.cumsum(gone) - gone  # of each parent in slots
        number = np.repeat(np.arange(len(parents)), gone)
        inside = self.slot[moved] >= tail[number]
        mark[begin[number[inside]] + self.slot[moved[inside]] - tail[number[inside]]] = True
        holes, strangers = self.slot[moved[~inside]], self.order[slots[~mark]]
        # strangers take the holes of their own parent: both come in order of parents
        self.order[holes], self.slot[strangers] = strangers, holes
        self.order[slots], self.slot[moved] = moved, slots
        # classes of their own
        label = self.classes + np.arange(len(parts))
        self.classes += len(parts)
        self.size[parents] -= gone
        ends = np.cumsum(count)
        self.size[label], self.start[label] = count, slots[ends - count]
        self.label[moved] = np.repeat(label, count)
        last = np.zeros(len(moved), bool)
        last[ends - 1] = True
        self.before[moved[ends - count]] = -1
        self.after[moved[last]] = -1
        self._link(moved[:-1][~last[:-1]], moved[1:][~last[:-1]])


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each text, given as word numbers below its length, its runs (start, length, period) in order of start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    together = [k for k, t in enumerate(texts) if MIN_WORDS <= len(t) < ALONE]
    for group in [together, *([k] for k, t in enumerate(texts) if len(t) >= ALONE)]:
        if group:
            _find_together(texts, group, out)
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def _find_together(texts: list[np.ndarray], long: list[int], out: list[list[tuple[int, int, int]]]) -> None:
    """Adds the runs of the texts ``long``, unordered."""
    sizes = np.array([len(texts[k]) + 1 for k in long])
    base = np.cumsum(sizes) - sizes
    word = np.empty(int(sizes.sum()), np.int64)
    for b, k in zip(base.tolist(), long, strict=True):
        n = len(texts[k])
        word[b : b + n] = texts[k] + b
        word[b + n] = b + n  # the end, equal to nothing
    classes = Refinement(word, np.repeat((sizes - 1) // MIN_PERIODS, sizes))
    while True:
        level, at = classes.level, classes.squares()
        if len(at):
            cut = np.flatnonzero(np.append(True, np.diff(at) != 1))
            start, size = at[cut], np.diff(np.append(cut, len(at))) - 1 + 2 * level
            enough = size >= max(MIN_WORDS, MIN_PERIODS * level)
            start, size = start[enough], size[enough]
            text = np.searchsorted(base, start, "right") - 1
            for s, length, t in zip((start - base[text]).tolist(), size.tolist(), text.tolist(), strict=True):
                out[long[t]].append((s, length, level))
        if not classes.advance():
            return


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers, below the number of words."""
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run repeats: of every run the first period stays, unless another run drops from it."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def periodic_places(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the words that a document of ``n`` words has after its planned repetition, None if it has none."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def _columns(found: list[list[tuple[int, int, int]]], kept: list[bytes]) -> dict:
    best = [max(r, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if r else None for r in found]
    pick = lambda k: [b[k] if b else None for b in best]
    return {
        "n_runs": [len(r) for r in found],
        "start": pick(0),
        "length": pick(1),
        "period": pick(2),
        "exponent_milli": [1000 * b[1] // b[2] if b else None for b in best],
        "runs_sha256": [hashlib.sha256("".join(f"{s},{length},{p}\n" for s, length, p in r).encode()).hexdigest() for r in found],
        "collapsed_sha256": [hashlib.sha256(t).hexdigest() for t in kept],
    }


_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def document_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start, then period) and collapsed, one row for each row of ``docs``.

    ``collapsed`` is the text whose runs are reduced to their first period, words joined by one space. Null
    and empty texts have no runs and collapse to the empty text; other columns are ignored; repeated rows
    give repeated results, rows without an id keep a null id. No documents give no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("runs", _RUN_TYPE), ("collapsed", pa.string())])

    def make(batch: pa.RecordBatch) -> dict:
        words = [t.encode().split() for t in batch["text"].to_pylist()]
        found = find_runs([numbered(w) for w in words])
        runs = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found]
        return {"doc_id": batch["doc_id"], "runs": runs, "collapsed": [b" ".join(collapsed(w, r)).decode() for w, r in zip(words, found, strict=True)]}

    spark_type = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return id_text(docs).mapInArrow(by_batch(make, schema), spark_type)


def runs_report(docs: DataFrame) -> DataFrame:
    """Runs of every text after the planned repetition of a tenth of the documents: their number, the strongest, digests.

    Nulls, repeats and empty tables are as in ``document_runs``; of equal exponents the run that starts
    first is the strongest, then that with the smaller period. A document without an id has no planned
    repetition.
    """
    strings = ("runs_sha256", "collapsed_sha256")
    names = ["n_runs", "start", "length", "period", "exponent_milli", *strings]
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string() if c in strings else pa.int64()) for c in names)])

    def make(batch: pa.RecordBatch) -> dict:
        words, ids = [], batch["doc_id"].to_pylist()
        for doc_id, text in zip(ids, batch["text"].to_pylist(), strict=True):
            own = text.encode().split()
            places = periodic_places(doc_id, len(own))
            words.append(own if places is None else [own[i] for i in places.tolist()])
        found = find_runs([numbered(w) for w in words])
        return {"doc_id": ids} | _columns(found, [b" ".join(collapsed(w, r)) for w, r in zip(words, found, strict=True)])

    spark_type = "doc_id long, " + ", ".join(f"{c} {'string' if c in strings else 'long'}" for c in names)
    return id_text(docs).mapInArrow(by_batch(make, schema), spark_type)
