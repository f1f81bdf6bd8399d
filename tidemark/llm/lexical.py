"""Ranked lexical search over an inverted index in shards.

Every task turns the documents it reads into shards of a bounded number of postings: no text is shuffled.
A shard has one row for each of its terms, whose postings (documents in ascending doc_id, term frequencies)
are gaps in variable-length bytes, and one row with the ids and lengths of its documents.

A search joins the terms of the items with the index and deals their postings by shard. In a shard the
postings of an item's terms are merged document by document through a heap of cursors; the best documents
so far are in a second heap of bounded size, keyed by score, then doc_id. The score that a document needs
to enter it starts at what the k-th best of some documents with the rarest terms has, and rises. Terms whose
greatest contributions together stay below it can't bring a document in alone: they leave the merge and are
looked up for its documents only, which changes no result. A task carries an item's heap from shard to
shard, and at the end the tasks' heaps meet in one ranking an item.

Items are searched in blocks, so that a task never holds more than a block's heaps.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import by_batch, id_text, saved, small_batches

#: Postings of a shard, about, and items of a block, about.
SHARD, ITEMS = 1 << 21, 256
#: Results for each item.
TOP = 10
#: Up to so many bytes of terms are sent to all tasks; beyond, Spark chooses the join.
BROADCAST = 32 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

INDEX = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("tokens", pa.int64()), ("data", pa.binary())])
FOUND = pa.schema([("item", pa.int64()), ("score", pa.int64()), ("doc_id", pa.int64())])


def terms(raw: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: only ASCII letters, digits and everything beyond ASCII belong to one."""
    return raw.translate(_LOWER).split()


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers, seven bits a byte, lowest first, and the place after each one's last byte."""
    values = values.astype(np.uint64)
    width = np.ones(len(values), np.int64)
    for k in range(1, 10):
        longer = values >= np.uint64(1 << 7 * k)
        if not longer.any():
            break
        width += longer
    end = np.cumsum(width)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(int(width.max(initial=0))):
        has = width > k
        more = (width[has] > k + 1).astype(np.uint8) << 7
        out[end[has] - width[has] + k] = ((values[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, end


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    if len(last) == len(raw):
        return raw.astype(np.int64)
    first = np.append(0, last[:-1] + 1)
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), first).view(np.int64)


def _shard_rows(shard: int, ids: list[int | None], lengths: list[int], vocabulary: list[bytes], own: np.ndarray, number: np.ndarray, tf: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``own`` has the number of distinct terms of each document, ``number`` and ``tf`` one entry for each posting."""
    has_id = np.array([i is not None for i in ids])
    doc_id = np.array([i or 0 for i in ids], np.int64)
    by = np.lexsort((doc_id, ~has_id))  # those without an id come last
    place = np.empty(len(ids), np.int64)
    place[by] = np.arange(len(ids))
    named, doc_id, length = int(has_id.sum()), doc_id[by], np.array(lengths, np.int64)[by]
    table = packed(np.append(np.diff(doc_id[:named]), length[:named]))[0].tobytes()
    first = int(doc_id[0]).to_bytes(8, "little", signed=True)
    some = {"shard": [shard], "term": [None], "df": [int((length > 0).sum())], "tokens": [int(length.sum())], "data": [first + table]}
    yield pa.RecordBatch.from_pydict(some, schema=INDEX)

    doc = np.repeat(place, own)
    by = np.lexsort((doc, number))
    doc, number, tf = doc[by], number[by], tf[by]
    start = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else np.empty(0, np.int64)
    df = np.diff(np.append(start, len(number)))
    gap = np.append(0, doc[:-1])
    gap[start] = 0
    listed = doc < named
    data, end = packed(np.column_stack([doc - gap, tf])[listed].ravel())
    ends = np.append(0, end)[2 * np.cumsum(listed)[start + df - 1]] if len(start) else start
    offsets = np.append(0, ends).astype(np.int32)
    by = sorted(range(len(start)), key=vocabulary.__getitem__)  # files with ascending terms have narrow row groups
    postings = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    for k in range(0, len(by), 10_000):
        part = by[k : k + 10_000]
        columns = [pa.array([shard] * len(part), pa.int64()), pa.array([vocabulary[i].decode() for i in part], pa.string()), pa.array(df[part], pa.int64()), pa.nulls(len(part), pa.int64()), postings.take(pa.array(part))]
        yield pa.RecordBatch.from_arrays(columns, schema=INDEX)


def index_documents(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """shard, term, df, tokens, data: the postings of each term, and a row without a term for the documents of each shard.

    There, df counts the documents with a term and tokens all terms with repeats. Null and empty texts have
    no term; repeated rows are documents of their own; documents without an id count in df and tokens, but
    have no postings, since no result could name them. Other columns are ignored. No documents give no rows.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32

        def empty():
            return [], [], [], [], [], defaultdict(count().__next__)

        ids, lengths, own, number, tf, vocabulary = empty()

        def rows():
            arrays = (np.array(x, np.int64) for x in (own, number, tf))
            return _shard_rows(task, ids, lengths, list(vocabulary), *arrays)

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                times = Counter(terms(text.encode()))
                ids.append(doc_id)
                lengths.append(times.total())
                own.append(len(times))
                number.extend(map(vocabulary.__getitem__, times))
                tf.extend(times.values())
                if len(number) >= shard:
                    yield from rows()
                    task += 1
                    ids, lengths, own, number, tf, vocabulary = empty()
        if ids:
            yield from rows()

    return id_text(docs).mapInArrow(build, "shard long, term string, df long, tokens long, data binary")


class Best:
    """The ``k`` best documents: higher scores first, then smaller ids. ``needed``: a document below it can't be one of them."""

    def __init__(self, k: int):
        self.k, self.needed, self.heap = k, 1, []

    def offer(self, score: int, doc_id: int) -> None:
        if score < self.needed:
            return
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, (score, -doc_id))
        else:
            heapq.heappushpop(self.heap, (score, -doc_id))
        if len(self.heap) == self.k:
            self.needed = max(self.needed, self.heap[0][0])


def _some_kth(lists: list[tuple[np.ndarray, np.ndarray, int]], k: int) -> int:
    """The ``k``-th best score of the documents of the strongest lists that have k together, 0 if there are fewer.

    ``lists`` ascend by their greatest contribution. No k-th best of more documents is below it.
    """
    some = np.empty(0, np.int64)
    for docs, _, _ in reversed(lists):
        some = np.union1d(some, docs)
        if len(some) >= k:
            break
    else:
        return 0
    score = np.zeros(len(some), np.int64)
    for docs, gain, _ in lists:
        at = np.searchsorted(docs, some)
        at[at == len(docs)] = 0
        score += np.where(docs[at] == some, gain[at], 0)
    return int(np.partition(score, len(score) - k)[len(score) - k])


def merge(lists: list[tuple[np.ndarray, np.ndarray, int]], ids: np.ndarray, best: Best) -> None:
    """Offer ``best`` all documents that may belong there. A list: documents ascending, their contributions, the greatest of these."""
    lists = sorted((x for x in lists if x[2] > 0), key=lambda x: (x[2], -len(x[0])))
    best.needed = max(best.needed, _some_kth(lists, best.k))
    below = np.cumsum([top for *_, top in lists]).tolist()  # of the lists up to here, together

    def alone() -> int:
        """The first list that is merged: those before can't bring a document in together."""
        return bisect_left(below, best.needed)

    merged = alone()
    docs = [d.tolist() if i >= merged else d for i, (d, _, _) in enumerate(lists)]
    gain = [g.tolist() if i >= merged else g for i, (_, g, _) in enumerate(lists)]
    at = [0] * len(lists)
    cursors = [(docs[i][0], i) for i in range(merged, len(lists))]
    heapq.heapify(cursors)
    while cursors:
        doc, score = cursors[0][0], 0
        while cursors and cursors[0][0] == doc:
            i = cursors[0][1]
            score += gain[i][at[i]]
            at[i] += 1
            if at[i] < len(docs[i]):
                heapq.heapreplace(cursors, (docs[i][at[i]], i))
            else:
                heapq.heappop(cursors)
        for i in range(merged - 1, -1, -1):
            if score + below[i] < best.needed:
                break
            found = at[i] = bisect_left(docs[i], doc, at[i])
            if found < len(docs[i]) and docs[i][found] == doc:
                score += int(gain[i][found])
        if score >= best.needed:
            best.offer(score, int(ids[doc]))
            if (now := alone()) > merged:
                cursors = [(d, i) for d, i in cursors if i >= now]
                heapq.heapify(cursors)
                merged = now


def _searched(documents: int, tokens: int, top: int):
    """For mapInArrow: batches in order of block, then shard, the shard's table of documents first; gives each item's best."""

    def contributions(data: bytes, weight: int, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        pairs = unpacked(data).reshape(-1, 2)
        doc, tf = np.cumsum(pairs[:, 0]), pairs[:, 1]
        gain = weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm[doc]))
        return doc, gain, int(gain.max(initial=0))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, shard, best = None, None, {}
        ids = norm = None
        lists: dict[int, list] = {}

        def end_shard() -> None:
            for item, own in lists.items():
                merge(own, ids, best.setdefault(item, Best(top)))
            lists.clear()

        def result() -> pa.RecordBatch:
            rows = [(item, score, -minus) for item, b in best.items() for score, minus in b.heap]
            return pa.RecordBatch.from_pydict({"item": [r[0] for r in rows], "score": [r[1] for r in rows], "doc_id": [r[2] for r in rows]}, schema=FOUND)

        for batch in batches:
            for row in batch.to_pylist():
                if (row["block"], row["shard"]) != (block, shard):
                    end_shard()
                    if row["block"] != block and best:
                        yield result()
                        best = {}
                    block, shard = row["block"], row["shard"]
                if row["term"] is None:
                    table = unpacked(row["data"][8:])
                    named = (len(table) + 1) // 2
                    ids = np.cumsum(np.append(int.from_bytes(row["data"][:8], "little", signed=True), table[: named - 1])) if named else table
                    norm = 10 + (90 * table[max(named - 1, 0) :] * documents) // tokens
                    continue
                if row["data"]:
                    found = contributions(row["data"], row["weight"], norm)
                    for item in row["items"]:
                        lists.setdefault(item, []).append(found)
        end_shard()
        if best:
            yield result()

    return search


def _items(items: DataFrame, per_block: int) -> DataFrame:
    """item (a number for each row), item_id, block and its distinct terms: one row for each term, written."""
    schema = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("terms", pa.list_(pa.string()))])

    def make(batch: pa.RecordBatch) -> dict:
        return {"item": batch["item"], "item_id": batch["item_id"], "terms": [sorted({w.decode() for w in terms(t.encode())}) for t in batch["text"].to_pylist()]}

    named = saved(small_batches(items).select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")), "items")
    split = named.select(F.monotonically_increasing_id().alias("item"), "item_id", "text").mapInArrow(by_batch(make, schema), "item long, item_id long, terms array<string>")
    blocks = max(1, -(-named.count() // per_block))
    return saved(split.select("item", "item_id", F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), F.explode("terms").alias("term")), "terms")


def search(index: DataFrame, items: DataFrame, top: int = TOP, per_block: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of ``items`` (item_id, text) its best documents with a score above 0.

    ``index`` is a written table of ``index_documents``. Equal scores come by ascending doc_id. Items with
    null or empty texts find nothing; repeated items are searched each for itself, items without an id give
    rows with a null id. Repeated documents take ranks of their own. No items or no documents give no rows.
    """
    asked = _items(items, per_block)
    totals = index.filter("term is null").agg(F.sum("df").alias("documents"), F.sum("tokens").alias("tokens")).first()
    documents, tokens = totals.documents or 0, totals.tokens or 0
    wanted = asked.groupBy("term", "block").agg(F.sort_array(F.collect_list("item")).alias("items"))  # a block's items at most
    size = asked.agg(F.sum(F.octet_length("term") + 48)).first()[0] or 0
    small = F.broadcast if size <= BROADCAST else lambda df: df
    postings = index.filter("term is not null")
    df = postings.join(small(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("all_df"))
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2) / (2 * F.col("all_df") + 1))).cast("long")
    weighted = saved(wanted.join(df, "term").select(F.col("term").alias("asked"), "block", "items", weight.alias("weight")), "weights")
    found = postings.join(small(weighted), F.col("term") == F.col("asked")).select("block", "shard", "term", "weight", "items", "data")
    blocks = weighted.select("block").distinct().agg(F.sort_array(F.collect_list("block")).alias("blocks"))  # one row
    tables = index.filter("term is null").crossJoin(F.broadcast(blocks)).select(
        F.explode("blocks").alias("block"), "shard", "term", F.lit(None).cast("long").alias("weight"), F.lit(None).cast("array<long>").alias("items"), "data"
    )
    dealt = small_batches(tables.unionByName(found)).repartition("block", "shard").sortWithinPartitions("block", "shard", F.col("term").asc_nulls_first())
    best = dealt.mapInArrow(_searched(documents, tokens, top), "item long, score long, doc_id long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(asked.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")


def search_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The results of ``search`` over an index of ``docs`` made for it."""
    return search(saved(index_documents(docs), "index"), items)


#: The ten best documents of each item in DuckDB's SQL.
ORACLE_SQL = r"""
WITH split AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM split GROUP BY doc_id),
totals AS (SELECT count(*) AS documents, sum(n)::BIGINT AS tokens FROM lengths),
norms AS (SELECT doc_id, 10 + (90 * n * documents) // tokens AS m FROM lengths, totals),
postings AS (SELECT doc_id, term, count(*) AS tf FROM split SEMI JOIN asked USING (term) GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(documents) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term),
scored AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN norms USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""
