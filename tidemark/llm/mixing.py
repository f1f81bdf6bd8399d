"""Mixing sources to target weights by Pfair scheduling.

A source's documents come in the order of a hash, which is cut into ranges of about one document each (in a
large corpus, of more: RANGES bounds their number). Consecutive ranges form blocks of about BLOCK characters; documents stay
whole. The clock counts characters. A source with share r and a characters before its block may
run it from clock a / r on (release), and should have run it by (a + size) / r (deadline). Whenever the
clock is free, the released block with the earliest deadline runs, for as many characters as it has. As
in weighted fair queueing with eligible packets, a source is then never ahead of its share by more than its
own block, nor behind by more than the largest block of all. A source that has no blocks left leaves its time
empty, so the others keep their proportions.

Only sizes of ranges and blocks reach the driver, at most RANGES and a few for each source, whatever the
corpus; the schedule goes back to the documents as a small table keyed by range. No text is shuffled to find its place.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved

#: Characters in a block, at most and at least, and blocks of the smallest source between these bounds.
BLOCK, BLOCK_LEAST, BLOCKS = 1 << 18, 1 << 10, 32
#: Without given weights, a source's weight is its size to this power.
TEMPERATURE = 0.7
#: Sources are a small dimension: more than this is an error, not a silent cut.
MAX_SOURCES = 10_000
#: Hash ranges of all sources together, at most, besides two for each source.
RANGES = 1 << 17


def schedule(blocks: list[list[int]], shares: list[float]) -> list[tuple[int, int, int, float, float]]:
    """(source, block, clock, release, deadline) in the order of running, from the sizes of each source's blocks."""
    given, number = [0] * len(blocks), [0] * len(blocks)
    waiting, ready, now, out = [(0.0, i) for i, b in enumerate(blocks) if b], [], 0, []
    while waiting or ready:
        if not ready and waiting[0][0] > now:
            now = -int(-waiting[0][0] // 1)
        while waiting and waiting[0][0] <= now:
            release, i = heapq.heappop(waiting)
            heapq.heappush(ready, ((given[i] + blocks[i][number[i]]) / shares[i], i, release))
        deadline, i, release = heapq.heappop(ready)
        out.append((i, number[i], now, release, deadline))
        size = blocks[i][number[i]]
        now, given[i], number[i] = now + size, given[i] + size, number[i] + 1
        if number[i] < len(blocks[i]):
            heapq.heappush(waiting, (given[i] / shares[i], i))
    return out


def packed(ranges: list[int], block: int) -> list[int]:
    """The block of each range, from their sizes: a block ends before it would be larger than ``block``."""
    out, held = [], 0
    for size in ranges:
        full = bool(out) and held + size > block
        held = size if full else held + size
        out.append((out[-1] if out else 0) + full)
    return out


def sized(docs: DataFrame) -> DataFrame:
    """What the schedule needs of ``docs``: doc_id, source, size and hash, written."""
    return saved(docs.select("doc_id", *_measures()), "sizes")


def _measures():
    return (
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("doc_id", "text").alias("hash"),
    )


def plan(sizes: DataFrame, weights: dict[str | None, float] | None = None, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(source_, i, ranges) of each source, and (i, range, block, slot, clock, release, deadline, share) of each range that has documents.

    ``slot`` numbers the blocks of all sources in the order of running, from 0.
    """
    spark = sizes.sparkSession
    found = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r.source is not None, r.source))
    weight = [weights.get(r.source, 0.0) if weights else max(r.size, 1) ** TEMPERATURE for r in found]
    if weights and (missing := [r.source for r, w in zip(found, weight, strict=True) if w <= 0]):
        raise ValueError(f"no positive weight for sources {missing}")
    each = max(1, -(-2 * sum(r.rows for r in found) // RANGES))
    sources = spark.createDataFrame([(r.source, i, -(-2 * r.rows // each)) for i, r in enumerate(found)], "source_ string, i int, ranges long")
    filled = ranged(sizes, sources).groupBy("i", "range").agg(F.sum("size").alias("sum")).collect()  # RANGES at most, and a few
    by_source: list[list[tuple[int, int]]] = [[] for _ in found]
    for r in filled:
        by_source[r.i].append((r.range, r["sum"]))
    block = block or max(BLOCK_LEAST, min([BLOCK, *(r.size // BLOCKS for r in found)]))
    of, blocks = [], []
    for ranges in by_source:
        ranges.sort()
        of.append(packed([size for _, size in ranges], block))
        blocks.append([0] * (of[-1][-1] + 1 if ranges else 0))
        for (_, size), k in zip(ranges, of[-1], strict=True):
            blocks[-1][k] += size
    share = [w / sum(weight) for w in weight]
    runs = {(i, k): (slot, clock, release, deadline) for slot, (i, k, clock, release, deadline) in enumerate(schedule(blocks, share))}
    rows = [(i, r, k, *runs[i, k], share[i]) for i, ranges in enumerate(by_source) for (r, _), k in zip(ranges, of[i], strict=True)]
    return sources, spark.createDataFrame(rows, "i int, range long, block long, slot long, clock long, release double, deadline double, share double")


def ranged(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` (source, hash, ...) with i and range, their place in the source's order of hashes."""
    named = rows.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("source_")))  # MAX_SOURCES rows at most
    return named.withColumn("range", F.expr("shiftright(shiftrightunsigned(hash, 33) * ranges, 31)")).drop("source_", "ranges")


def placed(rows: DataFrame, planned: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``rows`` (source, hash, ...) with block, slot, clock, release, deadline and share of their block, joined without a shuffle."""
    sources, slots = planned
    table = F.broadcast(slots.withColumnsRenamed({"i": "i_", "range": "range_"}))  # RANGES rows at most, and a few
    return ranged(rows, sources).join(table, (F.col("i") == F.col("i_")) & (F.col("range") == F.col("range_"))).drop("i", "i_", "range", "range_")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, hash, block, slot, clock, release, deadline and share.

    Reading the rows by slot, then hash (``order``) gives the mix. Null sources are a source of their own, null texts have size 0.
    No row is dropped or repeated. ``weights`` must name every source. Rows that agree in id and text have
    one size and one block, and take their places there in any order. Extra columns are ignored. No
    documents give no rows.
    """
    sizes = sized(docs)
    return placed(sizes, plan(sizes, weights, block))


def order() -> list:
    """The order of the mix: by slot, and in a block by the hash."""
    return [F.col("slot"), F.expr("shiftrightunsigned(hash, 1)"), F.col("hash")]


def mixed_documents(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int | None = None) -> DataFrame:
    """The rows of ``docs``, all of them and unchanged, in the order of the mix: part by part and row by row.

    Nulls, repeats and empty tables are as in ``mix``, whatever the columns are called. Texts move once.
    """
    planned = plan(sized(docs), weights, block)
    rows = placed(docs.select(F.struct("*").alias("row"), *_measures()), planned).select("row", "slot", "hash")
    return rows.repartitionByRange(*order()).sortWithinPartitions(*order()).select("row.*")


def positions(mixed: DataFrame) -> DataFrame:
    """``mixed``, as read from the files of ``mixed_documents``, with ``position``: 0, 1, ... in the order of the mix.

    The place follows from the file's part number and the row's index in the file, so it holds however
    readers split or pack the files. Only one count for each file meets in a single task.
    """
    files = mixed.select(F.col("_metadata.file_name").alias("_file")).groupBy("_file").agg(F.count(F.lit(1)).alias("n_"))
    part = F.regexp_extract("_file", r"part-(\d+)", 1).cast("long")
    before = F.sum("n_").over(Window.orderBy(part, "_file").rowsBetween(Window.unboundedPreceding, -1))
    offsets = files.select(F.col("_file").alias("_file_"), F.coalesce(before, F.lit(0)).alias("_offset"))
    rows = mixed.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    joined = rows.join(F.broadcast(offsets), F.col("_file") == F.col("_file_"))  # one row a file
    return joined.withColumn("position", (F.col("_offset") + F.col("_index")).cast("long")).drop("_file", "_file_", "_index", "_offset")


def mix_report(docs: DataFrame) -> DataFrame:
    return mix(docs)
