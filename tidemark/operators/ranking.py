"""Total ranks without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import saved


#: Rows of a range, for windows over few rows that may span a very large group.
RANGE = 1 << 16


def in_ranges(rows: DataFrame, order: list[Column], before: int, size: int = RANGE) -> DataFrame:
    """``rows`` with ``_range`` and ``_carried``: ranges of ``size`` rows in the order, each with a copy of the ``before`` rows that precede it.

    A window of ``before`` rows back can be partitioned by ``_range`` too, so that a group of any size is spread over
    tasks; the copies (``_carried``) are dropped after it.
    """
    if before > size:
        raise ValueError("a range must hold the rows that are carried on")
    of = F.floor((F.col("_place") - 1) / size)
    copies = F.when(F.col("_place") > (of + 1) * size - before, F.array(of, of + 1)).otherwise(F.array(of))
    return dense_places(rows, order, "_place").withColumn("_range", F.explode(copies)).withColumn("_carried", F.col("_range") > of).drop("_place")


def dense_places(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... over the total order ``order``.

    Rows are dealt to tasks by ranges of the order and numbered there; what the ranges before hold is
    then added. Only one count for each range meets in a single task.
    """
    return numbered(rows.repartitionByRange(*order).sortWithinPartitions(*order), name)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... in the order in which they come, by partitions."""
    cut = saved(rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)), "ranked")
    before = F.sum("n_").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("n_"))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_offset"))
    return cut.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_at") + 1).drop("_part", "_at", "_offset")  # one row a task
