"""Places and sizes of districts and buildings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import RANGE, dense_places, in_ranges

# Factors of the pseudo-random numbers, cell, padding, least sizes, districts in a row, gap between districts, height of the ground.
SPREAD = (12.9898, 78.233, 43758.5453)
CELL, PADDING, LEAST_WIDTH, LEAST_DEPTH, COLUMNS, GAP, GROUND = 5.6, 5.0, 14.0, 11.0, 4, 7.0, 0.5


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def height(watches: Column) -> Column:
    return clamp(2.8 + 1.8 * F.log2(watches + 1), 3.5, 15.0)


def width(stars: Column) -> Column:
    return clamp(1.6 + 0.5 * F.log10(stars + 1), 1.8, 4.4)


def depth(forks: Column) -> Column:
    return clamp(1.6 + 0.45 * F.log10(forks + 1), 1.8, 4.0)


def facade(commits: Column, most: Column) -> dict[str, Column]:
    """level, density and glow: unknown, none, or relative to the most active."""
    share = F.log1p(commits) / F.log1p(F.greatest(F.lit(1), most))
    return {
        "density": F.when(commits.isNull(), 0).when(commits == 0, 1).otherwise(F.least(F.greatest(2 + F.floor(3 * share), F.lit(2)), F.lit(5))).cast("int"),
        "glow": F.when(commits.isNull(), 0.18).when(commits == 0, 0.24).otherwise(0.35 + 1.4 * share),
    }


def most_commits(rows: DataFrame) -> DataFrame:
    return rows.agg(F.greatest(F.lit(1), F.max(F.coalesce("commits", F.lit(0)))).alias("most"))


def facade_windows(rows: DataFrame) -> DataFrame:
    """district, windows: four for each level of density, at least one level."""
    return rows.groupBy("district").agg(F.sum(F.greatest(F.lit(1), F.col("density")) * 4).alias("windows"))


def grid(n: Column) -> dict[str, Column]:
    """columns, rows, width and depth of a district with ``n`` buildings."""
    columns = F.ceil(F.sqrt(F.greatest(F.lit(1), n)))
    rows = F.greatest(F.lit(1), F.ceil(n / columns))
    return {
        "columns": columns,
        "rows": rows,
        "width": F.greatest(F.lit(LEAST_WIDTH), columns * CELL + PADDING),
        "depth": F.greatest(F.lit(LEAST_DEPTH), rows * CELL + PADDING),
    }


def place_districts(counts: DataFrame) -> DataFrame:
    """district, n, place (0, 1, ...) to x, z, width, depth, columns and rows.

    Districts fill rows of four; rows are centred on z by their deepest district, districts on x. They
    are a small dimension, so prefix sums over all rows run in one task.
    """
    sized = counts.withColumns(grid(F.col("n"))).withColumn("line", F.floor(F.col("place") / COLUMNS))
    line, before = Window.partitionBy("line"), Window.partitionBy("line").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumns(
        {
            "line_width": F.sum("width").over(line) + (F.count(F.lit(1)).over(line) - 1) * GAP,
            "line_depth": F.max("depth").over(line),
            "left": F.coalesce(F.sum(F.col("width") + GAP).over(before), F.lit(0.0)),
        }
    )
    lines = sized.select("line", "line_depth").distinct()
    every, above = Window.partitionBy(), Window.orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.select(
        "line",
        (F.sum("line_depth").over(every) + (F.count(F.lit(1)).over(every) - 1) * GAP).alias("total"),
        F.coalesce(F.sum(F.col("line_depth") + GAP).over(above), F.lit(0.0)).alias("top"),
    )
    return sized.join(lines, "line").select(
        "district",
        "n",
        "place",
        (-F.col("line_width") / 2 + F.col("left") + F.col("width") / 2).alias("x"),
        (-F.col("total") / 2 + F.col("top") + F.col("line_depth") / 2).alias("z"),
        "width",
        "depth",
        "columns",
        "rows",
    )


def cells(members: DataFrame) -> DataFrame:
    """``members`` with ``cell``: 0, 1, ... in each district by community, then id."""
    placed = dense_places(members, [F.col("district"), F.col("community"), F.col("id")], "_place")
    first = placed.groupBy("district").agg(F.min("_place").alias("_first")).withColumnRenamed("district", "district_")
    return placed.join(first, F.col("district").eqNullSafe(F.col("district_"))).withColumn("cell", F.col("_place") - F.col("_first")).drop("district_", "_place", "_first")


def place_buildings(members: DataFrame, districts: DataFrame) -> DataFrame:
    """id, x, y, z, width, depth, height from id, district, community, watches, stars, forks."""
    home = districts.select("district", F.col("x").alias("dx"), F.col("z").alias("dz"), "columns", "rows")
    column, row = F.col("cell") % F.col("columns"), F.floor(F.col("cell") / F.col("columns"))
    tall = height(F.col("watches"))
    return cells(members).join(home, "district").select(
        "id",
        (F.col("dx") - (F.col("columns") - 1) * CELL / 2 + column * CELL).alias("x"),
        (GROUND + tall / 2).alias("y"),
        (F.col("dz") - (F.col("rows") - 1) * CELL / 2 + row * CELL).alias("z"),
        width(F.col("stars")).alias("width"),
        depth(F.col("forks")).alias("depth"),
        tall.alias("height"),
    )


def extents(placed: DataFrame) -> DataFrame:
    return placed.agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "z") for n, f in (("min", F.min), ("max", F.max))))


def frame_percentiles(samples: DataFrame, *shares: float) -> DataFrame:
    """kind, mean and the sample at floor(n share) of the sorted samples.

    The sample is found by its rank from counts of equal values, so no group is collected.
    """
    counts = samples.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("kind").orderBy("value")
    placed = counts.withColumns({"upto": F.sum("n").over(order), "total": F.sum("n").over(Window.partitionBy("kind"))})
    at = lambda share: F.min(F.when(F.col("upto") > F.least(F.col("total") - 1, F.floor(F.col("total") * share)), F.col("value")))
    return placed.groupBy("kind").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"), *(at(s).alias(f"p{round(s * 100)}") for s in shares))


def recent_frames(frames: DataFrame, warm_up_ms: float = 5000, longest_ms: float = 250, keep: int = 900, size: int = RANGE) -> DataFrame:
    """Samples after the warm-up, without long pauses, each with the mean of the last ``keep``.

    A kind's samples are spread over ranges of ``size`` rows, so that no kind is a single task's.
    """
    order, window = [F.col("kind"), F.col("at"), F.col("i")], Window.partitionBy("_range", "kind").orderBy("at", "i")
    starts = frames.groupBy(F.col("kind").alias("kind_")).agg(F.min("at").alias("start"))
    each = in_ranges(frames, order, 1, size).withColumn("delta", F.col("at") - F.lag("at").over(window)).filter("not _carried").drop("_range", "_carried")
    used = each.join(starts, F.col("kind") == F.col("kind_")).filter((F.col("at") - F.col("start") >= warm_up_ms) & (F.col("delta") < longest_ms))
    means = in_ranges(used, order, keep - 1, size).withColumn("mean", F.avg("delta").over(window.rowsBetween(1 - keep, 0)))
    return means.filter("not _carried").select("kind", "i", "delta", "mean")


def pseudo_random(i: Column) -> Column:
    """In [0, 1), fixed for each index."""
    x = F.sin(i * SPREAD[0] + SPREAD[1]) * SPREAD[2]
    return x - F.floor(x)
