"""Daily activity of entities: counts, dense series, coverage, selection, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOURS_A_DAY = 24


def calendar(spark, start: str, days: int) -> DataFrame:
    """One row for each day from ``start`` on: at most a few thousand rows."""
    if not 1 <= days <= 3660:
        raise ValueError("days must be from 1 to 3660")
    return spark.range(days).select(F.date_add(F.to_date(F.lit(start)), F.col("id").cast("int")).alias("date"))


def entity_totals(events: DataFrame) -> DataFrame:
    """key, name of the first record, n, first and last time as written.

    On equal times the earliest record (hour, then line) gives both the first and the last.
    """
    place = F.struct("hour", "line")
    late = F.struct(F.col("ts"), -F.unix_micros("hour"), -F.col("line"))
    return events.groupBy(F.lower("name").alias("key")).agg(
        F.min_by("name", place).alias("full_name"),
        F.count(F.lit(1)).alias("n"),
        F.min_by("created_at", F.struct("ts", "hour", "line")).alias("first_seen_at"),
        F.max_by("created_at", late).alias("last_seen_at"),
    )


def entity_counts(totals: DataFrame) -> DataFrame:
    """entities and events over all ``entity_totals``: one row."""
    return totals.agg(F.count(F.lit(1)).alias("entities"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("events"))


def daily_counts(events: DataFrame) -> DataFrame:
    """key, date, n; the day is that of the event's file."""
    return events.groupBy(F.lower("name").alias("key"), F.to_date("hour").alias("date")).agg(F.count(F.lit(1)).alias("n"))


def dense_daily(daily: DataFrame, days: DataFrame) -> DataFrame:
    """key, date, n for every key and every day of the calendar, 0 where nothing was observed.

    Each key expands by the calendar's days in its own task: the days are one array in every row, so
    there is no cross join and only the counts are shuffled, once.
    """
    dates = F.broadcast(days.agg(F.sort_array(F.collect_list("date")).alias("dates")))  # one row
    series = daily.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("date", "n"))).alias("counts"))
    dense = series.join(dates).select("key", "counts", F.explode("dates").alias("date"))
    return dense.select("key", "date", F.coalesce(F.try_element_at("counts", "date"), F.lit(0).cast("long")).alias("n"))


def day_coverage(hours: DataFrame) -> DataFrame:
    """From date, hour, n, errors (one row for each hour read): hours collected, events, complete."""
    return hours.groupBy("date").agg(
        F.countDistinct("hour").alias("hours_collected"),
        F.sum("n").alias("events"),
        ((F.countDistinct("hour") == HOURS_A_DAY) & (F.sum("errors") == 0)).alias("complete"),
    )


def window_coverage(days: DataFrame) -> DataFrame:
    return days.agg(F.count(F.lit(1)).alias("days"), F.sum("hours_collected").alias("hours_collected"), F.sum("events").alias("events"), F.bool_and("complete").alias("complete"))


def velocity(total: Column, days: Column, complete: Column) -> Column:
    """Events a day to four places; null (unknown) unless coverage is complete."""
    return F.when(complete, F.round(total / days, 4))


def any_day(daily: DataFrame, least: int = 5) -> DataFrame:
    """Keys with a day of at least ``least`` events."""
    return daily.groupBy("key").agg(F.max("n").alias("max_daily")).filter(F.col("max_daily") >= least)


def window_total(daily: DataFrame, least: int = 3) -> DataFrame:
    """Keys with at least ``least`` events in the window."""
    return daily.groupBy("key").agg(F.sum("n").alias("total")).filter(F.col("total") >= least)


def ranked(totals: DataFrame) -> DataFrame:
    return totals.orderBy(F.desc("n"), "full_name")


def top_candidates(totals: DataFrame, k: int = 10) -> DataFrame:
    """The k entities with most events, names breaking ties."""
    if not 1 <= k <= 100:
        raise ValueError("k must be from 1 to 100")
    return ranked(totals).limit(k)


# What each profile of metadata has beyond the entity's own record.
PROFILES = {
    "full": ("readme", "language_bytes", "language_share", "commits_30d", "contributors_count"),
    "classification": ("readme",),
    "screening": (),
}


def profiled(metadata: DataFrame, profile: str) -> DataFrame:
    """``metadata`` with the parts of a profile; the other parts are null and their columns aren't read."""
    if profile not in PROFILES:
        raise ValueError(f"a profile is one of {', '.join(PROFILES)}")
    left_out = set(PROFILES["full"]) - set(PROFILES[profile])
    return metadata.select(*(F.lit(None).cast(kind).alias(c) if c in left_out else F.col(c) for c, kind in metadata.dtypes))


def enriched(totals: DataFrame, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows of ``totals`` with metadata_selected and ``current``, their metadata, and a coverage row for each miss.

    Where ``totals`` has a column ``selected``, only selected rows get metadata or can miss it; the others
    keep null. ``metadata`` has one row for each full_name in any casing.
    """
    found = metadata.select(F.lower("full_name").alias("key_"), F.struct("*").alias("current"))
    asked = totals.withColumn("metadata_selected", F.col("selected") if "selected" in totals.columns else F.lit(True))
    joined = asked.join(found, (F.col("key") == F.col("key_")) & F.col("metadata_selected"), "left").drop("key_")
    missing = joined.filter("metadata_selected and current is null").select(F.lit("metadata").alias("source"), F.col("full_name").alias("target"), F.lit("metadata is missing").alias("message"))
    return joined, missing


def metadata_counts(rows: DataFrame) -> DataFrame:
    """selected, collected, complete over the rows of ``enriched``."""
    asked, got = F.count_if("metadata_selected"), F.count_if(F.col("metadata_selected") & F.col("current").isNotNull())
    return rows.agg(asked.alias("selected"), got.alias("collected"), (asked == got).alias("complete"))


def still_needed(selected: DataFrame, known: DataFrame) -> DataFrame:
    """Selected keys without metadata yet: what an incremental run has to fetch."""
    return selected.join(known.select("key"), "key", "left_anti")


def without_old_errors(errors: DataFrame, source: str = "metadata") -> DataFrame:
    """Errors of other sources: those of ``source`` are found again by a new run."""
    return errors.filter(F.col("source") != source)
