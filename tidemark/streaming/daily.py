"""The archive's events as a stream: deduplicated and counted by day as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.events import validated


def accepted(records: DataFrame, late: str = "2 hours") -> DataFrame:
    """Valid events of a stream of records, each id once within the watermark.

    A stream can't order the whole window, so an id counts as seen by its first valid event in arrival
    order, and is forgotten once it is later than ``late``; batch runs remember it for the whole window.
    """
    watches = validated(records).filter("status = 'watch'")
    return watches.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def daily_counts(records: DataFrame, late: str = "2 hours") -> DataFrame:
    """key, date, n of every UTC day; a day is final once the watermark has passed its end."""
    days = accepted(records, late).groupBy(F.window("ts", "1 day"), F.lower("name").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return days.select("key", F.to_date("window.start").alias("date"), "n")


def weekly_counts(records: DataFrame, late: str = "2 hours") -> DataFrame:
    """key, week, n of every Monday week."""
    weeks = accepted(records, late).groupBy(F.window("ts", "7 days", startTime="4 days"), F.lower("name").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return weeks.select("key", F.to_date("window.start").alias("week"), "n")
