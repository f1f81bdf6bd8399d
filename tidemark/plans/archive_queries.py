"""The driver's events written as an hourly archive, with malformed and broken records, and read back by the data source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as ops
from ..scratch import new_path
from ..sources import hourly
from .registry import query, table

# Every 70th event but one is malformed; every 50th is broken in two lines inside a text.
_LINES = """
WITH placed AS (
    SELECT *, date_trunc('hour', ts) AS hour, CASE WHEN event_id % 70 = 1 THEN 'parse-error' ELSE 'event' END AS kind, CASE WHEN event_id % 70 <> 1 AND event_id % 50 = 0 THEN 2 ELSE 1 END AS n_lines FROM events),
records AS (SELECT *, CAST(1 + sum(n_lines) OVER (PARTITION BY hour ORDER BY event_id) - n_lines AS BIGINT) AS line FROM placed)
"""


def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of an archive made of ``events``."""
    rows = table(spark, sf_dir, "events").select("event_id", F.date_trunc("hour", "ts").alias("hour"), "ts", "user_id", "event_type")
    note = F.when(F.col("event_id") % 50 == 0, "first\nsecond").otherwise("note")
    kind = F.when(F.col("event_type") == "view", ops.EVENT_TYPE).otherwise("Other")
    text = F.concat(
        F.lit('{"id":"'), F.col("event_id"), F.lit('","type":"'), kind, F.lit('","repo":{"name":"owner/'), F.col("user_id"), F.lit('"},"note":"'), note,
        F.lit('","payload":{"action":"started"},"created_at":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"}'),
    )
    lines = rows.select("hour", F.col("event_id").alias("place"), F.when(F.col("event_id") % 70 == 1, "{oops").otherwise(text).alias("text"))
    folder = new_path(spark, "archive")
    hourly.write_hours(lines, folder)
    return hourly.registered(spark).read.format(hourly.NAME).load(folder)


_HOUR = "strftime(hour, '%Y-%m-%d %H')"


def hour_text() -> F.Column:
    return F.date_format("hour", "yyyy-MM-dd HH").alias("hour")


@query("s1_hourly_source", _LINES + f"SELECT {_HOUR} AS hour, line, kind, CASE WHEN kind = 'event' THEN CAST(event_id AS VARCHAR) END AS id FROM records")
def s1(spark, sf_dir):
    return archived(spark, sf_dir).select(hour_text(), "line", "kind", "id")


@query("s3_recovered_records", _LINES + f"SELECT {_HOUR} AS hour, line, CAST(event_id AS VARCHAR) AS id, n_lines AS recovered_lines FROM records WHERE n_lines = 2")
def s3(spark, sf_dir):
    return archived(spark, sf_dir).filter("recovered_lines is not null").select(hour_text(), "line", "id", "recovered_lines")


@query("s4_lenient_parse", _LINES + f"SELECT {_HOUR} AS hour, count(*) FILTER (kind = 'event') AS records, count(*) FILTER (kind = 'parse-error') AS errors FROM records GROUP BY 1")
def s4(spark, sf_dir):
    """Malformed lines don't keep the lines after them from being read."""
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return archived(spark, sf_dir).groupBy(hour_text()).agg(count("event").alias("records"), count("parse-error").alias("errors"))


@query(
    "s5_pushed_hours",
    _LINES + f", bounds AS (SELECT min(hour) AS first FROM records) SELECT {_HOUR} AS hour, count(*) FILTER (kind = 'event' AND event_type = 'view') AS watches FROM records, bounds "
    "WHERE hour >= first + INTERVAL 24 HOUR AND hour < first + INTERVAL 48 HOUR GROUP BY 1",
)
def s5_pushed(spark, sf_dir):
    """A day of the archive: the filter on hours reaches the source, which opens the day's files only."""
    first = table(spark, sf_dir, "events").agg(F.min(F.date_trunc("hour", "ts")).alias("first")).first().first
    at = lambda hours: F.lit(first) + F.expr(f"interval {hours} hours")
    day = ops.validated(archived(spark, sf_dir).filter((F.col("hour") >= at(24)) & (F.col("hour") < at(48))))
    return day.groupBy(hour_text()).agg(F.count_if(F.col("status") == "watch").alias("watches"))
