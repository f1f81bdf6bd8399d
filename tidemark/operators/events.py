"""Raw records to accepted events: reasons for rejection, running deduplication, integrity counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The accepted type and action, the formats of ids and names, the reasons in their order.
EVENT_TYPE = "WatchEvent"
ACTION = "started"
ID_FORMAT = r"^[1-9][0-9]*\z"
NAME_FORMAT = r"^[A-Za-z0-9][A-Za-z0-9-]{0,38}/[A-Za-z0-9._-]+\z"
REASONS = ["missing-event-id", "invalid-event-id", "invalid-action", "invalid-repository", "invalid-created-at", "outside-hour"]

#: What the archive source gives, and what the operators below read.
RECORD = (
    "hour timestamp, line long, line_end long, kind string, recovered_lines int, message string, "
    "type string, id string, id_type string, action string, name string, created_at string"
)


def inside_hour(ts: Column, hour: Column) -> Column:
    """From the hour on, before the next."""
    return (ts >= hour) & (ts < hour + F.expr("interval 1 hour"))


def validated(records: DataFrame) -> DataFrame:
    """``records`` with status (ignored, invalid, watch, parse-error), reason, event_id and ts.

    A record fails for the first reason that holds: no id, an id that isn't a string of digits, another
    action, a name or time that isn't a string, a time that can't be read, a name of another form, a time
    outside the file's hour. Columns ``name`` and ``created_at`` are null where the JSON value wasn't a
    string; ``id_type`` is the JSON type of the id, null if absent.
    """
    ts = F.try_to_timestamp("created_at")
    good_id = (F.col("id_type") == "string") & F.col("id").rlike(ID_FORMAT)
    reason = (
        F.when(F.col("id_type").isNull() | (F.col("id_type") == "null"), REASONS[0])
        .when(~F.coalesce(good_id, F.lit(False)), REASONS[1])
        .when(~F.coalesce(F.col("action") == ACTION, F.lit(False)), REASONS[2])
        .when(F.col("name").isNull(), REASONS[3])
        .when(ts.isNull(), REASONS[4])
        .when(~F.col("name").rlike(NAME_FORMAT), REASONS[3])
        .when(~inside_hour(ts, F.col("hour")), REASONS[5])
    )
    watch = (F.col("kind") == "event") & F.coalesce(F.col("type") == EVENT_TYPE, F.lit(False))
    status = F.when(F.col("kind") == "parse-error", "parse-error").when(~watch, "ignored").when(reason.isNotNull(), "invalid").otherwise("watch")
    return records.withColumns({"status": status, "reason": F.when(watch, reason), "event_id": F.when(watch & good_id, F.col("id")), "ts": F.when(watch, ts)})


def deduplicated(events: DataFrame) -> DataFrame:
    """``events`` whose status is ``duplicate`` where an earlier valid event has the id.

    Only valid events register their id; later records with it are duplicates even if they are invalid.
    Order is file hour, then line. Records without a usable id are left alone and aren't shuffled by it.
    """
    before = Window.partitionBy("event_id").orderBy("hour", "line").rowsBetween(Window.unboundedPreceding, -1)
    named = events.filter("event_id is not null")
    seen = F.coalesce(F.sum(F.when(F.col("status") == "watch", 1).otherwise(0)).over(before), F.lit(0)) > 0
    marked = named.withColumn("status", F.when(seen, "duplicate").otherwise(F.col("status"))).withColumn("reason", F.when(F.col("status") != "duplicate", F.col("reason")))
    return marked.unionByName(events.filter("event_id is null"))


def integrity(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The eight counters, for each value of ``by`` and over all rows (``by`` null): one pass."""
    count = lambda condition, name: F.count_if(condition).alias(name)
    status, reason = F.col("status"), F.col("reason")
    counters = [
        count(status.isin("watch", "duplicate", "invalid"), "raw_watch_events_seen"),
        count(status == "watch", "unique_watch_events"),
        count(status == "duplicate", "duplicate_event_ids"),
        count((status == "invalid") & (reason == REASONS[0]), "missing_event_ids"),
        count((status == "invalid") & (reason == REASONS[1]), "invalid_event_ids"),
        count(status == "invalid", "invalid_watch_events"),
        count(F.coalesce(F.col("recovered_lines"), F.lit(0)) > 1, "recovered_records"),
        count(status == "parse-error", "malformed_records"),
    ]
    return events.groupingSets([[F.col(c) for c in by], []], *by).agg(*counters) if by else events.agg(*counters)


def coverage_errors(events: DataFrame) -> DataFrame:
    """source, target (<hour>#line-<n>), message: one row for each malformed or invalid record."""
    target = F.format_string("%s#line-%d", F.date_format("hour", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.col("line"))
    bad = events.filter(F.col("status").isin("parse-error", "invalid"))
    return bad.select(F.lit("archive").alias("source"), target.alias("target"), F.coalesce("reason", "message").alias("message"))
