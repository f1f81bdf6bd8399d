"""Results of commands as versioned documents, and series read back from them.

A document is one row with its lists in it, in their fixed orders. It is an export for other tools: its lists are
bounded (``documents.LIMIT``), while the tables that the commands write and read have no bound. The small parts
(window, counters, coverage) are rows of one each, joined to the row that holds the lists.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DateType, StringType, StructType, TimestampType

from ..functions.text import iso_midnight
from ..operators import activity, lifecycle
from ..sources import documents

# How the documents name sources, selection rules and methods.
SOURCES = {"archive": "gh-archive", "metadata": "github"}
SELECTIONS = {"any-day": "minimum-daily-watch-events", "window-total": "minimum-window-watch-events"}
LIFECYCLE_METHOD = "repository-lifecycle-rules-v1"

_COUNTERS = (
    "raw_watch_events_seen", "unique_watch_events", "duplicate_event_ids", "missing_event_ids", "invalid_event_ids", "invalid_watch_events", "recovered_records", "malformed_records",
)


def iso(moment: datetime) -> str:
    return f"{moment:%Y-%m-%dT%H:%M:%S}.000Z"


def file_name(start: str, end: str, suffix: str = "") -> str:
    """The name of a document of a window; colons, which some stores refuse, become hyphens."""
    return f"{start}_{end}{suffix}.json".replace(":", "-")


def fitted(value: Column, have: DataType, want: DataType) -> Column:
    """``value`` in the shape ``want``: fields that it lacks are null, others are left out, times become ISO text."""
    if isinstance(want, StructType):
        if not isinstance(have, StructType):
            return F.lit(None).cast(want)
        fields = [fitted(value[f.name], have[f.name].dataType, f.dataType) if f.name in have.names else F.lit(None).cast(f.dataType) for f in want]
        return F.when(value.isNotNull(), F.struct(*(c.alias(f.name) for c, f in zip(fields, want, strict=True)))).cast(want)
    if isinstance(want, ArrayType) and isinstance(have, ArrayType):
        return F.transform(value, lambda x: fitted(x, have.elementType, want.elementType))
    if isinstance(want, StringType) and isinstance(have, TimestampType):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(want, StringType) and isinstance(have, DateType):
        return iso_midnight(value)
    return value.cast(want)


def _type(spark: SparkSession, version: str, *path: str) -> DataType:
    """The declared type of a field of a document, lists set aside."""
    kind: DataType = spark.createDataFrame([], documents.SCHEMAS[version]).schema
    for name in path:
        kind = kind[name].dataType
        kind = getattr(kind, "elementType", kind)
    return kind


def _document(row: DataFrame, version: str) -> DataFrame:
    """``row`` with the columns of ``version``, by name at every level, and its file ``name``."""
    kind = _type(row.sparkSession, version)
    return row.select("name", *(fitted(F.col(f.name), row.schema[f.name].dataType, f.dataType).alias(f.name) for f in kind if f.name in row.columns))


def _together(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Frames of one row each as one row; all but the first are small."""
    return reduce(lambda a, b: a.join(F.broadcast(b)), others, first)


def _integrity() -> Column:
    return F.struct(F.lit(True).alias("deduplication_applied"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTERS))


def _problems(errors: DataFrame) -> DataFrame:
    """coverage_errors: archive errors, then those of metadata, by target."""
    source = reduce(lambda c, s: c.when(F.col("source") == s[0], s[1]), SOURCES.items(), F.when(F.lit(False), "")).otherwise(F.col("source"))
    fields = {"source": source, "target": F.col("target"), "status": F.lit(None).cast("int"), "message": F.col("message")}
    return documents.listed(errors, fields, [F.col("source"), F.col("target"), F.col("message")], "coverage_errors")


def _profile(rows: DataFrame, kind: DataType) -> Column:
    """Metadata of a row of ``activity.enriched``; null where there are none."""
    return fitted(F.col("current"), rows.schema["current"].dataType, kind) if "current" in rows.columns else F.lit(None).cast(kind)


def candidate_document(found: dict[str, DataFrame], start: datetime, hours: int) -> DataFrame:
    """The row of a ``candidate-v1`` document from the tables of ``commands.discover``, and its file ``name``."""
    spark, version = found["candidates"].sparkSession, "candidate-v1"
    rows, first, end = found["candidates"], iso(start), iso(start + timedelta(hours=hours))
    fields = {
        "full_name": F.col("full_name"), "watch_events": F.col("n").cast("long"), "first_seen_at": F.col("first_seen_at"), "last_seen_at": F.col("last_seen_at"),
        "github": _profile(rows, _type(spark, version, "repositories", "github")),
    }
    listed = documents.listed(rows, fields, [-F.col("n"), F.col("full_name")], "repositories")
    read = found["progress"].agg(F.coalesce(F.sum("files"), F.lit(0)).cast("long").alias("hours_collected"))
    counters = found["integrity"].select(_integrity().alias("event_integrity"))
    every = _together(listed, _problems(found["errors"]), counters, read, found["seen"].select(F.col("entities").alias("repositories_seen"), F.col("events").alias("watch_events_seen")))
    none = F.lit(None)
    source = F.struct(
        F.lit(SOURCES["archive"]).alias("type"), (F.size("coverage_errors") == 0).alias("coverage_complete"), F.lit(hours).cast("long").alias("hours_requested"), "hours_collected", "watch_events_seen",
        "repositories_seen", "event_integrity", none.cast("boolean").alias("github_authenticated"), none.cast(_type(spark, version, "source", "github_rate_limit")).alias("github_rate_limit"), "coverage_errors",
    )
    window = F.struct(F.lit(first).alias("from"), F.lit(end).alias("to"))
    return _document(every.select(F.lit(file_name(first, end)).alias("name"), window.alias("window"), source.alias("source"), "repositories"), version)


def series_document(series: dict[str, DataFrame]) -> DataFrame:
    """The row of an ``activity-series-v1`` document from the tables of ``commands.backfill`` or ``commands.enrich``, and its file ``name``."""
    spark, version = series["activity"].sparkSession, "activity-series-v1"
    rows, rich = series["activity"], "current" in series["activity"].columns
    dated = series["days"].select("date", "hours_collected", "events", F.col("complete").alias("day_complete"))
    by_day = series["integrity"].filter("date is not null").select(F.col("date").alias("date_"), _integrity().alias("event_integrity"))
    zero = F.struct(F.lit(True).alias("deduplication_applied"), *(F.lit(0).cast("long").alias(c) for c in _COUNTERS))
    days = documents.listed(
        dated.join(by_day, F.col("date") == F.col("date_"), "left"),
        {
            "date": F.col("date").cast("string"), "hours_requested": F.lit(activity.HOURS_A_DAY), "hours_collected": F.col("hours_collected").cast("int"), "coverage_complete": F.col("day_complete"),
            "watch_events_observed": F.col("events").cast("long"), "event_integrity": F.coalesce("event_integrity", zero),
        },
        [F.col("date")],
        "days",
    )
    whole = dated.agg(
        F.min("date").alias("first"), F.date_add(F.max("date"), 1).alias("end"), F.count(F.lit(1)).cast("int").alias("n_days"), F.sum("hours_collected").cast("long").alias("hours"),
        F.sum("events").cast("long").alias("watches"), F.bool_and("day_complete").alias("archive_complete"),
    )
    known = dated.select(F.col("date").alias("date_"), "day_complete")
    point = F.struct(F.col("date").cast("string").alias("date"), F.col("n").cast("long").alias("watch_events_observed"), F.col("day_complete").alias("coverage_complete"))
    daily = series["daily"].join(F.broadcast(known), F.col("date") == F.col("date_")).groupBy(F.col("key").alias("key_")).agg(F.sort_array(F.collect_list(point)).alias("daily"))  # a window's days
    chosen = F.coalesce("metadata_selected", F.lit(False)) if rich else F.lit(False)
    fields = {
        "full_name": F.col("full_name"), "watch_events_observed_total": F.col("n").cast("long"), "observed_watch_velocity_per_day": F.col("velocity").cast("double"), "first_seen_at": F.col("first_seen_at"),
        "last_seen_at": F.col("last_seen_at"), "daily": F.col("daily"), "metadata_selected": chosen, "current": _profile(rows, _type(spark, version, "repositories", "current")),
    }
    listed = documents.listed(rows.join(daily, F.col("key") == F.col("key_")), fields, [-F.col("n"), F.col("full_name")], "repositories")
    got = rows.agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(chosen).alias("selected"), F.count_if(F.col("current").isNotNull() if rich else F.lit(False)).alias("collected"),
    )
    total = series["integrity"].filter("date is null").agg(*(F.max(c).alias(c) for c in _COUNTERS)).select(_integrity().alias("total_integrity"))
    rule = series["selection"].select("method", "least") if "selection" in series else spark.createDataFrame([(None, None)], "method string, least int")
    every = _together(listed, days, whole, got, total, _problems(series["errors"]), rule)
    none, kind = F.lit(None), _type(spark, version, "source", "metadata_selection")
    least = lambda method: F.when(F.col("method") == method, F.col("least").cast("long"))
    named = reduce(lambda c, s: c.when(F.col("method") == s[0], s[1]), SELECTIONS.items(), F.when(F.lit(False), ""))
    selection = F.struct(named.alias("method"), least("any-day"), least("window-total"), F.lit("full"), "selected", "collected", none.cast("string")).cast(kind)
    complete = F.col("selected") == F.col("collected")
    source = F.struct(
        F.lit("+".join(SOURCES.values()) if rich else SOURCES["archive"]).alias("type"), F.col("archive_complete").alias("archive_coverage_complete"), complete.alias("metadata_coverage_complete"),
        (F.col("archive_complete") & complete).alias("coverage_complete"), (F.col("n_days") * activity.HOURS_A_DAY).cast("long").alias("hours_requested"), F.col("hours").alias("hours_collected"),
        F.col("watches").alias("watch_events_observed"), F.col("seen").alias("repositories_seen"), F.col("total_integrity").alias("event_integrity"), none.cast("boolean").alias("github_authenticated"),
        none.cast(_type(spark, version, "source", "github_rate_limit")).alias("github_rate_limit"), (selection if rich else none.cast(kind)).alias("metadata_selection"), "coverage_errors",
    )
    window = F.struct(iso_midnight(F.col("first")).alias("from"), iso_midnight(F.col("end")).alias("to"), F.col("n_days").alias("days"))
    name = F.replace(F.concat(iso_midnight(F.col("first")), F.lit("_"), iso_midnight(F.col("end")), F.lit("-enriched.json" if rich else ".json")), F.lit(":"), F.lit("-"))
    return _document(every.select(name.alias("name"), window.alias("window"), source.alias("source"), "days", "repositories"), version)


def series_of(document: DataFrame) -> dict[str, DataFrame]:
    """The tables of a series from its ``activity-series-v1`` document (one row of ``documents.read``): what ``commands.enrich`` and ``commands.follow`` take.

    A document whose type names no metadata gives a raw series, of which nothing is selected yet. An archive that wasn't complete has one error
    at least, also where the document lists none.
    """
    doc = document.select("window", "source", "days", "repositories")
    rich = "+" in (doc.select("source.type").first()[0] or "")
    each = doc.select(F.explode("repositories").alias("r")).select(F.lower("r.full_name").alias("key"), "r.*")
    rows = each.select(
        "key", "full_name", F.col("watch_events_observed_total").alias("n"), "first_seen_at", "last_seen_at", F.col("observed_watch_velocity_per_day").alias("velocity"),
        *([F.coalesce("metadata_selected", F.lit(False)).alias("selected"), "metadata_selected", "current"] if rich else []),
    )
    days = doc.select(F.explode("days").alias("d")).select("d.*")
    counters = lambda value, date: [date.alias("date"), *(value[c].alias(c) for c in _COUNTERS)]
    told = doc.select(F.explode("source.coverage_errors").alias("e")).select("e.*")
    source = reduce(lambda c, s: c.when(F.col("source") == s[1], s[0]), SOURCES.items(), F.when(F.lit(False), "")).otherwise(F.col("source"))
    errors = told.select(source.alias("source"), "target", "message")
    count = lambda level: F.count_if(F.col("source") == level)
    least = doc.select("source.archive_coverage_complete", "source.metadata_coverage_complete")
    found = _together(least, errors.agg(count("archive").alias("archive"), count("metadata").alias("metadata")))
    level = lambda name: F.struct(F.lit(name).alias("level"), F.greatest(F.col(name), F.when(F.col(f"{name}_coverage_complete"), 0).otherwise(1)).cast("long").alias("errors"))
    levels = found.select(F.inline(F.array(level("archive"), *([level("metadata")] if rich else []))))
    selection = doc.select("source.metadata_selection.*").select(
        reduce(lambda c, s: c.when(F.col("method") == s[1], s[0]), SELECTIONS.items(), F.when(F.lit(False), "")).alias("method"),
        F.coalesce("minimum_daily_watch_events", "minimum_window_watch_events").cast("int").alias("least"),
    )
    return {
        "activity": rows,
        "daily": each.select("key", F.explode("daily").alias("d")).select("key", F.col("d.date").cast("date").alias("date"), F.col("d.watch_events_observed").alias("n")),
        "days": days.select(F.col("date").cast("date").alias("date"), F.col("hours_collected").cast("long"), F.col("watch_events_observed").alias("events"), F.col("coverage_complete").alias("complete"), F.when(F.col("event_integrity.deduplication_applied"), True).alias("verified")),
        "integrity": days.select(*counters(F.col("event_integrity"), F.col("date").cast("date"))).unionByName(doc.select(*counters(F.col("source.event_integrity"), F.lit(None).cast("date")))),
        "errors": errors,
        "coverage": levels.groupingSets([["level"], []], "level").agg(F.sum("errors").alias("errors")).withColumn("complete", F.col("errors") == 0),
    } | ({"selection": selection} if rich else {})


def lifecycle_document(followed: dict[str, DataFrame], inputs: list[tuple[str, dict[str, DataFrame]]], limits: dict[str, int] | None = None) -> DataFrame:
    """The row of a ``repository-lifecycle-v1`` document from the tables of ``commands.follow`` and its inputs by file name, and its file ``name``.

    Events have no ``reason``: the log tells what changed, not in words why.
    """
    limits = limits or lifecycle.rules()
    spark, version = followed["states"].sparkSession, "repository-lifecycle-v1"
    # tables were deduplicated when they were written; a document tells for each day (``verified``, else null)
    verified = lambda s: F.col("verified") if "verified" in s["days"].columns else F.lit(True)
    days = reduce(lambda a, b: a.unionByName(b), (s["days"].select("date", "hours_collected", F.col("complete").alias("records_complete"), verified(s).alias("verified")) for _, s in inputs))
    state = lifecycle.integrity_state(F.col("verified"))
    by_week = days.groupBy(F.to_date(F.date_trunc("week", "date")).alias("w_")).agg(state.alias("integrity_verification"))
    weeks = lifecycle.week_coverage(days).select(
        F.col("week").alias("w_"), "calendar_complete", F.col("hours_complete").alias("hour_coverage_complete"), F.col("records_complete").alias("record_coverage_complete"),
        F.col("coverage").alias("decision_coverage"),
    ).join(by_week, "w_")
    covered = ("calendar_complete", "hour_coverage_complete", "record_coverage_complete", "decision_coverage", "integrity_verification")
    span = {"from": iso_midnight(F.col("week")), "to": iso_midnight(F.date_add("week", 7))}
    listed_weeks = documents.listed(
        followed["summary"].select("week", "observed", "main", "scout", "breakout").join(weeks, F.col("week") == F.col("w_")),
        span
        | {c: F.col(c) for c in covered}
        | {"repositories_observed": F.col("observed"), "main_radar_repositories": F.col("main"), "emerging_scout_repositories": F.col("scout"), "fast_breakout_repositories": F.col("breakout")},
        [F.col("week")],
        "weeks",
    )
    kind = _type(spark, version, "repositories", "weeks")
    own = followed["weeks"].join(F.broadcast(weeks), F.col("week") == F.col("w_"))  # weeks of the whole window
    each = F.struct(
        *(c.alias(n) for n, c in span.items()), *covered, F.col("n"), F.col("max_daily"), F.col("active_days"), F.col("main"), F.col("scout"), F.col("breakout"), F.col("status"), F.col("breakout_status"),
        F.col("qualified"), F.col("below"),
    ).cast(kind)
    history = own.groupBy(F.col("key").alias("key_")).agg(F.transform(F.array_sort(F.collect_list(F.struct("week", each.alias("row")))), lambda x: x["row"]).alias("history"))
    found = followed["events"].filter(F.col("type") == "breakout_detected").groupBy(F.col("key").alias("key_")).agg(F.max("week").alias("breakout_at"))
    states = followed["states"].join(history, F.col("key") == F.col("key_"), "left").drop("key_").join(found, F.col("key") == F.col("key_"), "left").drop("key_")
    midnight = lambda c: iso_midnight(F.col(c))
    moment = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    fields = {
        "repository_id": F.col("id"), "full_name": F.col("full_name"), "aliases": F.array_sort("aliases"), "availability_status": F.col("availability"), "radar_status": F.col("status"),
        "first_observed_at": moment("first_at"), "last_observed_at": moment("last_at"), "first_detected_at": midnight("first_detected"), "state_changed_at": midnight("changed_at"),
        "last_qualified_week": midnight("last_qualified"), "consecutive_qualified_weeks": F.col("qualified"), "consecutive_below_scout_weeks": F.col("below"), "fast_breakout": F.col("fast_ever"),
        "breakout_status": F.col("breakout_status"), "breakout_detected_at": midnight("breakout_at"), "weeks": F.coalesce("history", F.array().cast(f"array<{kind.simpleString()}>")),
    }
    by_name = [F.expr("collate(full_name, 'UNICODE_CI_AI')"), F.col("full_name"), F.col("key")]
    listed = documents.listed(states, fields, by_name, "repositories")
    who = followed["states"].select(F.col("key").alias("key_"), "id", "full_name")
    log = documents.listed(
        followed["events"].join(who, F.col("key") == F.col("key_")),
        {"repository_id": F.col("id"), "full_name": F.col("full_name"), "type": F.col("type"), "effective_week": midnight("week"), "previous_status": F.col("previous_status"), "next_status": F.col("next_status")},
        lifecycle.log_order("full_name"),
        "events",
    )
    parts = [
        s["days"].agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).cast("int").alias("days"), F.bool_and("complete").alias("complete"), lifecycle.integrity_state(verified(s)).alias("state")).select(
            F.struct(F.lit(n).alias("file_name"), midnight("first").alias("from"), iso_midnight(F.date_add("last", 1)).alias("to"), "days", F.col("complete").alias("archive_coverage_complete"), F.col("state").alias("integrity_verification")).alias(f"input{k}")
        )
        for k, (n, s) in enumerate(inputs)
    ]
    records = weeks.agg(F.bool_and("record_coverage_complete").alias("records"))
    every = _together(listed, listed_weeks, log, followed["window"], records, days.agg(state.alias("all_verified")), *parts)
    first, end = midnight("first"), iso_midnight(F.date_add("last", 1))
    method = F.struct(
        F.lit(LIFECYCLE_METHOD), F.lit(limits["main"]), F.lit(limits["scout"]), F.lit(limits["breakout"]), F.lit(lifecycle.CONFIRMING_WEEKS), F.lit(lifecycle.INACTIVATING_WEEKS)
    ).cast(_type(spark, version, "methodology"))
    snapshots = F.array(*(F.col(f"input{k}") for k in range(len(inputs))))
    source = F.struct(F.lit("activity-series-v1").alias("input_schema_version"), snapshots.alias("input_snapshots"), F.col("records").alias("coverage_complete"), F.col("all_verified").alias("integrity_verification"))
    name = F.replace(F.concat(first, F.lit("_"), end, F.lit(".json")), F.lit(":"), F.lit("-"))
    window = F.struct(first.alias("from"), end.alias("to"))
    return _document(every.select(name.alias("name"), end.alias("generated_at"), window.alias("window"), method.alias("methodology"), source.alias("source"), "weeks", "repositories", "events"), version)
