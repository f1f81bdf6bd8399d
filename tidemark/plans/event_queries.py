"""Validation, deduplication, daily activity, selection and enrichment over the driver's events.

An entity is ``owner/<user_id>``; a file's hour is the event's; faults are planted by the event's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import activity, events as ops
from ..operators.ranking import dense_places
from .registry import query, table

START, DAYS = "2024-01-01", 30

# The same raw records, for Spark and for the oracle.
_RAW = """
    SELECT date_trunc('hour', ts) AS hour, event_id AS line,
        CASE WHEN event_id % 97 = 0 THEN 'parse-error' ELSE 'event' END AS kind,
        CASE WHEN event_id % 31 = 0 THEN 2 WHEN event_id % 97 = 0 THEN NULL ELSE 1 END AS recovered_lines,
        CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'PushEvent' ELSE 'WatchEvent' END AS type,
        CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 43 = 0 THEN 'number' ELSE 'string' END AS id_type,
        CASE WHEN event_id % 47 = 0 THEN '0x1' WHEN event_id % 11 = 3 THEN CAST(event_id AS {text}) ELSE CAST(event_id + 1 AS {text}) END AS id,
        CASE WHEN event_id % 53 = 0 THEN 'stopped' ELSE 'started' END AS action,
        CASE WHEN event_id % 59 = 0 THEN NULL WHEN event_id % 61 = 0 THEN 'no name' WHEN event_id % 3 = 0 THEN concat('Owner/', user_id) ELSE concat('owner/', user_id) END AS name,
        CASE WHEN event_id % 67 = 0 THEN NULL WHEN event_id % 71 = 0 THEN 'soon' WHEN event_id % 73 = 0 THEN {late} ELSE {time} END AS created_at
    FROM events
"""
_SPARK = _RAW.format(
    text="STRING",
    time="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")",
    late="date_format(ts + INTERVAL 2 HOURS, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")",
)
_DUCK = _RAW.format(text="VARCHAR", time="strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')", late="strftime(ts + INTERVAL 2 HOURS, '%Y-%m-%dT%H:%M:%S.%fZ')")

_VALID = f"""
WITH raw AS ({_DUCK}),
timed AS (SELECT *, try_cast(created_at AS TIMESTAMP) AS ts FROM raw),
checked AS (
    SELECT *, kind = 'event' AND type = 'WatchEvent' AS watch,
        CASE WHEN id_type IS NULL THEN 'missing-event-id'
            WHEN id_type <> 'string' OR NOT regexp_full_match(id, '[1-9][0-9]*') THEN 'invalid-event-id'
            WHEN action <> 'started' THEN 'invalid-action'
            WHEN name IS NULL THEN 'invalid-repository'
            WHEN ts IS NULL THEN 'invalid-created-at'
            WHEN NOT regexp_full_match(name, '[A-Za-z0-9][A-Za-z0-9-]{{0,38}}/[A-Za-z0-9._-]+') THEN 'invalid-repository'
            WHEN ts < hour OR ts >= hour + INTERVAL 1 HOUR THEN 'outside-hour' END AS why
    FROM timed),
validated AS (
    SELECT *, CASE WHEN kind = 'parse-error' THEN 'parse-error' WHEN watch IS NOT TRUE THEN 'ignored' WHEN why IS NOT NULL THEN 'invalid' ELSE 'watch' END AS status,
        CASE WHEN watch THEN why END AS reason,
        CASE WHEN watch AND id_type = 'string' AND regexp_full_match(id, '[1-9][0-9]*') THEN id END AS event_id
    FROM checked),
inspected AS (
    SELECT * EXCLUDE (status, reason), reason AS old_reason,
        CASE WHEN event_id IS NOT NULL AND coalesce(sum(CASE WHEN status = 'watch' THEN 1 ELSE 0 END)
            OVER (PARTITION BY event_id ORDER BY hour, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN 'duplicate' ELSE status END AS status
    FROM validated),
events_ AS (SELECT *, CASE WHEN status <> 'duplicate' THEN old_reason END AS reason FROM inspected),
watches AS (SELECT *, lower(name) AS key, CAST(hour AS DATE) AS date FROM events_ WHERE status = 'watch'),
daily AS (SELECT key, date, count(*) AS n FROM watches GROUP BY ALL)
"""

_COUNTERS = """
    count(*) FILTER (status IN ('watch', 'duplicate', 'invalid')) AS raw_watch_events_seen,
    count(*) FILTER (status = 'watch') AS unique_watch_events,
    count(*) FILTER (status = 'duplicate') AS duplicate_event_ids,
    count(*) FILTER (status = 'invalid' AND reason = 'missing-event-id') AS missing_event_ids,
    count(*) FILTER (status = 'invalid' AND reason = 'invalid-event-id') AS invalid_event_ids,
    count(*) FILTER (status = 'invalid') AS invalid_watch_events,
    count(*) FILTER (coalesce(recovered_lines, 0) > 1) AS recovered_records,
    count(*) FILTER (status = 'parse-error') AS malformed_records
"""
_CALENDAR = f"SELECT CAST(d AS DATE) AS date FROM generate_series(DATE '{START}', DATE '{START}' + {DAYS - 1}, INTERVAL 1 DAY) g(d)"


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return spark.sql(_SPARK.replace("FROM events", "FROM {events}").replace("{{", "{"), events=events)


def inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.deduplicated(ops.validated(raw_records(spark, sf_dir)))


def watches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspected(spark, sf_dir).filter("status = 'watch'")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.daily_counts(watches(spark, sf_dir))


def calendar(spark: SparkSession) -> DataFrame:
    return activity.calendar(spark, START, DAYS)


@query("p2_validation_reasons", _VALID + "SELECT status, reason, count(*) AS n FROM (SELECT status, reason FROM validated) GROUP BY ALL")
def p2(spark, sf_dir):
    return ops.validated(raw_records(spark, sf_dir)).groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("w1_running_dedup", _VALID + "SELECT line, status, reason, event_id FROM events_ WHERE status <> 'ignored'")
def w1(spark, sf_dir):
    return inspected(spark, sf_dir).filter("status <> 'ignored'").select("line", "status", "reason", "event_id")


@query("a7_integrity_grouping_sets", _VALID + f"SELECT CAST(CAST(hour AS DATE) AS VARCHAR) AS date, {_COUNTERS} FROM events_ GROUP BY GROUPING SETS ((CAST(hour AS DATE)), ())")
def a7(spark, sf_dir):
    dated = inspected(spark, sf_dir).withColumn("date", F.to_date("hour").cast("string"))
    return ops.integrity(dated, ["date"])


@query(
    "f32_coverage_errors",
    _VALID + "SELECT 'archive' AS source, strftime(hour, '%Y-%m-%dT%H:%M:%S.000Z') || '#line-' || line AS target, reason AS message FROM events_ WHERE status IN ('parse-error', 'invalid')",
)
def f32(spark, sf_dir):
    return ops.coverage_errors(inspected(spark, sf_dir).withColumn("message", F.lit(None).cast("string")))


@query("s2_hour_files", "SELECT DISTINCT strftime(ts, '%Y-%m-%d-') || hour(ts) || '.json.gz' AS file FROM events")
def s2(spark, sf_dir):
    from ..sources.archive import hour_file

    return table(spark, sf_dir, "events").select(hour_file(F.date_trunc("hour", "ts")).alias("file")).distinct()


@query("s5_hour_window", _VALID + "SELECT hour(hour) AS hour, count(*) AS n FROM watches WHERE hour >= TIMESTAMP '2024-01-03 06:00:00' AND hour < TIMESTAMP '2024-01-04 06:00:00' GROUP BY ALL")
def s5(spark, sf_dir):
    from ..sources.archive import hour_window

    first, last = hour_window("2024-01-03T06:00:00Z", 24)
    rows = watches(spark, sf_dir).filter((F.col("hour") >= first) & (F.col("hour") < last))
    return rows.groupBy(F.hour("hour").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a1_repo_first_last",
    _VALID + "SELECT key, arg_min(name, struct_pack(hour, line)) AS full_name, count(*) AS n, arg_min(created_at, struct_pack(ts, hour, line)) AS first_seen_at, "
    "arg_max(created_at, struct_pack(ts, h := -epoch_us(hour), l := -line)) AS last_seen_at FROM watches GROUP BY key",
)
def a1(spark, sf_dir):
    return activity.entity_totals(watches(spark, sf_dir))


@query("a2_daily_counts", _VALID + "SELECT key, CAST(date AS VARCHAR) AS date, n FROM daily")
def a2(spark, sf_dir):
    return daily(spark, sf_dir).withColumn("date", F.col("date").cast("string"))


@query(
    "a3_dense_daily",
    _VALID + f", days AS ({_CALENDAR}) SELECT key, CAST(date AS VARCHAR) AS date, coalesce(n, 0) AS n FROM (SELECT DISTINCT key FROM daily) CROSS JOIN days LEFT JOIN daily USING (key, date)",
)
def a3(spark, sf_dir):
    return activity.dense_daily(daily(spark, sf_dir), calendar(spark)).withColumn("date", F.col("date").cast("string"))


_HOURS = """, hours AS (SELECT CAST(hour AS DATE) AS date, hour, count(*) FILTER (status = 'watch') AS n, count(*) FILTER (status = 'parse-error' AND line % 3 = 0) AS errors FROM events_ GROUP BY ALL),
covered AS (SELECT date, count(DISTINCT hour) AS hours_collected, sum(n) AS events, count(DISTINCT hour) = 24 AND sum(errors) = 0 AS complete FROM hours GROUP BY date)
"""


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspected(spark, sf_dir).groupBy(F.to_date("hour").alias("date"), "hour").agg(
        F.count_if(F.col("status") == "watch").alias("n"), F.count_if((F.col("status") == "parse-error") & (F.col("line") % 3 == 0)).alias("errors")
    )


@query("a5_day_coverage", _VALID + _HOURS + "SELECT CAST(date AS VARCHAR) AS date, hours_collected, CAST(events AS BIGINT) AS events, complete FROM covered")
def a5(spark, sf_dir):
    return activity.day_coverage(hours(spark, sf_dir)).withColumn("date", F.col("date").cast("string"))


@query(
    "a6_window_coverage",
    _VALID + _HOURS + "SELECT count(*) AS days, CAST(sum(hours_collected) AS BIGINT) AS hours_collected, CAST(sum(events) AS BIGINT) AS events, bool_and(complete) AS complete FROM covered",
)
def a6(spark, sf_dir):
    return activity.window_coverage(activity.day_coverage(hours(spark, sf_dir)))


@query(
    "a4_velocity",
    _VALID + _HOURS + ", first_week AS (SELECT key, CAST(sum(n) AS BIGINT) AS n FROM daily WHERE date < DATE '2024-01-08' GROUP BY key) "
    "SELECT key, n, CASE WHEN key LIKE '%1' THEN round(n / 7.0, 4) END AS velocity FROM first_week",
)
def a4(spark, sf_dir):
    first_week = daily(spark, sf_dir).filter("date < DATE '2024-01-08'").groupBy("key").agg(F.sum("n").alias("n"))
    return first_week.withColumn("velocity", activity.velocity(F.col("n"), F.lit(7), F.col("key").endswith("1")))


@query("p5_any_day", _VALID + "SELECT key, max(n) AS max_daily FROM daily GROUP BY key HAVING max(n) >= 5")
def p5(spark, sf_dir):
    return activity.any_day(daily(spark, sf_dir), 5)


@query("p6_window_total", _VALID + "SELECT key, CAST(sum(n) AS BIGINT) AS total FROM daily GROUP BY key HAVING sum(n) >= 40")
def p6(spark, sf_dir):
    return activity.window_total(daily(spark, sf_dir), 40)


_TOTALS = "SELECT arg_min(name, struct_pack(hour, line)) AS full_name, count(*) AS n FROM watches GROUP BY key"


@query("o1_topk", _VALID + _TOTALS + " ORDER BY n DESC, full_name LIMIT 10")
def o1(spark, sf_dir):
    return activity.top_candidates(activity.entity_totals(watches(spark, sf_dir)), 10).select("full_name", "n")


@query("o2_full_rank", _VALID + f"SELECT *, row_number() OVER (ORDER BY n DESC, full_name) AS place FROM ({_TOTALS})")
def o2(spark, sf_dir):
    totals = activity.entity_totals(watches(spark, sf_dir)).select("full_name", "n")
    return dense_places(totals, [F.desc("n"), F.col("full_name")], "place")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in metadata: customers as entities, in another casing."""
    customers = table(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0")
    return customers.select(F.concat(F.lit("OWNER/"), F.col("c_custkey")).alias("full_name"), F.col("c_custkey").alias("id"), F.greatest(F.lit(0), F.floor("c_acctbal")).cast("long").alias("stars"))


_META = "meta AS (SELECT 'owner/' || c_custkey AS key, c_custkey AS id, CAST(greatest(0, floor(c_acctbal)) AS BIGINT) AS stars FROM customer WHERE c_custkey % 4 <> 0)"


@query("j1_enrich_left", _VALID + f", {_META} SELECT t.key, t.n, m.id, m.stars FROM (SELECT key, count(*) AS n FROM watches GROUP BY key) t LEFT JOIN meta m USING (key)")
def j1(spark, sf_dir):
    joined, _ = activity.enriched(activity.entity_totals(watches(spark, sf_dir)), metadata(spark, sf_dir))
    return joined.select("key", "n", "current.id", "current.stars")


@query("j2_selected_metadata", _VALID + f", {_META} SELECT t.key, t.n, CASE WHEN t.n >= 50 THEN m.stars END AS stars FROM (SELECT key, count(*) AS n FROM watches GROUP BY key) t LEFT JOIN meta m ON t.key = m.key AND t.n >= 50")
def j2(spark, sf_dir):
    totals = activity.entity_totals(watches(spark, sf_dir))
    joined, _ = activity.enriched(totals.withColumn("selected", F.col("n") >= 50), metadata(spark, sf_dir))
    return joined.select("key", "n", "current.stars")


@query("j3_incremental_anti", _VALID + f", {_META} SELECT key FROM (SELECT key FROM daily GROUP BY key HAVING max(n) >= 5) WHERE key NOT IN (SELECT key FROM meta)")
def j3(spark, sf_dir):
    known = metadata(spark, sf_dir).select(F.lower("full_name").alias("key"))
    return activity.still_needed(activity.any_day(daily(spark, sf_dir), 5), known).select("key")


@query(
    "u1_error_union",
    _VALID + f", {_META} SELECT source, count(*) AS n FROM (SELECT 'archive' AS source FROM events_ WHERE status IN ('parse-error', 'invalid') UNION ALL "
    "SELECT 'metadata' FROM (SELECT DISTINCT key FROM watches) WHERE key NOT IN (SELECT key FROM meta)) GROUP BY source",
)
def u1(spark, sf_dir):
    events = inspected(spark, sf_dir)
    _, missing = activity.enriched(activity.entity_totals(events.filter("status = 'watch'")), metadata(spark, sf_dir))
    errors = ops.coverage_errors(events.withColumn("message", F.lit(None).cast("string")))
    again = activity.without_old_errors(errors.unionByName(missing)).unionByName(missing)
    return again.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("u4_difference", _VALID + "SELECT key FROM daily GROUP BY key HAVING sum(n) >= 40 EXCEPT SELECT key FROM daily WHERE n >= 8")
def u4(spark, sf_dir):
    counts = daily(spark, sf_dir)
    return activity.window_total(counts, 40).select("key").join(activity.any_day(counts, 8).select("key"), "key", "left_anti")


@query("a8_metadata_counts", _VALID + f", {_META} SELECT count(*) AS selected, count(m.key) AS collected, count(*) = count(m.key) AS complete FROM (SELECT key FROM daily GROUP BY key HAVING max(n) >= 5) s LEFT JOIN meta m USING (key)")
def a8(spark, sf_dir):
    selected = activity.any_day(daily(spark, sf_dir), 5)
    joined, _ = activity.enriched(selected.withColumn("full_name", F.col("key")), metadata(spark, sf_dir))
    return activity.metadata_counts(joined)


@query("t2_day_buckets", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, count(DISTINCT date_trunc('hour', ts)) AS hours FROM events GROUP BY 1")
def t2(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.date_trunc("hour", "ts")).alias("hours"))
