"""Weekly metrics, coverage and the lifecycle over the driver's events; identity over orders.

An entity is a user; an event of type ``view`` counts. The last week is cut by the calendar, and one day
has a record warning, so every kind of coverage occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import activity, lifecycle
from ..scratch import new_path, saved
from ..streaming import lifecycle as stream
from .registry import query, table

LIMITS = lifecycle.rules(main=3, scout=3, breakout=6)
WARNED = "2024-01-17"

_BASE = f"""
daily AS (SELECT 'owner/' || user_id AS key, CAST(ts AS DATE) AS date, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY ALL),
days AS (SELECT CAST(ts AS DATE) AS date, count(DISTINCT hour(ts)) AS hours_collected, CAST(ts AS DATE) <> DATE '{WARNED}' AS records_complete FROM events GROUP BY ALL),
covered AS (
    SELECT CAST(date_trunc('week', date) AS DATE) AS week, count(*) = 7 AS calendar_complete, count(*) = 7 AND bool_and(hours_collected = 24) AS hours_complete,
        count(*) = 7 AND bool_and(hours_collected = 24) AND bool_and(records_complete) AS records_complete
    FROM days GROUP BY 1),
weeks AS (SELECT *, CASE WHEN records_complete THEN 'complete' WHEN hours_complete THEN 'record-warning' ELSE 'temporal-incomplete' END AS coverage FROM covered),
weekly AS (
    SELECT key, CAST(date_trunc('week', date) AS DATE) AS week, CAST(sum(n) AS BIGINT) AS n, max(n) AS max_daily, count(*) AS active_days
    FROM daily GROUP BY 1, 2),
firsts AS (SELECT key, min(week) AS first FROM weekly GROUP BY key),
tracked AS (
    SELECT f.key, w.week, w.coverage, coalesce(m.n, 0) AS n, coalesce(m.max_daily, 0) AS max_daily, coalesce(m.active_days, 0) AS active_days,
        CASE WHEN coalesce(m.max_daily, 0) >= 3 THEN TRUE WHEN w.records_complete THEN FALSE END AS main,
        CASE WHEN coalesce(m.n, 0) >= 3 THEN TRUE WHEN w.records_complete THEN FALSE END AS scout,
        CASE WHEN coalesce(m.n, 0) >= 6 THEN TRUE WHEN w.records_complete THEN FALSE END AS breakout
    FROM firsts f JOIN weeks w ON w.week >= f.first LEFT JOIN weekly m ON m.key = f.key AND m.week = w.week),
grown AS (
    SELECT *, coalesce(lag(coverage, 1) OVER k = 'complete' AND lag(coverage, 2) OVER k = 'complete' AND lag(n, 2) OVER k < lag(n, 1) OVER k AND lag(n, 1) OVER k < n, FALSE) AS grows,
        row_number() OVER k AS i
    FROM tracked WINDOW k AS (PARTITION BY key ORDER BY week))
"""
_WEEKS = f"WITH {_BASE} "

# One step of the state machine for each week: the state before is s, the week is w.
_FOLD = f"""
WITH RECURSIVE {_BASE},
steps AS (
    SELECT key, 0::BIGINT AS i, NULL::DATE AS week, 0::BIGINT AS n, 0::BIGINT AS max_daily, NULL::VARCHAR AS coverage, NULL::VARCHAR AS status, NULL::VARCHAR AS cooling_from, 0 AS qualified, 0 AS below,
        NULL::DATE AS first_detected, NULL::DATE AS changed_at, NULL::DATE AS last_qualified, FALSE AS fast_ever, NULL::VARCHAR AS breakout_status, NULL::DATE AS breakout_week, FALSE AS last_fast,
        []::STRUCT(type VARCHAR, week DATE, previous_status VARCHAR, next_status VARCHAR)[] AS emitted
    FROM firsts
    UNION ALL
    SELECT key, i, week, n, max_daily, coverage, status, cooling_from, qualified, below,
        coalesce(first_detected, CASE WHEN changed THEN week END), CASE WHEN changed THEN week ELSE changed_at END, last_qualified, fast_ever, breakout_status, breakout_week, last_fast,
        list_filter([
            CASE WHEN matters THEN struct_pack("type" := 'data_incomplete', week := week, previous_status := old, next_status := old) END,
            CASE WHEN confirmed THEN struct_pack("type" := 'breakout_confirmed', week := week, previous_status := old, next_status := old) END,
            CASE WHEN failed THEN struct_pack("type" := 'breakout_unconfirmed', week := week, previous_status := old, next_status := old) END,
            CASE WHEN fresh THEN struct_pack("type" := 'breakout_detected', week := week, previous_status := old, next_status := old) END,
            CASE WHEN changed THEN struct_pack("type" := CASE WHEN status = 'active' THEN 'activated' WHEN status = 'candidate' AND old = 'inactive' THEN 'revived'
                WHEN status = 'candidate' THEN 'candidate_detected' WHEN status = 'cooling' THEN 'cooling_started' ELSE 'inactivated' END,
                week := week, previous_status := old, next_status := status) END], lambda e: e IS NOT NULL)
    FROM (
        SELECT *, status IS DISTINCT FROM old AS changed FROM (
            SELECT key, i, week, n, max_daily, coverage, old, matters, confirmed, failed, fresh, first_detected, changed_at,
                CASE WHEN lost THEN old
                    WHEN q AND old IS NULL THEN CASE WHEN NOT pends AND grows THEN 'active' ELSE 'candidate' END
                    WHEN q AND old = 'inactive' THEN 'candidate'
                    WHEN q AND old = 'cooling' THEN coalesce(cooling_from, 'candidate')
                    WHEN q AND old = 'candidate' AND (confirmed OR qualified + 1 >= 2) THEN 'active'
                    WHEN b AND old IN ('candidate', 'active') THEN 'cooling'
                    WHEN b AND old = 'cooling' AND below + 1 >= 2 THEN 'inactive' ELSE old END AS status,
                CASE WHEN lost THEN cooling_from WHEN b AND old IN ('candidate', 'active') THEN old
                    WHEN (q AND old = 'cooling') OR (b AND old = 'cooling' AND below + 1 >= 2) THEN NULL ELSE cooling_from END AS cooling_from,
                CASE WHEN q AND NOT lost THEN CASE WHEN old IN ('candidate', 'active') THEN qualified + 1 ELSE 1 END ELSE 0 END AS qualified,
                CASE WHEN lost THEN below WHEN q THEN 0 WHEN b AND old IN ('candidate', 'active') THEN 1 WHEN b AND old IN ('cooling', 'inactive') THEN below + 1 ELSE below END AS below,
                CASE WHEN q AND NOT lost THEN week ELSE last_qualified END AS last_qualified,
                fast_ever OR fresh AS fast_ever,
                CASE WHEN fresh THEN CASE WHEN pends THEN 'pending' ELSE 'confirmed' END WHEN confirmed THEN 'confirmed' WHEN failed THEN 'unconfirmed' ELSE breakout_status END AS breakout_status,
                CASE WHEN fresh THEN week ELSE breakout_week END AS breakout_week,
                CASE WHEN lost THEN last_fast WHEN q THEN f WHEN b THEN FALSE ELSE last_fast END AS last_fast
            FROM (
                SELECT *, NOT lost AND waiting AND q AS confirmed, NOT lost AND waiting AND b AS failed, NOT lost AND f AND NOT last_fast AS fresh,
                    NOT lost AND f AND NOT last_fast AND (old IS NULL OR old = 'inactive') AS pends,
                    (lost OR (coverage = 'record-warning' AND NOT q)) AND (old IS NOT NULL OR coalesce(breakout_status = 'pending', FALSE)) AS matters
                FROM (
                    SELECT s.key, w.i, w.week, w.n, w.max_daily, w.coverage, w.grows, s.status AS old, s.cooling_from, s.qualified, s.below, s.first_detected, s.changed_at, s.last_qualified,
                        s.fast_ever, s.breakout_status, s.breakout_week, s.last_fast, coalesce(w.scout, FALSE) AS q, coalesce(NOT w.scout, FALSE) AS b, coalesce(w.breakout, FALSE) AS f,
                        w.coverage = 'temporal-incomplete' AS lost, coalesce(s.breakout_status = 'pending' AND s.breakout_week <> w.week, FALSE) AS waiting
                    FROM steps s JOIN grown w ON w.key = s.key AND w.i = s.i + 1)))))
"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = table(spark, sf_dir, "events").filter("event_type = 'view'")
    return views.groupBy(F.concat(F.lit("owner/"), F.col("user_id")).alias("key"), F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).agg(F.countDistinct(F.hour("ts")).alias("hours_collected"))
    return lifecycle.week_coverage(days.withColumn("records_complete", F.col("date") != F.lit(WARNED).cast("date")))


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.tracked_weeks(daily(spark, sf_dir), coverage(spark, sf_dir), LIMITS)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.folded(tracked(spark, sf_dir))


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the streaming lifecycle over the same counts and days; the last row only moves the watermark."""
    none = lambda kind: F.lit(None).cast(kind)
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).agg(F.countDistinct(F.hour("ts")).cast("int").alias("hours_collected"))
    days = days.select(none("string").alias("key"), "date", none("long").alias("n"), "hours_collected", (F.col("date") != F.lit(WARNED).cast("date")).alias("records_complete"))
    counts = daily(spark, sf_dir).select("key", "date", "n", none("int").alias("hours_collected"), none("boolean").alias("records_complete"))
    clock = days.agg(F.date_add(F.max("date"), 14).alias("date")).select(none("string").alias("key"), "date", none("long").alias("n"), none("int").alias("hours_collected"), none("boolean").alias("records_complete"))
    given = saved(counts.unionByName(days).unionByName(clock), "observations")
    rows = spark.readStream.schema(given.schema).parquet(given.inputFiles()[0].rpartition("/")[0])
    out, notes = new_path(spark, "weeks"), new_path(spark, "offsets")
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stream.followed(rows, LIMITS, groups).writeStream.format("parquet").option("path", out).option("checkpointLocation", notes).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.OUTPUT).parquet(out)


def as_text(df: DataFrame) -> DataFrame:
    """Dates as text, so that every engine compares them alike."""
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


@query("a9_weekly_metrics", _WEEKS + "SELECT key, CAST(week AS VARCHAR) AS week, n, max_daily, active_days FROM weekly")
def a9(spark, sf_dir):
    return as_text(lifecycle.weekly_metrics(daily(spark, sf_dir)))


@query("a10_week_coverage", _WEEKS + "SELECT CAST(week AS VARCHAR) AS week, calendar_complete, hours_complete, records_complete, coverage FROM weeks")
def a10(spark, sf_dir):
    return as_text(coverage(spark, sf_dir))


@query("p8_tristate", _WEEKS + "SELECT key, CAST(week AS VARCHAR) AS week, main, scout, breakout FROM tracked")
def p8(spark, sf_dir):
    return as_text(tracked(spark, sf_dir).select("key", "week", "main", "scout", "breakout"))


@query("j7_tracked_weeks", _WEEKS + "SELECT key, CAST(week AS VARCHAR) AS week, coverage, n, max_daily, active_days FROM tracked")
def j7(spark, sf_dir):
    return as_text(tracked(spark, sf_dir).select("key", "week", "coverage", "n", "max_daily", "active_days"))


@query("w4_gradual_growth", _WEEKS + "SELECT key, CAST(week AS VARCHAR) AS week FROM grown WHERE grows")
def w4(spark, sf_dir):
    return as_text(lifecycle.with_growth(tracked(spark, sf_dir)).filter("grows").select("key", "week"))


@query(
    "a12_week_summary",
    _WEEKS + "SELECT CAST(week AS VARCHAR) AS week, coverage, count(*) FILTER (n > 0) AS observed, count(*) FILTER (max_daily >= 3) AS main, count(*) FILTER (n >= 3) AS scout, "
    "count(*) FILTER (n >= 6) AS breakout FROM weeks LEFT JOIN weekly USING (week) GROUP BY ALL",
)
def a12(spark, sf_dir):
    return as_text(lifecycle.week_summary(daily(spark, sf_dir), coverage(spark, sf_dir), LIMITS))


_SHOWN = (
    _FOLD + "SELECT key, CAST(week AS VARCHAR) AS week, n, coverage, status, breakout_status, qualified, below FROM steps WHERE i > 0 AND (n > 0 OR status IS NOT NULL OR coalesce(breakout_status = 'pending', FALSE))"
)


@query("t6_lifecycle_weeks", _SHOWN)
def t6(spark, sf_dir):
    return as_text(lifecycle.lifecycle_weeks(states(spark, sf_dir)).select("key", "week", "n", "coverage", "status", "breakout_status", "qualified", "below"))


_EMITTED = (
    _FOLD + """, listed AS (SELECT key, i, unnest(emitted) AS e, generate_subscripts(emitted, 1) AS k FROM steps)
    SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY i, k) - 1 AS INTEGER) AS seq, e.type AS "type", CAST(e.week AS VARCHAR) AS week, e.previous_status AS previous_status, e.next_status AS next_status FROM listed"""
)


@query("t7_lifecycle_events", _EMITTED)
def t7(spark, sf_dir):
    return as_text(lifecycle.lifecycle_events(states(spark, sf_dir)))


@query("t6_streamed_weeks", _SHOWN)
def t6_streamed(spark, sf_dir):
    return as_text(stream.shown_weeks(streamed(spark, sf_dir)).select("key", "week", "n", "coverage", "status", "breakout_status", "qualified", "below"))


@query("t7_streamed_events", _EMITTED)
def t7_streamed(spark, sf_dir):
    return as_text(stream.emitted_events(streamed(spark, sf_dir)))


@query(
    "t6_final_state",
    _FOLD + "SELECT key, status, cooling_from, qualified, below, CAST(first_detected AS VARCHAR) AS first_detected, CAST(changed_at AS VARCHAR) AS changed_at, "
    "CAST(last_qualified AS VARCHAR) AS last_qualified, fast_ever, breakout_status FROM steps QUALIFY row_number() OVER (PARTITION BY key ORDER BY i DESC) = 1",
)
def t6_final(spark, sf_dir):
    return as_text(lifecycle.final_states(states(spark, sf_dir)))


@query(
    "a22_state_counts",
    _FOLD + ", last AS (SELECT status, breakout_status FROM steps QUALIFY row_number() OVER (PARTITION BY key ORDER BY i DESC) = 1) SELECT status, breakout_status, count(*) AS n FROM last GROUP BY ALL",
)
def a22(spark, sf_dir):
    return lifecycle.final_states(states(spark, sf_dir)).groupBy("status", "breakout_status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p17_window_check",
    "WITH days AS (SELECT DISTINCT event_id % 2 AS input, CAST(ts AS DATE) + CASE WHEN event_id % 2 = 1 THEN 40 ELSE 0 END AS date FROM events WHERE CAST(ts AS DATE) NOT IN (DATE '2024-01-09', DATE '2024-01-20')), "
    "ends AS (SELECT input, min(date) AS first, max(date) AS last FROM days GROUP BY input) "
    "SELECT input, CAST(date AS VARCHAR) AS date FROM (SELECT *, lag(date) OVER (PARTITION BY input ORDER BY date) AS before FROM days) WHERE date - before <> 1 "
    "UNION ALL SELECT input, CAST(first AS VARCHAR) FROM (SELECT *, lag(last) OVER (ORDER BY input) AS before FROM ends) WHERE first - before <> 1",
)
def p17(spark, sf_dir):
    events = table(spark, sf_dir, "events").filter("to_date(ts) NOT IN (DATE '2024-01-09', DATE '2024-01-20')")
    shift = F.when(F.col("event_id") % 2 == 1, 40).otherwise(0)
    days = events.select((F.col("event_id") % 2).alias("input"), F.date_add(F.to_date("ts"), shift).alias("date")).distinct()
    return as_text(lifecycle.check_windows(days))


@query(
    "a11_integrity_state",
    "SELECT user_id % 9 AS part, CASE WHEN count(v) = 0 THEN 'unavailable' WHEN count(*) FILTER (v) = count(*) THEN 'verified' ELSE 'partial' END AS state "
    "FROM (SELECT user_id, CASE WHEN user_id % 9 < 2 THEN NULL WHEN user_id % 9 < 5 THEN TRUE ELSE event_id % 3 > 0 END AS v FROM events) GROUP BY ALL",
)
def a11(spark, sf_dir):
    part = F.col("user_id") % 9
    v = F.when(part < 2, None).when(part < 5, True).otherwise(F.col("event_id") % 3 > 0)
    return table(spark, sf_dir, "events").select(part.alias("part"), v.alias("v")).groupBy("part").agg(lifecycle.integrity_state(F.col("v")).alias("state"))


# Orders as observations of customers: the month is the input; a third of the rows don't know the id; names change.
_SEEN = """
    SELECT CAST(month(o_orderdate) AS BIGINT) AS input, concat(CASE WHEN o_orderkey % 2 = 0 THEN 'Cust/' ELSE 'cust/' END, CASE WHEN month(o_orderdate) > 6 THEN o_custkey ELSE o_custkey % 700 END) AS name,
        CASE WHEN o_orderkey % 3 = 0 OR o_custkey % 5 = 0 THEN NULL ELSE o_custkey END AS id,
        CAST(o_orderdate AS {text}) AS first_at, CAST(o_orderdate AS {text}) AS last_at, CAST(1 AS BIGINT) AS n
    FROM {orders}
"""
_KNOWN = f"""
WITH seen AS ({_SEEN.format(text="VARCHAR", orders="orders")}),
known AS (SELECT lower(name) AS key_, arg_max(id, struct_pack(input, id)) AS id_ FROM seen WHERE id IS NOT NULL GROUP BY 1),
identified AS (SELECT s.*, CASE WHEN coalesce(id, id_) IS NOT NULL THEN 'id:' || coalesce(id, id_) ELSE 'name:' || lower(name) END AS identity FROM seen s LEFT JOIN known ON lower(name) = key_)
"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return spark.sql(_SEEN.format(text="STRING", orders="{orders}"), orders=orders.withColumn("o_orderdate", F.to_date("o_orderdate")))


@query("j4_identity_resolution", _KNOWN + "SELECT identity, count(*) AS n, count(DISTINCT name) AS names FROM identified GROUP BY identity")
def j4(spark, sf_dir):
    return lifecycle.identified(observations(spark, sf_dir)).groupBy("identity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("names"))


@query(
    "a13_identity_merge",
    _KNOWN.replace("CAST(o_orderdate AS VARCHAR)", "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)")
    + "SELECT identity, arg_max(name, struct_pack(input, name)) AS full_name, array_to_string(list_sort(list(DISTINCT name)), ',') AS aliases, min(first_at) AS first_at, max(last_at) AS last_at, CAST(sum(n) AS BIGINT) AS n FROM identified GROUP BY identity",
)
def a13(spark, sf_dir):
    return lifecycle.merged_identities(observations(spark, sf_dir)).select("identity", "full_name", F.array_join("aliases", ",").alias("aliases"), "first_at", "last_at", "n")


# One row for each input and name: the entity's name today, and whether its metadata were asked for.
_NAMED = f"""
WITH seen AS ({_SEEN.format(text="VARCHAR", orders="orders").replace("CAST(o_orderdate AS", "CAST(CAST(o_orderdate AS DATE) AS")}),
rows_ AS (SELECT input, max(name) AS name, lower(name) AS key, max(id) AS id, CASE WHEN max(id) % 3 = 0 THEN 'new/' || max(id) END AS current_name, input % 2 = 0 AS asked FROM seen GROUP BY input, lower(name)),
names AS (SELECT id, input, lower(name) AS key_ FROM rows_ WHERE id IS NOT NULL UNION ALL SELECT id, input, current_name FROM rows_ WHERE id IS NOT NULL AND current_name IS NOT NULL),
known AS (SELECT key_, arg_max(id, struct_pack(input, id)) AS id_ FROM names GROUP BY 1),
identified AS (SELECT r.*, CASE WHEN coalesce(id, id_) IS NOT NULL THEN 'id:' || coalesce(id, id_) ELSE 'name:' || key END AS identity FROM rows_ r LEFT JOIN known ON key = key_)
"""


def series_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).groupBy("input", F.lower("name").alias("key")).agg(F.max("name").alias("name"), F.max("id").alias("id"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("n").alias("n"))
    return rows.withColumns({"current_name": F.when(F.col("id") % 3 == 0, F.concat(F.lit("new/"), "id")), "asked": F.col("input") % 2 == 0})


@query(
    "a13_renames",
    _NAMED + "SELECT identity, arg_max(coalesce(current_name, name), struct_pack(input, name)) AS full_name, "
    "array_to_string(list_sort(list_distinct(list_concat(list(name), list(current_name) FILTER (current_name IS NOT NULL)))), ',') AS aliases, "
    "coalesce(arg_max(CASE WHEN id IS NOT NULL THEN 'available' ELSE 'unavailable' END, struct_pack(input, name)) FILTER (id IS NOT NULL OR asked), 'unknown') AS availability FROM identified GROUP BY identity",
)
def a13_renames(spark, sf_dir):
    merged = lifecycle.merged_identities(lifecycle.identified(series_rows(spark, sf_dir)))
    return merged.select("identity", "full_name", F.array_join("aliases", ",").alias("aliases"), "availability")


@query(
    "a13_identity_days",
    _NAMED + "SELECT identity AS key, s.first_at AS date, CAST(count(*) AS BIGINT) AS n FROM seen s JOIN identified i ON s.input = i.input AND lower(s.name) = i.key GROUP BY 1, 2",
)
def a13_days(spark, sf_dir):
    daily = observations(spark, sf_dir).groupBy("input", F.lower("name").alias("key"), F.col("first_at").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return lifecycle.identity_days(daily, lifecycle.identified(series_rows(spark, sf_dir)))


@query(
    "p12_compatible",
    "WITH w AS (SELECT user_id % 7 AS part, CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events GROUP BY 1), one AS (SELECT a, b FROM w WHERE part = 1), two AS (SELECT CAST(a + 1 AS DATE) AS a, b FROM w WHERE part = 2) "
    "SELECT problem FROM (SELECT unnest([CASE WHEN one.a <> two.a OR one.b <> two.b THEN 'the analysis has another window than the activity' END, CASE WHEN NOT (two.a <= one.a AND two.b >= one.b) THEN 'the lifecycle doesn''t cover the activity' END]) AS problem FROM one, two) WHERE problem IS NOT NULL",
)
def p12(spark, sf_dir):
    from . import commands

    window = lambda part, later: table(spark, sf_dir, "events").filter(F.col("user_id") % 7 == part).agg(F.date_add(F.to_date(F.min("ts")), later).alias("first"), F.to_date(F.max("ts")).alias("last"))
    return commands.incompatible(window(1, 0), window(2, 1), window(2, 1))
