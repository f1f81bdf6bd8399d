"""Single steps of the commands as queries of their own: predicates, projections, orders, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keywords
from ..operators import activity, city, decisions, events as ops, lifecycle, topics, validation
from ..operators.ranking import dense_places, numbered
from ..sources import archive
from . import city_queries as cq
from . import commands
from . import event_queries as eq
from . import lifecycle_queries as lq
from . import topic_queries as tq
from .registry import query, table

_V = eq._VALID


@query("s6_day_window", _V + "SELECT CAST(date AS VARCHAR) AS date, count(*) AS n FROM watches WHERE hour >= TIMESTAMP '2024-01-08' AND hour < TIMESTAMP '2024-01-15' GROUP BY date")
def s6(spark, sf_dir):
    first, last = archive.day_window("2024-01-08T00:00:00Z", 7)
    rows = eq.watches(spark, sf_dir).filter((F.col("hour") >= first) & (F.col("hour") < last))
    return rows.groupBy(F.to_date("hour").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "s7_metadata_profile",
    "SELECT profile, 'OWNER/' || c_custkey AS full_name, CAST(greatest(0, floor(c_acctbal)) AS BIGINT) AS stars, CASE WHEN profile <> 'screening' THEN c_mktsegment END AS readme, "
    "CASE WHEN profile = 'full' THEN CAST(c_nationkey AS BIGINT) END AS commits_30d FROM customer, (VALUES ('full'), ('classification'), ('screening')) p(profile) WHERE c_custkey % 4 <> 0",
)
def s7(spark, sf_dir):
    parts = table(spark, sf_dir, "customer").select(F.concat(F.lit("OWNER/"), F.col("c_custkey")).alias("full_name"), F.col("c_mktsegment").alias("readme"), F.col("c_nationkey").cast("long").alias("commits_30d"))
    whole = eq.metadata(spark, sf_dir).select("full_name", "stars").join(parts, "full_name")
    each = [activity.profiled(whole, p).select(F.lit(p).alias("profile"), "*") for p in activity.PROFILES]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("p1_type_filter", _V + "SELECT count(*) AS n FROM raw WHERE kind = 'event' AND type = 'WatchEvent'")
def p1(spark, sf_dir):
    return ops.validated(eq.raw_records(spark, sf_dir)).filter("status IN ('watch', 'invalid')").agg(F.count(F.lit(1)).alias("n"))


@query("p3_inside_hour", _V + "SELECT line FROM timed WHERE ts >= hour AND ts < hour + INTERVAL 1 HOUR")
def p3(spark, sf_dir):
    records = eq.raw_records(spark, sf_dir).withColumn("ts", F.try_to_timestamp("created_at"))
    return records.filter(ops.inside_hour(F.col("ts"), F.col("hour"))).select("line")


@query("p4_name_format", "SELECT page_id FROM (SELECT page_id, string_split(url, '//')[2] AS name FROM pages) WHERE regexp_full_match(replace(name, '.', '-'), '[A-Za-z0-9][A-Za-z0-9-]{0,38}/[A-Za-z0-9._-]+')")
def p4(spark, sf_dir):
    name = F.replace(F.element_at(F.split("url", "//"), 2), F.lit("."), F.lit("-"))
    return table(spark, sf_dir, "pages").filter(name.rlike(ops.NAME_FORMAT)).select("page_id")


@query("p7_selected_candidates", _V + "SELECT key, count(*) AS n FROM watches WHERE key IN (SELECT key FROM daily WHERE n >= 6) GROUP BY key")
def p7(spark, sf_dir):
    chosen = activity.any_day(eq.daily(spark, sf_dir), 6).select("key")
    return activity.entity_totals(eq.watches(spark, sf_dir)).join(chosen, "key", "left_semi").select("key", "n")


@query("p9_related", tq._OBSERVED + "SELECT id FROM related")
def p9(spark, sf_dir):
    return tq.assessed(spark, sf_dir).filter("decision = 'ai-related'").select("id")


@query("p11_history_filter", lq._FOLD + "SELECT count(*) AS n FROM steps WHERE i > 0 AND NOT (n > 0 OR status IS NOT NULL OR coalesce(breakout_status = 'pending', FALSE))")
def p11(spark, sf_dir):
    states = lq.states(spark, sf_dir)
    every = states.select(F.explode("state.weeks")).agg(F.count(F.lit(1)).alias("every"))
    kept = lifecycle.lifecycle_weeks(states).agg(F.count(F.lit(1)).alias("kept"))
    return every.join(F.broadcast(kept)).select((F.col("every") - F.col("kept")).alias("n"))  # one row each


@query("p16_first_week", lq._WEEKS + "SELECT key, CAST(min(week) AS VARCHAR) AS first, count(*) AS weeks FROM tracked GROUP BY key")
def p16(spark, sf_dir):
    return lq.as_text(lq.tracked(spark, sf_dir).groupBy("key").agg(F.min("week").alias("first"), F.count(F.lit(1)).alias("weeks")))


@query("p18_kept_errors", _V + "SELECT count(*) AS n FROM events_ WHERE status IN ('parse-error', 'invalid')")
def p18(spark, sf_dir):
    errors = ops.coverage_errors(eq.inspected(spark, sf_dir).withColumn("message", F.lit(None).cast("string")))
    old = errors.withColumn("source", F.lit("metadata"))
    return activity.without_old_errors(errors.unionByName(old)).agg(F.count(F.lit(1)).alias("n"))


@query("p19_readme_needed", tq._OBSERVED + "SELECT id FROM assessed WHERE decision <> 'not-ai'")
def p19(spark, sf_dir):
    return decisions.readme_needed(tq.assessed(spark, sf_dir), model=True).select("id")


@query("j8_week_days", "SELECT CAST(date_trunc('week', d) AS DATE)::VARCHAR AS week, count(e.day) AS present FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-04', INTERVAL 1 DAY) g(d) LEFT JOIN (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) e ON e.day = CAST(d AS DATE) GROUP BY 1")
def j8(spark, sf_dir):
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), F.lit(True).alias("seen")).distinct()
    joined = activity.calendar(spark, "2024-01-01", 35).join(days, "date", "left")
    return lq.as_text(joined.groupBy(F.to_date(F.date_trunc("week", "date")).alias("week")).agg(F.count("seen").alias("present")))


@query("j10_one_outcome", "SELECT l_orderkey, l_linenumber, o_orderstatus AS decision FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 3 > 0")
def j10(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("decision"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_orderkey", "l_linenumber")
    return decisions.one_outcome(lines, orders.unionByName(orders)).select("l_orderkey", "l_linenumber", "decision")


@query("f1_folded_keys", _V + "SELECT key, count(DISTINCT name) AS spellings FROM watches GROUP BY key")
def f1(spark, sf_dir):
    return eq.watches(spark, sf_dir).groupBy(F.lower("name").alias("key")).agg(F.countDistinct("name").alias("spellings"))


@query("f3_times", _V + "SELECT line, ts IS NOT NULL AS readable FROM timed WHERE created_at IS NOT NULL")
def f3(spark, sf_dir):
    return eq.raw_records(spark, sf_dir).filter("created_at is not null").select("line", F.try_to_timestamp("created_at").isNotNull().alias("readable"))


@query("f6_searchable", f"SELECT page_id, regexp_replace(regexp_replace(lower(regexp_replace(html, '([a-z0-9])([A-Z])', '\\1-\\2', 'g')), 'https?://[^{tq.SQL_WHITE}]+', ' ', 'g'), '[_/]+', '-', 'g') AS found FROM pages")
def f6(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", keywords.searchable(F.col("html")).alias("found"))


@query("f9_compounds", tq._OBSERVED + f"SELECT w, count(*) AS n FROM words WHERE {tq._COMPOUND} GROUP BY w")
def f9(spark, sf_dir):
    words = topics.words(tq.entities(spark, sf_dir), tq.LEXICON).withColumnRenamed("word", "w")
    return words.filter(keywords.is_compound(F.col("w"), tq.LEXICON))  # each token is looked at once


@query("f11_signals", tq._OBSERVED + "SELECT DISTINCT keyword FROM signals")
def f11(spark, sf_dir):
    return topics.signal_observations(tq.entities(spark, sf_dir), tq.LEXICON).select("keyword").distinct()


@query("f17_confidence", tq._OBSERVED + "SELECT source, max(confidence) AS confidence, count(*) AS n FROM observed GROUP BY source")
def f17(spark, sf_dir):
    return tq.observed(spark, sf_dir).groupBy("source").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"))


@query("f33_model_input", "SELECT p_partkey AS id, nullif(trim(p_name), '') AS description, array_to_string(list_sort(list_distinct(list_transform(string_split(p_type || ' ' || p_brand || ' ' || p_type, ' '), lambda t: lower(t)))), ',') AS topics FROM part")
def f33(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("description"), F.split(F.concat_ws(" ", "p_type", "p_brand", "p_type"), " ").alias("topics"))
    return decisions.model_input(parts).withColumn("topics", F.array_join("topics", ","))


@query("o4_observation_order", tq._BOUNDED + "SELECT id, source, keyword, row_number() OVER (ORDER BY id, source, keyword) AS place FROM observed")
def o4(spark, sf_dir):
    return numbered(topics.marked_observations(tq.bounded(spark, sf_dir), tq.LEXICON, ordered=True).select("id", "source", "keyword"), "place")


@query(
    "o5_community_order",
    tq._OBSERVED + f", grouped AS (SELECT community, {tq._DISTRICT} AS district, count(*) AS entities FROM homes GROUP BY ALL) "
    f"SELECT community, district, entities, row_number() OVER (ORDER BY list_position([{', '.join(repr(d) for d in tq.LEXICON.shown)}], district), entities DESC, community) AS place FROM grouped",
)
def o5(spark, sf_dir):
    return dense_places(tq.a20(spark, sf_dir).select("community", "district", "entities"), city.shown_order(tq.LEXICON), "place")


@query("o7_log_order", lq._FOLD + ", listed AS (SELECT key, i, unnest(emitted) AS e, generate_subscripts(emitted, 1) AS k FROM steps) SELECT key, e.type AS \"type\", CAST(e.week AS VARCHAR) AS week, row_number() OVER (ORDER BY e.week, key COLLATE nocase.noaccent.en, key, i, k) AS place FROM listed")
def o7(spark, sf_dir):
    log = lifecycle.lifecycle_events(lq.states(spark, sf_dir))
    return lq.as_text(dense_places(log, lifecycle.log_order(), "place").select("key", "type", "week", "place"))


@query("o8_by_rank", cq._RANKED + "SELECT id, global_rank, row_number() OVER (ORDER BY global_rank) AS place FROM placed")
def o8(spark, sf_dir):
    return dense_places(cq.ranked(spark, sf_dir).select("id", "global_rank"), [F.col("global_rank")], "place")


@query(
    "u2_input_union",
    _V + f", {eq._META}, totals AS (SELECT key, count(*) AS n FROM watches GROUP BY key) "
    "SELECT CAST(0 AS BIGINT) AS input, count(*) AS rows_, CAST(0 AS BIGINT) AS known, CAST(sum(n) AS BIGINT) AS n FROM totals UNION ALL SELECT 1, count(*), count(id), CAST(sum(n) AS BIGINT) FROM totals LEFT JOIN meta USING (key)",
)
def u2(spark, sf_dir):
    """A raw series and an enriched one, which has columns that the other lacks."""
    raw = activity.entity_totals(eq.watches(spark, sf_dir))
    rich, _ = activity.enriched(raw, eq.metadata(spark, sf_dir))
    seen = commands.observations(raw, 0).unionByName(commands.observations(rich, 1))
    return seen.groupBy(F.col("input").cast("long").alias("input")).agg(F.count(F.lit(1)).alias("rows_"), F.count("id").alias("known"), F.sum("n").alias("n"))


@query("u3_aliases", lq._KNOWN + "SELECT DISTINCT identity, name FROM identified")
def u3(spark, sf_dir):
    return lifecycle.identified(lq.observations(spark, sf_dir)).select("identity", "name").distinct()


@query("t3_week_buckets", "SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week, count(*) AS n FROM events GROUP BY 1")
def t3(spark, sf_dir):
    weeks = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "7 days", startTime="4 days")).agg(F.count(F.lit(1)).alias("n"))
    return weeks.select(F.to_date("window.start").cast("string").alias("week"), "n")


@query("t4_outside_hour", _V + "SELECT line FROM events_ WHERE status = 'invalid' AND reason = 'outside-hour'")
def t4(spark, sf_dir):
    return eq.inspected(spark, sf_dir).filter("status = 'invalid' AND reason = 'outside-hour'").select("line")


@query(
    "s13_city_violations",
    "SELECT problem, n FROM (SELECT 'unknown district' AS problem, count(*) FILTER (p_brand = 'Brand#7') AS n FROM part UNION ALL SELECT 'unknown community', count(*) FILTER (p_type = 'ECONOMY') FROM part) WHERE n > 0",
)
def s13(spark, sf_dir):
    ranked = city.community_ranks(cq.ranked(spark, sf_dir))
    districts = [f"Brand#{k}" for k in range(0, 60) if k != 7]
    communities = table(spark, sf_dir, "part").select(F.col("p_type").alias("community")).distinct().filter("community <> 'ECONOMY'")
    return validation.city_violations(ranked, communities, districts)
