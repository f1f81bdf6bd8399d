"""Joins by identity, ranks and layout: parts stand for repositories, their types for communities, orders and customers for snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import city, layout
from .registry import query, table

# Customers as activity (some without an id) and as analysis (other names for some ids).
_SIDES = """
WITH activity AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey END AS id, concat('c/', c_custkey) AS name, c_custkey AS k FROM {customer}),
analysis AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey END AS id, concat('C/', CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 1 ELSE c_custkey END) AS name, c_nationkey AS nation FROM {customer} WHERE c_custkey % 4 <> 1 AND NOT (c_custkey % 5 = 1 AND c_custkey > 1)),
states AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS id, concat('c/', c_custkey) AS name, c_nationkey % 5 AS status FROM {customer} WHERE c_custkey % 11 <> 0)
"""
_SIDES_SQL = _SIDES.format(customer="customer")


def side(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(_SIDES.format(customer="{customer}") + f" SELECT * FROM {name}", customer=table(spark, sf_dir, "customer"))


_J5 = _SIDES_SQL + """, joined AS (
    SELECT a.k, n.nation, n.name IS NOT NULL AS hit FROM activity a LEFT JOIN analysis n ON a.id = n.id WHERE a.id IS NOT NULL
    UNION ALL SELECT a.k, n.nation, n.name IS NOT NULL FROM activity a LEFT JOIN analysis n ON lower(a.name) = lower(n.name) WHERE a.id IS NULL)
"""


@query("j5_disjunctive_join", _J5 + "SELECT k, nation FROM joined")
def j5(spark, sf_dir):
    return city.by_id_or_name(side(spark, sf_dir, "activity"), side(spark, sf_dir, "analysis")).select("k", "match.nation")


@query("p10_excluded_count", _J5 + "SELECT count(*) AS related, count(*) FILTER (NOT hit) AS excluded FROM joined")
def p10(spark, sf_dir):
    return city.eligible(city.by_id_or_name(side(spark, sf_dir, "activity"), side(spark, sf_dir, "analysis")))[1]


@query(
    "j6_cascade_join",
    _SIDES_SQL
    + """SELECT a.k, coalesce(s1.status, s2.status, s3.status) AS status FROM (SELECT *, concat('c/', k + 1) AS other_name FROM activity) a
    LEFT JOIN states s1 ON s1.id = a.id LEFT JOIN states s2 ON s2.id IS NULL AND lower(s2.name) = lower(a.name) LEFT JOIN states s3 ON s3.id IS NULL AND lower(s3.name) = lower(a.other_name)""",
)
def j6(spark, sf_dir):
    left = side(spark, sf_dir, "activity").withColumn("other_name", F.expr("concat('c/', k + 1)"))
    return city.cascade(left, side(spark, sf_dir, "states")).select("k", "state.status")


@query("j9_duplicate_keys", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def j9(spark, sf_dir):
    return city.duplicate_keys(table(spark, sf_dir, "orders"), "o_custkey")


@query("j12_lookup", "SELECT s_suppkey, coalesce(n_name, 'unknown') AS nation, coalesce(r_name, 'unknown') AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey % 6 <> 0 LEFT JOIN region ON n_regionkey = r_regionkey")
def j12(spark, sf_dir):
    nations, regions = table(spark, sf_dir, "nation").filter("n_nationkey % 6 <> 0"), table(spark, sf_dir, "region")
    joined = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.select("s_suppkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.coalesce("r_name", F.lit("unknown")).alias("region"))


_PARTS = """parts AS (SELECT p_partkey AS id, p_name || ' ' || p_partkey AS full_name, p_type AS community, p_brand AS district, CAST(coalesce(sum(l_quantity), 0) AS BIGINT) AS watches, CAST(floor(p_retailprice) AS BIGINT) AS stars,
    CAST(p_size AS BIGINT) AS forks, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 0 ELSE count(l_orderkey) END AS commits
    FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_name, p_type, p_brand, p_retailprice, p_size)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"), F.count("l_orderkey").alias("c"))
    joined = table(spark, sf_dir, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left")
    commits = F.when(F.col("p_partkey") % 7 == 0, None).when(F.col("p_partkey") % 5 == 0, F.lit(0)).otherwise(F.coalesce("c", F.lit(0))).cast("long")
    return joined.select(
        F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_partkey").alias("full_name"), F.col("p_type").alias("community"), F.col("p_brand").alias("district"),
        F.coalesce("q", F.lit(0)).cast("long").alias("watches"), F.floor("p_retailprice").cast("long").alias("stars"), F.col("p_size").cast("long").alias("forks"), commits.alias("commits"),
    )


_RANKED = f"WITH {_PARTS}, placed AS (SELECT *, row_number() OVER (ORDER BY watches DESC, stars DESC, full_name) AS global_rank FROM parts) "


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return city.global_ranks(parts(spark, sf_dir))


@query("w2_global_rank", _RANKED + "SELECT id, global_rank FROM placed")
def w2(spark, sf_dir):
    return ranked(spark, sf_dir).select("id", "global_rank")


@query("w3_community_rank", _RANKED + "SELECT id, row_number() OVER (PARTITION BY community ORDER BY global_rank) AS community_rank FROM placed")
def w3(spark, sf_dir):
    return city.community_ranks(ranked(spark, sf_dir)).select("id", "community_rank")


@query("p15_topn_flag", _RANKED + "SELECT id, global_rank <= 50 AS highlighted FROM placed")
def p15(spark, sf_dir):
    return ranked(spark, sf_dir).select("id", (F.col("global_rank") <= 50).alias("highlighted"))


@query("p14_visible_districts", f"WITH {_PARTS} SELECT district, count(*) AS n, CAST(sum(stars) AS BIGINT) AS stars, CAST(sum(watches) AS BIGINT) AS watches FROM parts WHERE district IN ('Brand#1', 'Brand#12', 'Brand#25') GROUP BY district")
def p14(spark, sf_dir):
    visible = parts(spark, sf_dir).filter(F.col("district").isin("Brand#1", "Brand#12", "Brand#25"))
    return visible.groupBy("district").agg(F.count(F.lit(1)).alias("n"), F.sum("stars").alias("stars"), F.sum("watches").alias("watches"))


@query("a27_totals", f"WITH {_PARTS} SELECT CAST(sum(stars) AS BIGINT) AS stars, CAST(sum(watches) AS BIGINT) AS watches FROM parts")
def a27(spark, sf_dir):
    return parts(spark, sf_dir).agg(F.sum("stars").alias("stars"), F.sum("watches").alias("watches"))


_SIZE = "round(least(greatest({a} + {b} * {log}({x} + 1), {low}), {high}), 6)"


@query(
    "f23_building_size",
    f"WITH {_PARTS} SELECT id, {_SIZE.format(a=2.8, b=1.8, log='log2', x='watches', low=3.5, high=15)} AS height, {_SIZE.format(a=1.6, b=0.5, log='log10', x='stars', low=1.8, high=4.4)} AS width, "
    f"{_SIZE.format(a=1.6, b=0.45, log='log10', x='forks', low=1.8, high=4)} AS depth FROM (SELECT id, CAST(watches AS DOUBLE) AS watches, CAST(stars AS DOUBLE) AS stars, CAST(forks AS DOUBLE) AS forks FROM parts)",
)
def f23(spark, sf_dir):
    return parts(spark, sf_dir).select(
        "id", F.round(layout.height(F.col("watches")), 6).alias("height"), F.round(layout.width(F.col("stars")), 6).alias("width"), F.round(layout.depth(F.col("forks")), 6).alias("depth")
    )


_FACADE = f"""WITH {_PARTS}, top AS (SELECT greatest(1, max(coalesce(commits, 0))) AS most FROM parts),
faces AS (SELECT id, district, commits, ln(1 + commits) / ln(1 + most) AS share FROM parts, top),
dense AS (SELECT *, CAST(CASE WHEN commits IS NULL THEN 0 WHEN commits = 0 THEN 1 ELSE least(greatest(2 + floor(3 * share), 2), 5) END AS INTEGER) AS density FROM faces)
"""


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir)
    joined = rows.join(F.broadcast(layout.most_commits(rows)))  # one row
    return joined.withColumns(layout.facade(F.col("commits"), F.col("most")))


@query("f24_facade", _FACADE + "SELECT id, density, round(CASE WHEN commits IS NULL THEN CAST(0.18 AS DOUBLE) WHEN commits = 0 THEN CAST(0.24 AS DOUBLE) ELSE 0.35 + 1.4 * share END, 6) AS glow FROM dense")
def f24(spark, sf_dir):
    return faces(spark, sf_dir).select("id", "density", F.round("glow", 6).alias("glow"))


@query("a30_most_commits", _FACADE + "SELECT most FROM top")
def a30(spark, sf_dir):
    return layout.most_commits(parts(spark, sf_dir))


@query("a33_facade_windows", _FACADE + "SELECT district, CAST(sum(greatest(1, density) * 4) AS BIGINT) AS windows FROM dense GROUP BY district")
def a33(spark, sf_dir):
    return layout.facade_windows(faces(spark, sf_dir))


_LAYOUT = f"""WITH {_PARTS},
counts AS (SELECT district, count(*) AS n, row_number() OVER (ORDER BY district) - 1 AS place FROM parts GROUP BY district),
shaped AS (SELECT *, ceil(sqrt(greatest(1, n))) AS columns, greatest(1, ceil(n / ceil(sqrt(greatest(1, n))))) AS rows, place // 4 AS line FROM counts),
sized AS (SELECT *, greatest(14.0, columns * CAST(5.6 AS DOUBLE) + 5) AS width, greatest(11.0, rows * CAST(5.6 AS DOUBLE) + 5) AS depth FROM shaped),
laid AS (SELECT *, sum(width) OVER l + (count(*) OVER l - 1) * 7 AS line_width, max(depth) OVER l AS line_depth,
    coalesce(sum(width + 7) OVER (PARTITION BY line ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sized WINDOW l AS (PARTITION BY line)),
lines AS (SELECT line, sum(line_depth) OVER () + (count(*) OVER () - 1) * 7 AS total, coalesce(sum(line_depth + 7) OVER (ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM (SELECT DISTINCT line, line_depth FROM laid)),
districts AS (SELECT district, n, -line_width / 2 + start + width / 2 AS x, -total / 2 + top + line_depth / 2 AS z, width, depth, columns, rows FROM laid JOIN lines USING (line)),
cells AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY community, id) - 1 AS cell FROM parts)
"""


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = parts(spark, sf_dir).groupBy("district").agg(F.count(F.lit(1)).alias("n"))
    from ..operators.ranking import dense_places

    return layout.place_districts(dense_places(counts, [F.col("district")], "place").withColumn("place", F.col("place") - 1))


@query("f25_grid", _LAYOUT + "SELECT district, CAST(columns AS BIGINT) AS columns, CAST(rows AS BIGINT) AS rows, round(width, 6) AS width, round(depth, 6) AS depth FROM sized")
def f25(spark, sf_dir):
    counts = parts(spark, sf_dir).groupBy("district").agg(F.count(F.lit(1)).alias("n"))
    sized = counts.withColumns(layout.grid(F.col("n")))
    return sized.select("district", F.col("columns").cast("long"), F.col("rows").cast("long"), F.round("width", 6).alias("width"), F.round("depth", 6).alias("depth"))


@query("w5_layout_offsets", _LAYOUT + "SELECT district, round(x, 6) AS x, round(z, 6) AS z FROM districts")
def w5(spark, sf_dir):
    return districts(spark, sf_dir).select("district", F.round("x", 6).alias("x"), F.round("z", 6).alias("z"))


@query("w6_cells", _LAYOUT + "SELECT id, cell FROM cells")
def w6(spark, sf_dir):
    return layout.cells(parts(spark, sf_dir)).select("id", "cell")


_PLACED = (
    "SELECT c.id, round(d.x - (columns - 1) * 2.8 + (cell % columns) * CAST(5.6 AS DOUBLE), 6) AS x, round(d.z - (rows - 1) * 2.8 + floor(cell / columns) * CAST(5.6 AS DOUBLE), 6) AS z, "
    "round(0.5 + least(greatest(2.8 + 1.8 * log2(CAST(watches AS DOUBLE) + 1), 3.5), 15) / 2, 6) AS y FROM cells c JOIN districts d USING (district)"
)


@query("layout_buildings", _LAYOUT + _PLACED)
def buildings(spark, sf_dir):
    placed = layout.place_buildings(parts(spark, sf_dir), districts(spark, sf_dir))
    return placed.select("id", *(F.round(c, 6).alias(c) for c in ("x", "y", "z")))


@query("a29_extents", _LAYOUT + f"SELECT min(x) AS min_x, max(x) AS max_x, min(z) AS min_z, max(z) AS max_z FROM ({_PLACED})")
def a29(spark, sf_dir):
    found = layout.extents(layout.place_buildings(parts(spark, sf_dir), districts(spark, sf_dir)))
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


@query("a28_frame_percentiles", "WITH s AS (SELECT event_type AS kind, list_sort(list(value)) AS v FROM events GROUP BY 1) SELECT kind, round(list_avg(v), 6) AS mean, v[least(len(v) - 1, CAST(floor(len(v) * 0.5) AS BIGINT)) + 1] AS p50, v[least(len(v) - 1, CAST(floor(len(v) * 0.95) AS BIGINT)) + 1] AS p95 FROM s")
def a28(spark, sf_dir):
    found = layout.frame_percentiles(table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), "value"), 0.5, 0.95)
    return found.withColumn("mean", F.round("mean", 6))


@query(
    "w8_recent_frames",
    "WITH f AS (SELECT event_type AS kind, event_id AS i, epoch_us(ts) AS moment FROM events), d AS (SELECT *, moment - lag(moment) OVER (PARTITION BY kind ORDER BY moment, i) AS delta, min(moment) OVER (PARTITION BY kind) AS start FROM f) "
    "SELECT kind, i, delta, round(avg(delta) OVER (PARTITION BY kind ORDER BY moment, i ROWS BETWEEN 899 PRECEDING AND CURRENT ROW), 4) AS mean FROM d WHERE moment - start >= 5000000 AND delta < 900000000",
)
def w8(spark, sf_dir):
    frames = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("i"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return layout.recent_frames(frames, 5_000_000, 900_000_000, 900).select("kind", "i", "delta", F.round("mean", 4).alias("mean"))


@query("f26_pseudo_random", "SELECT p_partkey AS i, round(x - floor(x), 5) AS r FROM (SELECT p_partkey, sin(p_partkey * 12.9898::DOUBLE + 78.233) * 43758.5453 AS x FROM part)")
def f26(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.round(layout.pseudo_random(F.col("p_partkey")), 5).alias("r"))


@query(
    "f21_flags",
    "SELECT p_partkey AS id, array_to_string(list_filter([CASE WHEN p_partkey % 3 = 0 THEN 'breakout' END, CASE WHEN p_size % 4 = 1 THEN 'cooling' END, CASE WHEN p_size % 4 = 2 THEN 'inactive' END, "
    "CASE WHEN p_brand = 'Brand#2' THEN 'frontier' END], lambda f: f IS NOT NULL), ',') AS flags FROM part",
)
def f21(spark, sf_dir):
    status = F.when(F.col("p_size") % 4 == 1, "cooling").when(F.col("p_size") % 4 == 2, "inactive")
    found = city.flags(F.col("p_partkey") % 3 == 0, status, F.when(F.col("p_brand") == "Brand#2", "frontier").otherwise("x"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(found, ",").alias("flags"))


_DAILY = "WITH daily AS (SELECT user_id AS key, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY ALL) "


@query("a21_signals", _DAILY + "SELECT key, CAST(sum(n) AS BIGINT) AS total, max(n) AS max_daily, count(*) AS active_days FROM daily GROUP BY key")
def a21(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key"), F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return city.detection_signals(daily)


@query(
    "f22_explanation",
    _DAILY + "SELECT key, 'Noticed after ' || CAST(sum(n) AS BIGINT) || ' events from 2024-01-01 inclusive to 2024-01-31 exclusive, with a daily peak of ' || max(n) || ' across ' || count(*) || ' active days. Selection rule: at least 5 events in one UTC day.' AS summary FROM daily GROUP BY key",
)
def f22(spark, sf_dir):
    text = city.explanation(F.col("total"), F.col("max_daily"), F.col("active_days"), F.lit("2024-01-01"), F.lit("2024-01-31"), city.selection_rule("any-day", 5))
    return a21(spark, sf_dir).select("key", text.alias("summary"))


@query("a24_latest_week", "SELECT user_id AS key, CAST(max(CAST(date_trunc('week', ts) AS DATE)) AS VARCHAR) AS week FROM events WHERE date_trunc('week', ts) < TIMESTAMP '2024-01-22' GROUP BY user_id")
def a24(spark, sf_dir):
    weeks = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.to_date(F.date_trunc("week", "ts")).alias("week")).distinct()
    return city.latest_week(weeks, F.lit("2024-01-22").cast("date")).select("key", F.col("latest.week").cast("string").alias("week"))


@query("a25_latest_input", "SELECT user_id, greatest(max(ts) FILTER (event_type = 'view'), max(ts) FILTER (event_type = 'purchase'))::VARCHAR AS latest FROM events GROUP BY user_id")
def a25(spark, sf_dir):
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts").cast("string")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.greatest(last("view"), last("purchase")).alias("latest"))
