"""Decision cache, batches, hashes and the connectors' text functions over documents, parts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import coverage, decisions
from ..sources.archive import readme_text
from ..sources.tables import fingerprint_of
from .registry import query, table

_TOPICS = "'[' || array_to_string(list_transform(list_sort(list_distinct(list_filter(list_transform(string_split(p_name, ' '), lambda t: lower(trim(t))), lambda t: t <> ''))), lambda t: '\"' || t || '\"'), ',') || ']'"
_KEYS = f"""
WITH inputs AS (SELECT p_partkey AS id, p_name AS description, {_TOPICS} AS topics FROM part),
hashed AS (SELECT *, 'sha256:' || sha256('{{"schema":"ai-relevance-metadata-v1","description":"' || description || '","topics":' || topics || '}}') AS metadata_hash FROM inputs),
keyed AS (SELECT *, 'sha256:' || sha256('{{"schema":"ai-relevance-cache-key-v1","repository_id":"' || id || '","metadata_hash":"' || metadata_hash || '","provider":"acme","model":"m1","prompt_version":"p1","methodology_version":"v1"}}') AS key FROM hashed)
"""


def keyed(spark, sf_dir, model="m1"):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("description"), F.split("p_name", " ").alias("topics"))
    return decisions.cache_keys(decisions.model_input(parts), "acme", model, "p1", "v1")


@query("f14_hash", _KEYS + "SELECT id, metadata_hash, key FROM keyed")
def f14(spark, sf_dir):
    return keyed(spark, sf_dir).select("id", "metadata_hash", "key")


@query("j11_cache_split", _KEYS + "SELECT CASE WHEN id % 3 = 0 THEN 'cache' ELSE 'model' END AS origin, count(*) AS n FROM keyed GROUP BY 1")
def j11(spark, sf_dir):
    rows = keyed(spark, sf_dir)
    cache = rows.filter("id % 3 = 0").select("key", F.lit("review").alias("decision"), F.lit("").alias("evidence"))
    hits, misses = decisions.cache_split(rows, cache.unionByName(keyed(spark, sf_dir, "m2").filter("id % 3 = 1").select("key", F.lit("review").alias("decision"), F.lit("").alias("evidence"))))
    return hits.select(F.lit("cache").alias("origin")).unionByName(misses.select(F.lit("model").alias("origin"))).groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query("s12_corrupt_cache", "SELECT p_partkey AS id FROM part WHERE p_partkey % 50 = 0 OR p_partkey % 70 = 1")
def s12(spark, sf_dir):
    cache = keyed(spark, sf_dir).select(
        "id", "metadata_hash", F.lit("acme").alias("provider"), F.lit("m1").alias("model"), F.lit("p1").alias("prompt_version"), F.lit("v1").alias("method_version"),
        F.when(F.col("id") % 50 == 0, "sha256:0").otherwise(F.col("key")).alias("key"), F.when(F.col("id") % 70 == 1, "maybe").otherwise("review").alias("decision"),
    )
    return decisions.corrupt_entries(cache).select("id")


@query("o9_batches", "SELECT doc_id AS id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 20 AS BIGINT) AS batch FROM documents")
def o9(spark, sf_dir):
    return decisions.batches(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), 20)


_ANSWERS = """
WITH asked AS (SELECT p_partkey AS id, p_partkey // 20 AS batch FROM part),
answers AS (
    SELECT id, batch, CASE WHEN id % 13 = 0 THEN 'perhaps' WHEN id % 2 = 0 THEN 'review' ELSE 'not-ai' END AS decision FROM asked WHERE id % 11 <> 0
    UNION ALL SELECT id, batch, 'review' FROM asked WHERE id % 17 = 0 UNION ALL SELECT id + 1000000, batch, 'review' FROM asked WHERE id % 199 = 0)
"""


@query(
    "x4_strict_responses",
    _ANSWERS
    + """, spoiled AS (SELECT DISTINCT batch FROM answers ANTI JOIN asked USING (id, batch)), times AS (SELECT id, batch, count(*) AS n, min(decision) AS decision FROM answers GROUP BY id, batch)
    SELECT id, batch, CASE WHEN problem IS NULL THEN decision END AS decision, problem FROM (
        SELECT a.id, a.batch, t.decision, CASE WHEN s.batch IS NOT NULL THEN 'unknown-id' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' WHEN t.decision = 'perhaps' THEN 'invalid-decision' END AS problem
        FROM asked a LEFT JOIN times t USING (id, batch) LEFT JOIN spoiled s ON s.batch = a.batch)""",
)
def x4(spark, sf_dir):
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 20").alias("batch"))
    answer = F.when(F.col("id") % 13 == 0, "perhaps").when(F.col("id") % 2 == 0, "review").otherwise("not-ai")
    answers = asked.filter("id % 11 <> 0").withColumn("decision", answer)
    answers = answers.unionByName(asked.filter("id % 17 = 0").withColumn("decision", F.lit("review")))
    answers = answers.unionByName(asked.filter("id % 199 = 0").withColumns({"id": F.col("id") + 1_000_000, "decision": F.lit("review")}))
    return decisions.strict_responses(asked, answers)


@query(
    "a26_run_stats",
    "SELECT count(*) AS labelled, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality = 1) + count(*) FILTER (quality = 0) = count(*) AS adds_up FROM labels",
)
def a26(spark, sf_dir):
    good, bad = F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)
    return table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("labelled"), good.alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), (good + bad == F.count(F.lit(1))).alias("adds_up"))


def _rated(batch):
    """A model that fails for some, leaves some out, and has an opinion on the others."""
    if any(r["id"] % 400 == 7 for r in batch):
        raise OSError("no connection")
    kinds = ("ai-related", "review", "not-ai")
    return [{"id": r["id"], "decision": kinds[r["id"] % 3], "evidence": f"part {r['id']}"} for r in batch if r["id"] % 13 != 0]


@query(
    "a26_model_run",
    f"""WITH placed AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 20 AS batch FROM (SELECT DISTINCT p_partkey AS id FROM part)),
    judged AS (SELECT id, batch < {decisions.MAX_BUDGET} AS asked, asked AND bool_or(id % 400 = 7) OVER (PARTITION BY batch) AS failed, asked AND NOT failed AND id % 13 = 0 AS left_out, asked AND NOT failed AND NOT left_out AS decided FROM placed)
    SELECT count(*) AS candidates, 0::BIGINT AS cache_hits, count(*) FILTER (decided) AS provider_decisions, count(*) FILTER (decided AND id % 3 = 0) AS ai_related,
        count(*) FILTER (decided AND id % 3 = 1) AS review, count(*) FILTER (decided AND id % 3 = 2) AS not_ai, count(*) FILTER (failed) AS request_failed,
        count(*) FILTER (left_out) AS response_invalid, count(*) FILTER (NOT asked) AS budget_exhausted, (SELECT count(DISTINCT batch) FROM placed WHERE batch < {decisions.MAX_BUDGET})::BIGINT AS requests, true AS adds_up FROM judged""",
)
def a26_run(spark, sf_dir):
    """Batches of 20 by id, each asked once, the first ``MAX_BUDGET`` of them; what is left over has exhausted the budget."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("description"), F.split("p_name", " ").alias("topics"))
    run = decisions.model_run(parts, decisions.Model(_rated, "acme", "m1", retries=0))
    return run.statistics.withColumn("requests", F.col("requests").cast("long")).drop("budget")


@query("f18_ordinal", "SELECT doc_id, CASE WHEN quality = 1 THEN CAST(1 AS DOUBLE) WHEN toxic = 1 THEN CAST(0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS score FROM labels")
def f18(spark, sf_dir):
    decision = F.when(F.col("quality") == 1, "ai-related").when(F.col("toxic") == 1, "not-ai").otherwise("review")
    return table(spark, sf_dir, "labels").select("doc_id", text.ordinal(decision).alias("score"))


@query("s10_base64", "SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN text END AS readme FROM documents")
def s10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.base64(F.col("text").cast("binary")).alias("content"), F.when(F.col("doc_id") % 5 > 0, "base64").otherwise("none").alias("encoding"))
    return docs.select("doc_id", readme_text(F.col("content"), F.col("encoding")).alias("readme"))


@query("f28_basename", "SELECT page_id, string_split(url, '/')[-1] AS name FROM pages")
def f28(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.base_name(F.col("url")).alias("name"))


@query(
    "a31_page_count",
    "SELECT page_id, coalesce(nullif(try_cast(regexp_extract(url, '[?&]page=([0-9]+)(&|#|$)', 1) AS BIGINT), 0), 30) AS pages FROM pages",
)
def a31(spark, sf_dir):
    link = F.concat(F.lit("<"), F.col("url"), F.lit('>; rel="last", <http://a/?page=1>; rel="first"'))
    return table(spark, sf_dir, "pages").select("page_id", text.page_count(link, F.lit(30)).alias("pages"))


@query(
    "k5_redact",
    "SELECT page_id, regexp_replace(regexp_replace(replace(m, 'example', '[REDACTED]'), '(authorization\\s*[:=]\\s*bearer\\s+)[^\\s,;]+', '\\1[REDACTED]', 'gi'), '(bearer\\s+)[A-Za-z0-9._-]+', '\\1[REDACTED]', 'gi') AS message "
    "FROM (SELECT page_id, 'failed ' || url || ' Authorization: Bearer abc' || page_id || '; then bearer x.y-' || page_id || ' again' AS m FROM pages)",
)
def k5(spark, sf_dir):
    message = F.concat(F.lit("failed "), F.col("url"), F.lit(" Authorization: Bearer abc"), F.col("page_id"), F.lit("; then bearer x.y-"), F.col("page_id"), F.lit(" again"))
    return table(spark, sf_dir, "pages").select("page_id", text.redacted(message, ["example", ""]).alias("message"))


@query(
    "a23_language_share",
    "SELECT flag, status, round(q / sum(q) OVER (PARTITION BY flag), 4) AS share FROM (SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)",
)
def a23(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"))
    maps = sums.groupBy(F.col("l_returnflag").alias("flag")).agg(F.map_from_entries(F.collect_list(F.struct("l_linestatus", "q"))).alias("counts"))
    return maps.select("flag", F.explode(text.shares(F.col("counts"))).alias("status", "share")).withColumn("share", F.round("share", 4))


@query("f4_weeks", "SELECT DISTINCT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS monday, strftime(date_trunc('week', ts), '%Y-%m-%dT00:00:00.000Z') AS midnight FROM events")
def f4(spark, sf_dir):
    day = text.monday(F.to_date("ts"))
    return table(spark, sf_dir, "events").select(day.cast("string").alias("monday"), text.iso_midnight(day).alias("midnight")).distinct()


@query(
    "f27_compact",
    "SELECT o_orderkey, CASE WHEN v < 1000 THEN CAST(v AS VARCHAR) WHEN v < 999950 THEN regexp_replace(printf('%.1f', v / 1000.0), '\\.0$', '') || 'K' ELSE regexp_replace(printf('%.1f', v / 1000000.0), '\\.0$', '') || 'M' END AS shown "
    "FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * 10 + 3 AS v FROM orders)",
)
def f27(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.compact(F.floor("o_totalprice").cast("long") * 10 + 3).alias("shown"))


@query("s8_optional_parts", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'missing' WHEN c_custkey % 4 = 1 THEN 'failed' ELSE 'found' END AS outcome FROM customer")
def s8(spark, sf_dir):
    answers = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, 404).when(F.col("c_custkey") % 4 == 1, 500).otherwise(200).alias("status"))
    found, _ = coverage.optional_part(answers.withColumn("readme", F.lit("text")), "c_custkey", "readme", "status", "readme")
    return found.select("c_custkey", "outcome")


@query("a32_coverage_algebra", "SELECT o_orderstatus AS input, count(*) FILTER (o_orderkey % 97 = 5) AS errors, count(*) FILTER (o_orderkey % 97 = 5) = 0 AS complete FROM orders GROUP BY GROUPING SETS ((1), ())")
def a32(spark, sf_dir):
    """Orders of a status are a level; its errors are merged with those of the other levels."""
    orders = table(spark, sf_dir, "orders")
    errors = orders.filter("o_orderkey % 97 = 5").select("o_orderstatus", F.lit("archive").alias("source"), F.col("o_orderkey").cast("string").alias("target"), F.lit("bad").alias("message"))
    levels = [coverage.covered(level, errors.filter(F.col("o_orderstatus") == level)) for level in "FOP"]
    return levels[0].merged(*levels[1:], levels[0]).summary().withColumnRenamed("level", "input")


@query("f29_keyword_lists", "SELECT p_brand AS brand, array_to_string(list_sort(list(DISTINCT p_name)), ',') AS names FROM part GROUP BY 1")
def f29(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.array_join(F.array_sort(F.array_distinct(F.collect_set("p_name"))), ",").alias("names"))


@query("k2_identity_suffix", "SELECT p_partkey, substr(sha256(p_name || '/' || p_brand), 1, 12) AS suffix FROM part")
def k2(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fingerprint_of(F.col("p_name"), F.col("p_brand")).alias("suffix"))
