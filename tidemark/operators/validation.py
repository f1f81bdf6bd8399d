"""Rules of valid data as data: a bit for each rule in a mask of every row, one aggregate for each relation."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """``holds`` must be true of every row; null breaks the rule too."""

    problem: str
    holds: Column


class Unique(NamedTuple):
    """No two rows have the same value; null values aren't compared."""

    problem: str
    column: str


def masked(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rows`` with ``broken``: bit k is set where rule k doesn't hold."""
    if len(rules) > 63:
        raise ValueError("a mask has 63 bits")
    bits = [F.when(F.coalesce(r.holds, F.lit(False)), F.lit(0)).otherwise(F.lit(1 << k)).cast("long") for k, r in enumerate(rules)]
    return rows.withColumn("broken", sum(bits, F.lit(0).cast("long")))


def violations(rows: DataFrame, rules: list[Rule | Unique]) -> DataFrame:
    """problem, n: rows that break each rule, or that repeat a value beyond its first row; only rules that are broken. One pass over ``rows``."""
    plain, unique = [r for r in rules if isinstance(r, Rule)], [r for r in rules if isinstance(r, Unique)]
    counts = [F.count_if(F.col("broken").bitwiseAND(1 << k) != 0).alias(f"b{k}") for k in range(len(plain))]
    repeats = [(F.count(u.column) - F.count_distinct(u.column)).alias(f"u{k}") for k, u in enumerate(unique)]
    row = masked(rows, plain).agg(*counts, *repeats)
    names = [(f"b{k}", r.problem) for k, r in enumerate(plain)] + [(f"u{k}", u.problem) for k, u in enumerate(unique)]
    return row.select(F.inline(F.array(*(F.struct(F.lit(p).alias("problem"), F.col(c).alias("n")) for c, p in names)))).filter("n > 0")


def _filled(value: Column) -> Column:
    return F.length(value) > 0


def _count(value: Column) -> Column:
    return value >= 0


def _maybe(value: Column, holds: Column) -> Column:
    return value.isNull() | holds


_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}([.]\d+)?)?Z\z"


def _time(value: Column) -> Column:
    return value.rlike(_TIME) & F.try_to_timestamp(value).isNotNull()


def _every(column: str, holds) -> Column:
    """The list is there, and ``holds`` of each of its elements."""
    return F.col(column).isNotNull() & F.forall(F.col(column), lambda x: F.coalesce(holds(x), F.lit(False)))


def city_rules() -> list[Rule]:
    """What a city document (``documents.SCHEMAS['city-v1']``) must be like: one row a document, its lists judged in place."""
    field = lambda path: F.col(path)
    rules = [
        Rule("schema_version", field("schema_version") == "city-v1"),
        Rule("generated_at", _time(field("generated_at"))),
        Rule("period", field("period") == "weekly"),
        *(Rule(f"window.{c}", _time(field(f"window.{c}"))) for c in ("from", "to")),
        *(Rule(f"methodology.{c}", _filled(field(f"methodology.{c}"))) for c in ("builder", "district_assignment", "community_assignment", "ai_relevance", "repository_lifecycle")),
        *(Rule(f"source.{c}_schema_version", _filled(field(f"source.{c}_schema_version"))) for c in ("activity", "analysis", "lifecycle")),
        *(Rule(f"source.{c}coverage_complete", field(f"source.{c}coverage_complete").isNotNull()) for c in ("activity_", "analysis_", "lifecycle_", "")),
        *(Rule(f"source.{c}", _count(field(f"source.{c}"))) for c in ("repositories_considered", "ai_related_repositories", "included_repositories", "excluded_missing_metadata")),
        Rule("source.metadata_collected_at", _maybe(field("source.metadata_collected_at"), _time(field("source.metadata_collected_at")))),
        Rule(
            "source.model_classification",
            _maybe(field("source.model_classification"), F.forall(F.array(*(field(f"source.model_classification.{c}") for c in ("provider", "model", "prompt_version", "methodology_version"))), lambda x: F.coalesce(_filled(x), F.lit(False)))),
        ),
        *(Rule(f"districts.{c}", _every("districts", lambda d, c=c: _filled(d[c]))) for c in ("id", "label", "ko")),
        Rule("districts.color", _every("districts", lambda d: d["color"].rlike(r"^#[0-9a-fA-F]{6}\z"))),
        *(Rule(f"communities.{c}", _every("communities", lambda x, c=c: _filled(x[c]))) for c in ("id", "label", "district_id", "status")),
        *(Rule(f"communities.{c}", _every("communities", lambda x, c=c: _count(x[c]))) for c in ("repository_count", "natural_building_count")),
        *(Rule(f"repositories.{c}", _every("repositories", lambda r, c=c: r[c] > 0)) for c in ("repository_id", "global_rank", "community_rank")),
        Rule("repositories.full_name", _every("repositories", lambda r: r["full_name"].rlike(r"^[^/]+/[^/]+\z"))),
        Rule("repositories.url", _every("repositories", lambda r: r["url"].rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/]+"))),
        *(Rule(f"repositories.{c}", _every("repositories", lambda r, c=c: _filled(r[c]))) for c in ("district_id", "community_id", "availability_status")),
        Rule("repositories.ai_relevance", _every("repositories", lambda r: r["ai_relevance"].between(0, 1))),
        *(Rule(f"repositories.{c}", _every("repositories", lambda r, c=c: _count(r[c]))) for c in ("watch_events_window", "stars", "forks")),
        Rule(
            "repositories.counts",
            _every("repositories", lambda r: F.forall(F.array(*(r[c] for c in ("weekly_watch_events", "max_daily_watch_events", "commits_30d", "contributors_count"))), lambda n: _maybe(n, _count(n)))),
        ),
        Rule("repositories.keywords", _every("repositories", lambda r: r["keywords"].isNotNull() & F.forall(r["keywords"], lambda k: F.coalesce(_filled(k), F.lit(False))))),
        Rule("repositories.flags", _every("repositories", lambda r: r["flags"].isNotNull())),
        Rule("repositories.detection_explanation", _every("repositories", lambda r: _maybe(r["detection_explanation"], _explained(r["detection_explanation"])))),
        *(Rule(c, field(c).isNotNull()) for c in ("edges", "community_edges")),
        Rule("display.top_n_options", (F.size("display.top_n_options") > 0) & F.forall("display.top_n_options", lambda n: F.coalesce(n > 0, F.lit(False)))),
        Rule("display.mvp_visible_budget", field("display.mvp_visible_budget") > 0),
    ]
    return rules


def _explained(x: Column) -> Column:
    signals = x["signals"]
    return (
        (x["methodology_version"] == "repository-detection-explanation-v1")
        & _filled(x["label"])
        & _filled(x["summary"])
        & _filled(signals["selection_rule"])
        & signals["archive_coverage_complete"].isNotNull()
        & F.forall(F.array(*(signals[c] for c in ("window_watch_events", "max_daily_watch_events", "active_days"))), lambda n: F.coalesce(_count(n), F.lit(False)))
    )


def city_violations(entities: DataFrame, communities: DataFrame, districts: list[str]) -> DataFrame:
    """problem, n: rules of a valid city's tables that don't hold, from one pass over ``entities``. No rows: valid."""
    known = communities.select(F.col("community").alias("community_")).distinct()
    rows = entities.join(known, F.col("community") == F.col("community_"), "left")
    return violations(
        rows,
        [
            Rule("unknown district", F.col("district").isin(*districts)),
            Rule("unknown community", F.col("community_").isNotNull()),
            Rule("rank below one", (F.col("global_rank") >= 1) & (F.col("community_rank") >= 1)),
            Rule("negative count", (F.col("watches") >= 0) & (F.coalesce("stars", F.lit(0)) >= 0)),
            Unique("duplicate id", "id"),
            Unique("rank given twice", "global_rank"),
        ],
    )
