"""Rules of valid data: each has an example that breaks it, and all are judged in one pass."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import coverage, validation
from tidemark.sources import documents

CITY = {
    "schema_version": "city-v1",
    "generated_at": "2026-08-03T00:00:00.000Z",
    "period": "weekly",
    "window": {"from": "2026-07-27T00:00:00.000Z", "to": "2026-08-03T00:00:00.000Z"},
    "methodology": {"builder": "b", "district_assignment": "d", "community_assignment": "c", "ai_relevance": "a", "repository_lifecycle": "r"},
    "source": {
        "activity_schema_version": "activity-series-v1", "analysis_schema_version": "topic-analysis-v1", "lifecycle_schema_version": "repository-lifecycle-v1",
        "activity_coverage_complete": True, "analysis_coverage_complete": False, "lifecycle_coverage_complete": True, "coverage_complete": False,
        "repositories_considered": 3, "ai_related_repositories": 2, "included_repositories": 1, "excluded_missing_metadata": 0,
    },
    "districts": [{"id": "agents", "label": "Agents", "ko": "에이전트", "color": "#12aBff"}],
    "communities": [{"id": "rag", "label": "RAG", "district_id": "agents", "status": "emerging", "repository_count": 1, "natural_building_count": 1}],
    "repositories": [
        {
            "repository_id": 7, "full_name": "a/b", "url": "https://a.example/b", "district_id": "agents", "community_id": "rag", "global_rank": 1, "community_rank": 1, "ai_relevance": 0.5,
            "availability_status": "available", "watch_events_window": 3, "stars": 0, "forks": 0, "keywords": ["rag"], "flags": [],
        }
    ],
    "edges": [],
    "community_edges": [],
    "display": {"top_n_options": [5, 10], "mvp_visible_budget": 100},
}
EXPLAINED = {"methodology_version": "repository-detection-explanation-v1", "label": "why", "summary": "s", "signals": {"window_watch_events": 1, "max_daily_watch_events": 1, "active_days": 1, "selection_rule": "r", "archive_coverage_complete": True}}
BROKEN = [
    ("schema_version", ["schema_version"], "city-v2"),
    ("generated_at", ["generated_at"], "yesterday"),
    ("generated_at", ["generated_at"], "2026-13-03T00:00:00Z"),
    ("period", ["period"], "daily"),
    ("window.from", ["window", "from"], None),
    ("window.to", ["window", "to"], "2026-08-03"),
    *((f"methodology.{c}", ["methodology", c], "") for c in CITY["methodology"]),
    *((f"source.{c}_schema_version", ["source", f"{c}_schema_version"], "") for c in ("activity", "analysis", "lifecycle")),
    *((f"source.{c}coverage_complete", ["source", f"{c}coverage_complete"], None) for c in ("activity_", "analysis_", "lifecycle_", "")),
    *((f"source.{c}", ["source", c], -1) for c in ("repositories_considered", "ai_related_repositories", "included_repositories", "excluded_missing_metadata")),
    ("source.metadata_collected_at", ["source", "metadata_collected_at"], "now"),
    ("source.model_classification", ["source", "model_classification"], {"provider": "p", "model": "", "prompt_version": "1", "methodology_version": "1"}),
    *((f"districts.{c}", ["districts", 0, c], "") for c in ("id", "label", "ko")),
    ("districts.color", ["districts", 0, "color"], "red"),
    *((f"communities.{c}", ["communities", 0, c], "") for c in ("id", "label", "district_id", "status")),
    *((f"communities.{c}", ["communities", 0, c], -1) for c in ("repository_count", "natural_building_count")),
    *((f"repositories.{c}", ["repositories", 0, c], 0) for c in ("repository_id", "global_rank", "community_rank")),
    ("repositories.full_name", ["repositories", 0, "full_name"], "a/b/c"),
    ("repositories.url", ["repositories", 0, "url"], "a.example"),
    *((f"repositories.{c}", ["repositories", 0, c], "") for c in ("district_id", "community_id", "availability_status")),
    ("repositories.ai_relevance", ["repositories", 0, "ai_relevance"], 1.5),
    *((f"repositories.{c}", ["repositories", 0, c], None) for c in ("watch_events_window", "stars", "forks")),
    ("repositories.counts", ["repositories", 0, "commits_30d"], -1),
    ("repositories.keywords", ["repositories", 0, "keywords"], ["rag", ""]),
    ("repositories.flags", ["repositories", 0, "flags"], None),
    ("repositories.detection_explanation", ["repositories", 0, "detection_explanation"], EXPLAINED | {"summary": ""}),
    ("edges", ["edges"], None),
    ("community_edges", ["community_edges"], None),
    ("display.top_n_options", ["display", "top_n_options"], []),
    ("display.top_n_options", ["display", "top_n_options"], [5, 0]),
    ("display.mvp_visible_budget", ["display", "mvp_visible_budget"], 0),
]


def changed(path, value):
    doc = json.loads(json.dumps(CITY))
    at = doc
    for step in path[:-1]:
        at = at[step]
    at[path[-1]] = value
    return doc


def test_every_rule_of_a_city(spark):
    kind = spark.createDataFrame([], documents.SCHEMAS["city-v1"]).schema
    docs = [CITY, changed(["repositories", 0, "detection_explanation"], EXPLAINED), changed(["repositories", 0, "description"], None), *(changed(p, v) for _, p, v in BROKEN)]
    rows = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)], "k int, text string").select("k", F.from_json("text", kind).alias("d")).select("k", "d.*")
    rules = validation.city_rules()
    names = [r.problem for r in rules]
    assert set(names) == {n for n, *_ in BROKEN} and len(names) == len(set(names)) < 64
    found = {r.k: [n for b, n in enumerate(names) if r.broken >> b & 1] for r in validation.masked(rows, rules).select("k", "broken").collect()}
    assert [found[k] for k in range(len(docs))] == [[], [], [], *([n] for n, *_ in BROKEN)]
    counted = {r.problem: r.n for r in validation.violations(rows, rules).collect()}
    assert counted == {n: sum(b == n for b, *_ in BROKEN) for n in names}


def test_tables_in_one_pass(spark, tmp_path):
    rows = [(1, "agents", "rag", 1, 1, 5, 9), (2, "agents", "rag", 2, 2, 5, None), (2, "harbour", "rag", 2, 3, -5, 9), (3, "agents", "who", 0, 1, 5, -9)]
    spark.createDataFrame(rows, "id long, district string, community string, global_rank long, community_rank long, watches long, stars long").write.parquet(str(tmp_path / "e"))
    entities = spark.read.parquet(str(tmp_path / "e"))
    found = validation.city_violations(entities, spark.createDataFrame([("rag",), ("rag",)], "community string"), ["agents"])
    assert {r.problem: r.n for r in found.collect()} == {"unknown district": 1, "unknown community": 1, "rank below one": 1, "negative count": 2, "duplicate id": 1, "rank given twice": 1}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1
    assert validation.violations(entities.filter("id = 1"), [validation.Rule("one", F.col("id") == 1), validation.Unique("twice", "id")]).count() == 0
    with pytest.raises(ValueError):
        validation.masked(entities, [validation.Rule(str(k), F.lit(True)) for k in range(64)])


def test_coverage_is_carried_along(spark):
    errors = lambda source, n: spark.createDataFrame([(source, f"t{k}", "m") for k in range(n)], "source string, target string, message string")
    archive, metadata, model = coverage.covered("archive", errors("archive", 2)), coverage.covered("metadata", errors("metadata", 0)), coverage.covered("model", errors("model", 1), F.lit("model-request-failed"))
    summary = lambda c: {r.level: (r.errors, r.complete) for r in c.summary().collect()}
    assert summary(metadata) == {"metadata": (0, True), None: (0, True)}
    assert summary(archive.merged(metadata)) == {"archive": (2, False), "metadata": (0, True), None: (2, False)}
    assert summary(metadata.merged(model, archive, archive)) == {"archive": (2, False), "metadata": (0, True), "model": (1, False), None: (3, False)}
    assert [r.code for r in metadata.merged(model).errors.collect()] == ["model-request-failed"]


def test_optional_parts(spark):
    rows = spark.createDataFrame([(1, 200, "text"), (2, 404, "page not found"), (3, 500, "oops"), (4, None, None), (5, 403, None)], "id long, status int, readme string")
    found, errors = coverage.optional_part(rows, "id", "readme", "status", "readme")
    assert {r.id: (r.outcome, r.readme) for r in found.collect()} == {1: ("found", "text"), 2: ("missing", None), 3: ("failed", None), 4: ("failed", None), 5: ("failed", None)}
    assert sorted((r.target, r.code, r.message) for r in errors.collect()) == [("3", "500", "readme: 500"), ("4", None, "readme: no answer"), ("5", "403", "readme: 403")]
