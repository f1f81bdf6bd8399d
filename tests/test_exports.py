"""Documents that the commands write: their fields, and series that go through a document and back."""

import json

from tidemark.__main__ import main
from tidemark.plans import commands, exports
from tidemark.sources import archive as hours
from tidemark.sources import documents, tables

from .test_commands import archive

START = "2026-07-27T00:00:00Z"


def rows(spark, path, name):
    return sorted((tuple(r) for r in tables.read_relation(spark, f"{path}/{name}", "1").collect()), key=str)


def one(folder):
    found = list(folder.iterdir())
    assert len(found) == 1
    return found[0].name, json.loads(found[0].read_text())


def test_candidates(spark, tmp_path):
    (tmp_path / "in").mkdir()
    archive(tmp_path / "in", 1)
    (tmp_path / "in" / "2026-07-27-7.json.gz").unlink()
    spark.createDataFrame([(5, "Graph/RAG", 90, ["rag"])], "id long, full_name string, stars long, topics array<string>").write.parquet(str(tmp_path / "metadata"))
    main(["discover", str(tmp_path / "in"), "--from", START, "--top", "2", "--metadata", str(tmp_path / "metadata"), "--out", str(tmp_path / "out"), "--document", str(tmp_path / "docs")])
    name, doc = one(tmp_path / "docs")
    assert name == "2026-07-27T00-00-00.000Z_2026-07-28T00-00-00.000Z.json"
    assert doc["schema_version"] == "candidate-v1" and doc["window"] == {"from": "2026-07-27T00:00:00.000Z", "to": "2026-07-28T00:00:00.000Z"}
    source = doc["source"]
    assert (source["hours_requested"], source["hours_collected"], source["repositories_seen"], source["coverage_complete"]) == (24, 23, 3, False)
    assert [(e["source"], e["target"]) for e in source["coverage_errors"]] == [("gh-archive", "2026-07-27T07:00:00.000Z"), ("github", "agents/mcp")]
    assert source["watch_events_seen"] == source["event_integrity"]["unique_watch_events"] == 23 + 5 + 1 + 8
    assert source["event_integrity"]["deduplication_applied"] is True
    assert [(r["full_name"], r["watch_events"]) for r in doc["repositories"]] == [("graph/rag", 28), ("agents/mcp", 8)]
    github = doc["repositories"][0]["github"]
    assert (github["id"], github["stars"], github["topics"], github["readme"]) == (5, 90, ["rag"], None) and doc["repositories"][1]["github"] is None
    assert documents.read(spark, str(tmp_path / "docs"), "candidate-v1")["candidate-v1"].count() == 1


def test_series_and_lifecycle(spark, tmp_path):
    """Commands give the same from a series' document as from its tables."""
    (tmp_path / "in").mkdir()
    archive(tmp_path / "in")
    out = tmp_path / "out"
    main(["backfill", str(tmp_path / "in"), "--from", START, "--out", str(out / "series"), "--document", str(tmp_path / "raw")])
    name, doc = one(tmp_path / "raw")
    assert name == "2026-07-27T00-00-00.000Z_2026-08-03T00-00-00.000Z.json" and doc["window"]["days"] == 7
    source = doc["source"]
    assert (source["type"], source["coverage_complete"], source["hours_requested"], source["hours_collected"]) == ("gh-archive", True, 168, 168)
    assert source["metadata_selection"] is None and source["coverage_errors"] == [] and source["repositories_seen"] == 3
    assert [d["date"] for d in doc["days"]] == [f"2026-{d}" for d in ("07-27", "07-28", "07-29", "07-30", "07-31", "08-01", "08-02")]
    assert sum(d["event_integrity"]["unique_watch_events"] for d in doc["days"]) == source["event_integrity"]["unique_watch_events"] == source["watch_events_observed"] == 263
    assert [(r["full_name"], r["watch_events_observed_total"], r["observed_watch_velocity_per_day"], r["current"]) for r in doc["repositories"]] == [
        ("graph/rag", 202, 28.8571, None), ("agents/mcp", 56, 8.0, None), ("small/tool", 5, 0.7143, None),
    ]
    assert [p["watch_events_observed"] for p in doc["repositories"][1]["daily"]] == [8] * 7

    spark.createDataFrame([(5, "graph/rag", 7), (6, "small/tool", 1)], "id long, full_name string, stars long").write.parquet(str(tmp_path / "metadata"))
    enrich = lambda given, to: main(["enrich", str(given), "--metadata", str(tmp_path / "metadata"), "--out", str(out / to), "--document", str(tmp_path / f"{to}-docs")])
    enrich(out / "series", "rich")
    name, rich = one(tmp_path / "rich-docs")
    assert name.endswith("-enriched.json") and rich["source"]["type"] == "gh-archive+github" and not rich["source"]["coverage_complete"]
    chosen = {k: v for k, v in rich["source"]["metadata_selection"].items() if v is not None}
    assert chosen == {"method": "minimum-daily-watch-events", "minimum_daily_watch_events": 5, "metadata_profile": "full", "selected": 2, "collected": 1}
    assert [(r["full_name"], r["metadata_selected"], r["current"] and r["current"]["id"]) for r in rich["repositories"]] == [("graph/rag", True, 5), ("agents/mcp", True, None), ("small/tool", False, None)]

    back = exports.series_of(documents.read(spark, str(tmp_path / "rich-docs"), "activity-series-v1")["activity-series-v1"])
    for table in ("daily", "days", "integrity", "errors", "coverage", "selection"):
        want = tables.read_relation(spark, str(out / "rich" / table), "1")
        if table == "errors":  # the documents' order and names
            want = want.select("source", "target", "message")
        assert sorted(map(str, back[table].select(want.columns).collect())) == sorted(map(str, want.collect())), table

    main(["lifecycle", str(out / "rich"), "--scout-weekly", "6", "--breakout-weekly", "100", "--out", str(out / "life"), "--document", str(tmp_path / "life-docs")])
    followed = commands.follow(spark, [back], {"main": 5, "scout": 6, "breakout": 100})
    for table in ("states", "weeks", "events", "summary", "window", "coverage"):
        assert rows(spark, out / "life", table) == sorted(map(tuple, followed[table].collect()), key=str), table
    a = one(tmp_path / "life-docs")[1]
    assert [i["file_name"] for i in a["source"]["input_snapshots"]] == ["rich"] and a["source"]["coverage_complete"]
    assert {a["source"]["integrity_verification"], a["weeks"][0]["integrity_verification"], a["repositories"][0]["weeks"][0]["integrity_verification"]} == {"verified"}
    assert a["generated_at"] == a["window"]["to"] == "2026-08-03T00:00:00.000Z" and a["methodology"]["scout_weekly_watch_events"] == 6
    assert a["weeks"][0]["from"] == "2026-07-27T00:00:00.000Z" and a["weeks"][0]["decision_coverage"] == "complete" and a["weeks"][0]["repositories_observed"] == 3
    states = {r["full_name"]: (r["repository_id"], r["radar_status"], r["availability_status"], r["breakout_status"], len(r["weeks"])) for r in a["repositories"]}
    assert states["graph/rag"] == (5, "candidate", "available", "pending", 1) and states["small/tool"][:2] == (None, None)
    assert [r["full_name"] for r in a["repositories"]] == ["agents/mcp", "graph/rag", "small/tool"]
    assert a["repositories"][1]["breakout_detected_at"] == "2026-07-27T00:00:00.000Z"
    assert {(e["full_name"], e["type"]) for e in a["events"]} >= {("graph/rag", "breakout_detected"), ("agents/mcp", "candidate_detected")}


def test_a_raw_document_is_selected_when_enriched(spark, tmp_path):
    """By the usual rule, or by the one that the command is given."""
    day = {"date": "2026-07-27", "hours_requested": 24, "hours_collected": 20, "coverage_complete": False, "watch_events_observed": 9}
    listed = [{"full_name": n, "watch_events_observed_total": k, "daily": [{"date": "2026-07-27", "watch_events_observed": k}], "metadata_selected": False, "current": None} for n, k in (("A/b", 6), ("c/d", 3))]
    doc = {"schema_version": "activity-series-v1", "source": {"type": "gh-archive", "archive_coverage_complete": False}, "days": [day], "repositories": listed}
    (tmp_path / "raw.json").write_text(json.dumps(doc))
    series = exports.series_of(documents.read(spark, str(tmp_path / "raw.json"), "activity-series-v1")["activity-series-v1"])
    metadata = spark.createDataFrame([(5, "a/B"), (6, "c/d")], "id long, full_name string")
    chosen = lambda **rule: {r.full_name: r.current and r.current.id for r in commands.enrich(series, metadata, **rule)["activity"].collect()}
    assert chosen() == {"A/b": 5, "c/d": None} and chosen(least_total=3) == {"A/b": 5, "c/d": 6} and chosen(least_daily=7) == {"A/b": None, "c/d": None}
    assert {(r.level, r.errors, r.complete) for r in series["coverage"].collect()} == {("archive", 1, False), (None, 1, False)}
    life = exports.lifecycle_document(commands.follow(spark, [series]), [("raw.json", series)]).first()  # deduplication isn't told of
    assert {life.source.integrity_verification, life.source.input_snapshots[0].integrity_verification, life.weeks[0].integrity_verification} == {"unavailable"}


def test_an_empty_window(spark, tmp_path):
    """No file at all: every hour is an error, lists are empty."""
    (tmp_path / "in").mkdir()
    archive(tmp_path / "in", 1)
    found = commands.discover(spark, str(tmp_path / "in"), "2026-09-01T00:00:00Z", 2)
    row = exports.candidate_document(found, hours.hour_window("2026-09-01T00:00:00Z", 2)[0], 2).first()
    assert row.repositories == [] and len(row.source.coverage_errors) == 2 and row.source.hours_collected == 0 and row.source.watch_events_seen == 0
