import gzip
import json
from datetime import datetime, timedelta

from tidemark.__main__ import main
from tidemark.operators import validation
from tidemark.plans import commands
from tidemark.sources import tables
from tidemark.streaming import daily as streaming

NAMES = ["graph/rag", "Graph/RAG", "small/tool", "agents/mcp"]


def archive(folder, days=7):
    """Every hour has a file; names take turns by the hour."""
    n = 0
    for h in range(24 * days):
        hour = datetime(2026, 7, 27) + timedelta(hours=h)
        rows = []
        for k, name in enumerate(NAMES):
            if h % (1, 5, 40, 3)[k] == 0:
                n += 1
                rows.append({"id": str(n), "type": "WatchEvent", "repo": {"name": name}, "payload": {"action": "started"}, "created_at": (hour + timedelta(minutes=k)).isoformat() + "Z"})
        (folder / f"{hour:%Y-%m-%d}-{hour.hour}.json.gz").write_bytes(gzip.compress("\n".join(map(json.dumps, rows)).encode()))


def test_from_archive_to_city(spark, tmp_path):
    (tmp_path / "in").mkdir()
    archive(tmp_path / "in")
    src, out = str(tmp_path / "in"), tmp_path / "out"
    start = "2026-07-27T00:00:00Z"
    main(["discover", src, "--from", start, "--hours", "24", "--top", "2", "--out", str(out / "found")])
    found = tables.read_relation(spark, str(out / "found/candidates"), "1").collect()
    assert [(r.full_name, r.n) for r in found] == [("graph/rag", 29), ("agents/mcp", 8)]
    main(["backfill", src, "--from", start, "--days", "7", "--out", str(out / "series")])
    series = {n: tables.read_relation(spark, str(out / "series" / n), "1") for n in ("activity", "daily", "days")}
    rows = {r.key: r for r in series["activity"].collect()}
    assert {k: (r.n, r.selected) for k, r in rows.items()} == {"graph/rag": (202, True), "small/tool": (5, False), "agents/mcp": (56, True)}
    assert rows["agents/mcp"].velocity == 8.0
    assert series["daily"].count() == 21 and series["days"].filter("complete").count() == 7
    main(["lifecycle", str(out / "series"), "--out", str(out / "life")])
    states = {r.key: (r.status, r.availability) for r in tables.read_relation(spark, str(out / "life/states"), "1").collect()}
    assert states == {f"name:{n}": ("candidate", "unknown") for n in ("graph/rag", "small/tool", "agents/mcp")}
    metadata = spark.createDataFrame([(5, "Graph/RAG2", "graph/rag"), (6, "small/tool", "small/tool")], "id long, today string, full_name string")
    metadata.select("full_name", "id", "today").write.parquet(str(tmp_path / "metadata"))
    main(["enrich", str(out / "series"), "--metadata", str(tmp_path / "metadata"), "--out", str(out / "rich")])
    rich = {r.key: r for r in tables.read_relation(spark, str(out / "rich/activity"), "1").collect()}
    assert {k: (r.metadata_selected, r.current and r.current.id) for k, r in rich.items()} == {"graph/rag": (True, 5), "small/tool": (False, None), "agents/mcp": (True, None)}
    assert [r.target for r in tables.read_relation(spark, str(out / "rich/errors"), "1").collect()] == ["agents/mcp"]
    assert tuple(tables.read_relation(spark, str(out / "rich/metadata"), "1").first()) == (2, 1, False)
    main(["lifecycle", str(out / "rich"), "--scout-weekly", "6", "--breakout-weekly", "300", "--out", str(out / "life2")])
    states = {r.key: (r.id, r.status, r.availability) for r in tables.read_relation(spark, str(out / "life2/states"), "1").collect()}
    assert states == {"id:5": (5, "candidate", "available"), "name:small/tool": (None, None, "unknown"), "name:agents/mcp": (None, "candidate", "unavailable")}
    windows = [tables.read_relation(spark, str(out / "life2/window"), "1")] * 3
    assert commands.incompatible(*windows).isEmpty()
    shorter = windows[0].select(commands.F.date_add("first", 1).alias("first"), "last")
    assert len(commands.incompatible(windows[0], shorter, shorter).collect()) == 2
    entities = spark.createDataFrame([(1, ["graph-rag"], None, None), (2, [], "A calendar.", None), (3, ["mcp", "ai-agents"], None, None)], "id long, topics array<string>, description string, readme string")
    analysis = commands.analyze(entities)
    active = spark.createDataFrame([(1, "graph/rag", 202, 900, 9, 5), (3, "agents/mcp", 56, 20, 1, None)], "id long, full_name string, watches long, stars long, forks long, commits long")
    known = spark.createDataFrame([(None, "graph/rag", "cooling", True), (3, "x/y", "active", False)], "id long, name string, status string, fast_ever boolean")
    city = commands.build_city(active, analysis, known)
    got = {r.id: (r.community, r.district, r.global_rank, r.community_rank, r.flags) for r in city["entities"].collect()}
    assert got == {1: ("graph-rag", "knowledge-data", 1, 1, ["breakout", "cooling"]), 3: ("ai-agents", "agents", 2, 1, [])}
    assert city["buildings"].count() == 2
    assert validation.city_violations(city["entities"], city["communities"], list(commands.Lexicon().shown)).count() == 0
    assert validation.city_violations(city["entities"], city["communities"], ["agents"]).first().problem == "unknown district"


def test_a_renamed_entity_is_followed_by_its_id(spark):
    """Week one under an old name without metadata, week two under the new one, whose metadata know both."""
    day = lambda k: f"2026-07-{27 + k}" if k < 5 else f"2026-08-{k - 4:02d}"
    current = "struct<id:long,full_name:string>"
    schema = f"key string, full_name string, first_seen_at string, last_seen_at string, n long, metadata_selected boolean, current {current}"
    series = []
    for name, known in (("old/name", None), ("new/name", (7, "new/name"))):
        k = 7 * len(series)
        active = spark.createDataFrame([(name, name, day(k) + "T00:00:00Z", day(k + 6) + "T00:00:00Z", 21, bool(known), known), ("Both/X".lower(), "Both/X", day(k) + "T00:00:00Z", day(k) + "T01:00:00Z", 3, False, None)], schema)
        if not known:
            active = active.drop("metadata_selected", "current")
            active = active.unionByName(active.filter("key = 'old/name'").withColumns({"key": commands.F.lit("new/name"), "full_name": commands.F.lit("New/name")}))
        daily = active.select("key", commands.F.explode(commands.F.array(*(commands.F.lit(day(k + d)).cast("date") for d in range(7)))).alias("date"), commands.F.lit(1).cast("long").alias("n"))
        days = spark.createDataFrame([(day(k + d),) for d in range(7)], "date string").selectExpr("to_date(date) date", "24L hours_collected", "10L events", "true complete")
        series.append({"activity": active, "daily": daily, "days": days})
    found = commands.follow(spark, series)
    states = {r.key: (r.id, r.full_name, r.aliases, r.availability) for r in found["states"].collect()}
    assert states == {
        "id:7": (7, "new/name", ["New/name", "new/name"], "available"),
        "name:old/name": (None, "old/name", ["old/name"], "unknown"),
        "name:both/x": (None, "Both/X", ["Both/X"], "unknown"),
    }
    weeks = {(r.key, str(r.week)): r.n for r in found["weeks"].collect()}
    assert weeks["id:7", "2026-07-27"] == 7 and weeks["id:7", "2026-08-03"] == 7 and weeks["name:both/x", "2026-08-03"] == 7


def test_replacing_a_relation_fails_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_relation(spark.range(3), path, "1")
    try:
        tables.replace_relation(spark.range(9).selectExpr("raise_error('lost') id"), path, "1")
        raise AssertionError
    except Exception as error:
        assert "lost" in str(error)
    assert tables.read_relation(spark, path, "1").count() == 3
    tables.replace_relation(spark.range(9), path, "1")
    assert tables.read_relation(spark, path, "1").count() == 9


def test_buildings_never_overlap(spark):
    from tidemark.operators import layout

    rows = [(i, f"d{i % 8}", f"c{i % 3}", i * 37 % 5000, i * 9999, i * 777) for i in range(100)]
    members = spark.createDataFrame(rows, "id long, district string, community string, watches long, stars long, forks long")
    counts = spark.createDataFrame([(f"d{k}", k, sum(r[1] == f"d{k}" for r in rows)) for k in range(8)], "district string, place long, n long")
    districts = layout.place_districts(counts)
    once = {r.id: r for r in layout.place_buildings(members, districts).collect()}
    again = {r.id: r for r in layout.place_buildings(members.orderBy("watches"), districts).collect()}
    assert once == again
    placed, home = list(once.values()), {r.district: r for r in districts.collect()}
    for r in placed:
        d = home[f"d{r.id % 8}"]
        assert abs(r.x - d.x) + r.width / 2 <= d.width / 2 and abs(r.z - d.z) + r.depth / 2 <= d.depth / 2
    for k, a in enumerate(placed):
        assert all(abs(a.x - b.x) >= (a.width + b.width) / 2 or abs(a.z - b.z) >= (a.depth + b.depth) / 2 for b in placed[k + 1 :])


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_relation(spark.range(3), path, "1")
    tables.write_relation(spark.range(9), path, "1", "ignore")
    assert tables.read_relation(spark, path, "1").count() == 3
    tables.replace_relation(spark.range(5), path, "2")
    assert tables.read_relation(spark, path, "2").count() == 5
    try:
        tables.read_relation(spark, path, "1").count()
        raise AssertionError
    except Exception as error:
        assert "expected version 1" in str(error)
    (tmp_path / "doc.json").write_text(json.dumps({"schema_version": "city-v1", "n": 3}))
    assert tables.read_documents(spark, str(tmp_path / "doc.json"), "schema_version string, n long, extra string", "city-v1").first().n == 3
    assert tables.run_path("/a", "2026-07-27T00:00:00Z", "b") == "/a/2026-07-27T00-00-00Z_b"
    main(["init", str(tmp_path / "c.json")])
    (tmp_path / "c.json").write_text("mine")
    main(["init", str(tmp_path / "c.json")])
    assert (tmp_path / "c.json").read_text() == "mine"


def test_stream(spark, tmp_path):
    from tidemark.sources.archive import read_archive

    (tmp_path / "in").mkdir()
    archive(tmp_path / "in", 2)
    records = read_archive(spark, str(tmp_path / "in"))
    records.unionByName(records).write.parquet(str(tmp_path / "records"))
    stream = spark.readStream.schema(records.schema).parquet(str(tmp_path / "records"))
    query = streaming.daily_counts(stream).writeStream.outputMode("complete").format("memory").queryName("days").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.key, r.date.day): r.n for r in spark.table("days").collect()}
    assert got == {("graph/rag", 27): 29, ("graph/rag", 28): 29, ("small/tool", 27): 1, ("small/tool", 28): 1, ("agents/mcp", 27): 8, ("agents/mcp", 28): 8}


def test_coverage_and_summaries_from_archive_to_city(spark, tmp_path, capsys):
    """Each kind of fault makes exactly its level incomplete; every command tells it in its summary."""
    from tidemark.operators import decisions

    src, out, start = tmp_path / "in", tmp_path / "out", "2026-07-27T00:00:00Z"
    src.mkdir()
    archive(src)

    def told(*args):
        capsys.readouterr()
        main([*args])
        return json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    complete = lambda summary: {level: c["complete"] for level, c in summary["coverage"].items()}
    whole = told("backfill", str(src), "--from", start, "--out", str(out / "whole"))
    assert complete(whole) == {"archive": True, "all": True} and [d["files"] for d in whole["days"]] == [24] * 7
    counters = {str(r.date): r.unique_watch_events for r in tables.read_relation(spark, str(out / "whole/integrity"), "1").filter("date is not null").collect()}
    assert {d["date"]: d["watch"] for d in whole["days"]} == counters
    (src / "2026-07-28-5.json.gz").unlink()
    (src / "2026-07-29-0.json.gz").write_bytes(gzip.compress(b"{oops"))
    part = told("backfill", str(src), "--from", start, "--out", str(out / "part"))
    assert part["coverage"] == {"archive": {"errors": 2, "complete": False}, "all": {"errors": 2, "complete": False}}
    assert [(d["date"], d["files"], d["parse_error"]) for d in part["days"]][1:3] == [("2026-07-28", 23, 0), ("2026-07-29", 24, 1)]
    metadata = spark.createDataFrame([(5, "graph/rag")], "id long, full_name string")
    metadata.write.parquet(str(tmp_path / "metadata"))
    rich = told("enrich", str(out / "whole"), "--metadata", str(tmp_path / "metadata"), "--out", str(out / "rich"))
    assert complete(rich) == {"archive": True, "metadata": False, "all": False} and rich["coverage"]["metadata"]["errors"] == 1
    found = told("discover", str(src), "--from", start, "--top", "2", "--metadata", str(tmp_path / "metadata"), "--out", str(out / "found"))
    assert complete(found) == {"archive": True, "metadata": False, "all": False} and found["rows"]["candidates"] == 2
    life = told("lifecycle", str(out / "rich"), "--out", str(out / "life"))
    assert complete(life) == {"archive": True, "metadata": False, "all": False} and sum(life["status"].values()) == 3
    entities = spark.createDataFrame([(5, ["graph-rag"], None, None)], "id long, topics array<string>, description string, readme string")
    entities.write.parquet(str(tmp_path / "entities"))
    analysis = told("analyze", str(tmp_path / "entities"), "--series", str(out / "rich"), "--out", str(out / "analysis"))
    assert analysis["decision"] == {"ai-related": 1}
    active = spark.createDataFrame([(5, "graph/rag", 202, 900, 9, 5)], "id long, full_name string, watches long, stars long, forks long, commits long")
    active.write.parquet(str(tmp_path / "active"))
    city = ("build-city", str(tmp_path / "active"), "--series", str(out / "rich"), "--states", str(out / "life"))
    built = told(*city, "--analysis", str(out / "analysis"), "--out", str(out / "city"))
    assert complete(built) == {"archive": True, "metadata": False, "all": False} and built["rows"]["entities"] == 1
    run = commands.analyze(entities, model=decisions.Model(lambda batch: [], "p", "m", retries=0))
    assert {r.level or "all": r.complete for r in run["coverage"].collect()} == {"model": False, "all": False} and run["run"].first().adds_up
    lone = tables.read_relation(spark, str(out / "analysis/window"), "1").withColumn("source", commands.F.lit("candidates"))
    series = tables.read_relation(spark, str(out / "life/window"), "1")
    assert [r.problem for r in commands.incompatible(series, lone, series).collect()] == ["the analysis isn't of an activity series"]
