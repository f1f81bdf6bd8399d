"""The commands, each from tables to tables."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import keywords
from ..functions.lexicon import Lexicon
from ..functions.text import ordinal
from ..operators import activity, city, decisions, events, layout, lifecycle, topics
from ..operators.coverage import covered
from ..operators.ranking import dense_places
from ..scratch import saved
from ..sources import archive


PROGRESS = ("files", "watch", "duplicate", "invalid", "parse-error")


def inspect(spark: SparkSession, path: str, window: tuple) -> tuple[DataFrame, DataFrame]:
    """Deduplicated records of the archive in a window of hours, and progress: date, files read and records of each status, observed while they are written."""
    rows = events.deduplicated(events.validated(archive.read_archive(spark, path, window, mark_files=True)))
    first, last = window
    days = [str((first + timedelta(days=k)).date()) for k in range((last - timedelta(hours=1) - first).days + 1)]
    days = sorted({*days, str((last - timedelta(hours=1)).date())})
    status = lambda name: F.col("kind") == "file" if name == "files" else F.col("status") == name
    seen = Observation()
    written = saved(rows.observe(seen, *(F.count_if((F.to_date("hour") == F.lit(d).cast("date")) & status(n)).alias(f"{d} {n}") for d in days for n in PROGRESS)), "inspected")
    found = [(d, *(seen.get[f"{d} {n}"] for n in PROGRESS)) for d in days]
    return written, spark.createDataFrame(found, "date string, " + ", ".join(f"`{n}` long" for n in PROGRESS)).withColumnRenamed("parse-error", "parse_error")


def discover(spark: SparkSession, path: str, start: str, hours: int = 24, top: int = 10, metadata: DataFrame | None = None) -> dict[str, DataFrame]:
    """The most watched entities of up to a day: candidates, counters, errors."""
    window = archive.hour_window(start, hours)
    inspected, progress = inspect(spark, path, window)
    totals = activity.entity_totals(inspected.filter("status = 'watch'"))
    candidates, seen = activity.top_candidates(totals, top), activity.entity_counts(totals)
    errors = events.coverage_errors(inspected).unionByName(missing_hours(spark, inspected, window))
    coverage = covered("archive", errors)
    if metadata is not None:
        candidates, missing = activity.enriched(candidates, metadata)
        errors = errors.unionByName(missing)
        coverage = coverage.merged(covered("metadata", missing))
    return {"candidates": candidates, "seen": seen, "integrity": events.integrity(inspected), "errors": errors, "progress": progress, "coverage": coverage.summary()}


def missing_hours(spark: SparkSession, inspected: DataFrame, window: tuple) -> DataFrame:
    """source, target, message: hours of the window without a file."""
    first, last = window
    hours = [((first + timedelta(hours=k)).isoformat() + ".000Z",) for k in range(int((last - first) / timedelta(hours=1)))]
    read = inspected.filter("kind = 'file'").select(F.date_format("hour", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("target")).distinct()
    return spark.createDataFrame(hours, "target string").join(read, "target", "left_anti").select(F.lit("archive").alias("source"), "target", F.lit("the hour has no file").alias("message"))


def backfill(spark: SparkSession, path: str, start: str, days: int = 7, least_daily: int | None = 5, least_total: int | None = None) -> dict[str, DataFrame]:
    """Dense daily series of up to a week: activity, daily, days, errors. Selected: by a day's events, or by the window's."""
    window = archive.day_window(start, days)
    inspected, progress = inspect(spark, path, window)
    watches = inspected.filter("status = 'watch'")
    counts = activity.daily_counts(watches)
    calendar = activity.calendar(spark, start[:10], days)
    hours = inspected.groupBy(F.to_date("hour").alias("date"), "hour").agg(F.count_if(F.col("status") == "watch").alias("n"), F.count_if(F.col("status").isin("parse-error", "invalid")).alias("errors"))
    known = calendar.join(activity.day_coverage(hours), "date", "left").na.fill({"hours_collected": 0, "events": 0, "complete": False})
    complete = F.broadcast(known.agg(F.bool_and("complete").alias("complete")))  # one row
    totals = activity.entity_totals(watches)
    marked, selection = selected(totals, counts, least_daily, least_total)
    rows = marked.join(complete)
    series = rows.withColumn("velocity", activity.velocity(F.col("n"), F.lit(days), F.col("complete"))).drop("complete")
    errors = events.coverage_errors(inspected).unionByName(missing_hours(spark, inspected, window))
    return {
        "activity": series,
        "daily": activity.dense_daily(counts, calendar),
        "days": known,
        "integrity": events.integrity(inspected.withColumn("date", F.to_date("hour")), ["date"]),
        "errors": errors,
        "progress": progress,
        "coverage": covered("archive", errors).summary(),
        "selection": selection,
    }


def selected(rows: DataFrame, daily: DataFrame, least_daily: int | None = None, least_total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``selected``, by the window's events or else by a day's (5 unless given), and the rule (method, least): one row."""
    method, least = ("window-total", least_total) if least_total else ("any-day", least_daily or 5)
    rule = activity.window_total(daily, least) if least_total else activity.any_day(daily, least)
    marked = rows.join(rule.select("key", F.lit(True).alias("selected")), "key", "left").na.fill({"selected": False})
    return marked, rows.sparkSession.createDataFrame([(method, least)], "method string, least int")


def enrich(series: dict[str, DataFrame], metadata: DataFrame, least_daily: int | None = None, least_total: int | None = None) -> dict[str, DataFrame]:
    """A series with the metadata of its selected entities: all of its tables, so that it can be used like the raw one.

    A rule given here selects anew; a series that says nothing of a selection (a raw document) is selected by the usual one.
    """
    if least_daily or least_total or "selected" not in series["activity"].columns:
        marked, rule = selected(series["activity"].drop("selected"), series["daily"], least_daily, least_total)
        series = series | {"activity": marked, "selection": rule}
    rows, missing = activity.enriched(series["activity"].drop("metadata_selected", "current"), metadata)
    errors = activity.without_old_errors(series["errors"]).unionByName(missing)
    levels = {"metadata": covered("metadata", missing).summary().filter("level is not null")}
    if "coverage" in series:
        levels["archive"] = series["coverage"].filter("level = 'archive'")
    return series | {"activity": rows, "errors": errors, "metadata": activity.metadata_counts(rows), "coverage": with_total(*levels.values())}


def with_total(*levels: DataFrame) -> DataFrame:
    """Coverage rows (level, errors, complete) of several results, each level once, and their total (level null)."""
    rows = reduce(lambda a, b: a.unionByName(b), levels).filter("level is not null").groupBy("level").agg(F.max("errors").alias("errors"))
    return rows.groupingSets([["level"], []], "level").agg(F.sum("errors").alias("errors")).withColumn("complete", F.col("errors") == 0)


def observations(series: DataFrame, number: int) -> DataFrame:
    """A series' entities as input ``number`` of ``lifecycle.identified``, whether it is enriched or raw."""
    known = "current" in series.columns
    current = lambda field, kind: F.col(f"current.{field}").cast(kind) if known else F.lit(None).cast(kind)
    return series.select(
        F.lit(number).alias("input"),
        "key",
        F.col("full_name").alias("name"),
        current("id", "long").alias("id"),
        current("full_name", "string").alias("current_name"),
        (F.coalesce("metadata_selected", F.lit(False)) if known else F.lit(False)).alias("asked"),
        F.to_timestamp("first_seen_at").alias("first_at"),
        F.to_timestamp("last_seen_at").alias("last_at"),
        F.col("n").cast("long").alias("n"),
    )


def follow(spark: SparkSession, inputs: list[dict[str, DataFrame]], limits: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """The lifecycle over consecutive series (activity, daily, days), raw or enriched: states, weeks, events, summary, window, and coverage if all have it.

    Entities are followed by their id, under whatever names; only names that no input knows an id for are
    followed by name. ``states`` has id, full_name, aliases and availability of each.
    """
    tables = [
        (s["days"].withColumn("input", F.lit(k)), s["daily"].withColumn("input", F.lit(k)), observations(s["activity"], k)) for k, s in enumerate(inputs)
    ]
    days, daily, seen = (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each) for each in zip(*tables, strict=True))
    if not lifecycle.check_windows(days.select("input", "date")).isEmpty():
        raise ValueError("series must be consecutive days in ascending order")
    coverage = lifecycle.week_coverage(days.withColumn("records_complete", F.col("complete")))
    named = saved(lifecycle.identified(seen), "identified")
    observed = saved(lifecycle.identity_days(daily.filter("n > 0"), named), "observed")
    states = saved(lifecycle.folded(lifecycle.tracked_weeks(observed, coverage, limits)), "states")
    who = lifecycle.merged_identities(named).select(F.col("identity").alias("key"), "id", "full_name", "aliases", "availability", "first_at", "last_at")
    window = days.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    coverages = [s["coverage"] for s in inputs if "coverage" in s]
    extra = {"coverage": with_total(*coverages)} if len(coverages) == len(inputs) else {}
    return extra | {"states": lifecycle.final_states(states).join(who, "key"), "window": window, "weeks": lifecycle.lifecycle_weeks(states), "events": lifecycle.lifecycle_events(states), "summary": lifecycle.week_summary(observed, coverage, limits)}


def analyze(entities: DataFrame, lexicon: Lexicon = Lexicon(), model: decisions.Model | None = None, cache: DataFrame | str | None = None) -> dict[str, DataFrame]:
    """Keywords and relevance of entities (id, topics, description, readme): observations, assessed, census, communities.

    READMEs are read up to the lexicon's ``readme_limit``, an option of the command.
    Relevance follows from the keywords, or, with a ``model``, from its decisions: those in ``cache`` aren't
    asked for again, READMEs of entities that it rules out or leaves open aren't read, and ``cache`` in the
    result has what is new for the cache (a cache given as a folder has it already); ``run`` has the model's statistics,
    ``errors`` a row for each entity without a decision.
    """
    extra, entities = {}, topics.cut_readmes(entities, lexicon.readme_limit)
    if model is None:
        observed = saved(topics.observations(entities, lexicon), "observed")
        assessed = saved(topics.relevance(entities, observed, lexicon), "assessed")
    else:
        run = decisions.model_run(entities, model, cache)
        errors = decisions.model_errors(run.outcomes)
        extra = {"cache": run.fresh, "run": run.statistics, "errors": errors, "coverage": covered("model", errors).summary()}
        judged = entities.join(run.outcomes.select("id", "decision", "evidence"), "id", "left")
        wanted = F.when(F.coalesce(F.col("decision") != "not-ai", F.lit(False)), F.col("readme"))
        observed = saved(topics.observations(judged.select("id", "topics", "description", wanted.alias("readme")), lexicon), "observed")
        score = F.coalesce(F.round(ordinal(F.col("decision")) * 100), F.lit(0)).cast("long")
        assessed = saved(judged.select("id", score.alias("score"), F.coalesce("decision", F.lit("unavailable")).alias("decision"), "evidence"), "assessed")
    related = assessed.filter("decision = 'ai-related'").select("id")
    return extra | {
        "observations": observed,
        "assessed": assessed.join(topics.community_status(observed, assessed, lexicon), "id"),
        "census": topics.census(observed),
        "related": topics.related_counts(observed, related),
        "homes": topics.primary_communities(observed, related, lexicon),
    }


#: The source that a city's analysis must have.
SERIES = "activity-series"


def incompatible(activity_window: DataFrame, analysis_window: DataFrame, lifecycle_window: DataFrame) -> DataFrame:
    """problem: what keeps the documents of a city from going together (windows: first, last, of an analysis also source; one row each). No rows: nothing."""
    source = lambda w: (F.col("source") if "source" in w.columns else F.lit(None)).cast("string")
    a, n, c = (w.select(F.col("first").alias(f"{k}_first"), F.col("last").alias(f"{k}_last"), source(w).alias(f"{k}_source")) for w, k in ((activity_window, "a"), (analysis_window, "n"), (lifecycle_window, "c")))
    every = a.join(F.broadcast(n)).join(F.broadcast(c))  # one row each
    problems = F.array_compact(
        F.array(
            F.when(~F.col("a_first").eqNullSafe(F.col("n_first")) | ~F.col("a_last").eqNullSafe(F.col("n_last")), "the analysis has another window than the activity"),
            F.when(F.coalesce(F.col("n_source") != SERIES, F.lit(False)), "the analysis isn't of an activity series"),
            F.when(~F.coalesce((F.col("c_first") <= F.col("a_first")) & (F.col("c_last") >= F.col("a_last")), F.lit(False)), "the lifecycle doesn't cover the activity"),
        )
    )
    return every.select(F.explode(problems).alias("problem"))


def build_city(active: DataFrame, analysis: dict[str, DataFrame], states: DataFrame, lexicon: Lexicon = Lexicon()) -> dict[str, DataFrame]:
    """Entities, communities and districts with places, from activity with metadata, analysis and lifecycle.

    ``active``: id, full_name, watches, stars, forks, commits. ``states``: id, name, status, fast_ever.
    """
    if not city.duplicate_keys(active, "id").isEmpty():
        raise ValueError("an id is listed twice")
    homes = analysis["homes"].join(active, "id")
    placed = homes.withColumn("district", keywords.district(F.col("community"), lexicon))
    found = city.cascade(placed.withColumns({"name": F.col("full_name"), "other_name": F.col("full_name")}), states)
    flagged = found.withColumn("flags", city.flags(F.col("state.fast_ever"), F.col("state.status"), F.col("district"), lexicon.other)).drop("name", "other_name")
    entities = saved(city.community_ranks(city.global_ranks(flagged)), "city")
    communities = city.communities(entities.select("id", "community", "district"), analysis["related"], lexicon)
    counts = entities.groupBy("district").agg(F.count(F.lit(1)).alias("n"))
    order = F.array_position(F.array(*(F.lit(d) for d in lexicon.shown)), F.col("district"))
    districts = layout.place_districts(dense_places(counts, [order, F.col("district")], "place").withColumn("place", F.col("place") - 1))
    return {"entities": entities, "communities": communities, "districts": districts, "buildings": layout.place_buildings(entities, districts)}
