"""python -m tidemark COMMAND: the commands over archive files and Parquet tables."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.lexicon import Lexicon
from .operators import lifecycle, validation
from .plans import commands, exports
from .sources import archive, documents, store, tables

VERSION = "1"
# Fixed value: the bound of an option.
MAX_README = 100_000


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple[str, dict]) -> None:
        one = sub.add_parser(name)
        for flag, options in args:
            one.add_argument(flag, **options)

    out = ("--out", {"required": True, "help": "folder of the result tables"})
    document = ("--document", {"metavar": "FOLDER", "help": "write the result as a versioned JSON document as well, named by its window"})
    command("init", ("path", {"help": "configuration file; one that exists stays"}))
    command("discover", ("archive", {}), ("--from", {"required": True, "dest": "start"}), ("--hours", {"type": int, "default": 24}), ("--top", {"type": int, "default": 10}), ("--metadata", {}), out, document)
    command("backfill", ("archive", {}), ("--from", {"required": True, "dest": "start"}), ("--days", {"type": int, "default": 7}), ("--least-daily", {"type": int}), ("--least-total", {"type": int}), out, document)
    command("enrich", ("series", {"help": "folder of tables, or an activity-series document (.json)"}), ("--metadata", {"required": True}), ("--least-daily", {"type": int}), ("--least-total", {"type": int}), out, document)
    limit = lambda flag, value, what: (flag, {"type": int, "default": value, "help": f"least {what}"})
    command(
        "lifecycle",
        ("series", {"nargs": "+", "help": "raw or enriched, folders of tables or documents (.json), in ascending order"}),
        limit("--main-daily", lifecycle.MAIN_DAILY, "events of a day"),
        limit("--scout-weekly", lifecycle.SCOUT_WEEKLY, "events of a week that qualify"),
        limit("--breakout-weekly", lifecycle.BREAKOUT_WEEKLY, "events of a week that break out"),
        out,
        document,
    )
    command("analyze", ("entities", {"help": "table of id, topics, description, readme"}), ("--series", {"help": "the series that the entities come from"}), ("--readme-limit", {"type": int, "default": 12_000}), out)
    command("build-city", ("active", {}), ("--series", {"required": True}), ("--analysis", {"required": True}), ("--states", {"required": True}), out)
    return top


def write(found: dict, out: str, version: str | None = None, folder: str | None = None, shaped=None) -> None:
    """The result as tables; with a ``folder``, what ``shaped`` makes of the written tables as a document of ``version`` there."""
    for name, df in found.items():
        tables.write_relation(df, f"{out}/{name}", VERSION)
    spark = next(iter(found.values())).sparkSession
    summary = told(spark, out, [*found])
    if folder:
        document = shaped(read(spark, out, *found)).cache()
        documents.write(document, folder, version)
        summary["document"] = f"{folder}/{document.first().asDict()['name']}"
        document.unpersist()
    print(json.dumps(summary, default=str))


def with_coverage(spark: SparkSession, path: str, *names: str) -> dict:
    """The tables, and coverage and rule of selection if the result has them (those of older versions haven't)."""
    return read(spark, path, *names, *(n for n in ("coverage", "selection") if store.exists(spark, f"{path}/{n}")))


def series(spark: SparkSession, path: str, *names: str) -> dict:
    """Tables of a series: its folder's, or those of its document."""
    if not path.endswith(".json"):
        return with_coverage(spark, path, *names)
    found = exports.series_of(documents.read(spark, path, "activity-series-v1")["activity-series-v1"])
    return {n: df for n, df in found.items() if n in (*names, "coverage", "selection")}


def read(spark: SparkSession, path: str, *names: str) -> dict:
    return {n: tables.read_relation(spark, f"{path}/{n}", VERSION) for n in names}


def told(spark: SparkSession, out: str, names: list[str]) -> dict:
    """What a command's summary says: rows of each table, progress by day, levels of coverage, decisions, states."""
    found = read(spark, out, *names)
    summary: dict = {"out": out, "rows": {n: df.count() for n, df in found.items()}}
    if "progress" in found:
        summary["days"] = [r.asDict() for r in found["progress"].orderBy("date").collect()]  # 7 at most
    if "coverage" in found:
        levels = {r.level or "all": {"errors": r.errors, "complete": r.complete} for r in found["coverage"].collect()}  # a row a level
        summary["coverage"] = levels
    if "run" in found:
        summary["model"] = found["run"].first().asDict()
    for name, column in (("assessed", "decision"), ("states", "status")):
        if name in found:
            summary[column] = {str(r[0]): r[1] for r in found[name].groupBy(column).count().collect()}
    return summary


def window(spark: SparkSession, path: str):
    """First and last day of a series: one row."""
    return series(spark, path, "days")["days"].agg(F.min("date").alias("first"), F.max("date").alias("last"))


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    if a.command == "init":
        if not Path(a.path).exists():
            Path(a.path).write_text(json.dumps({"version": VERSION, "least_daily": 5, "days": 7}, indent=2) + "\n")
        return
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if a.command == "discover":
        found = commands.discover(spark, a.archive, a.start, a.hours, a.top, spark.read.parquet(a.metadata) if a.metadata else None)
        start = archive.hour_window(a.start, a.hours)[0]
        write(found, a.out, "candidate-v1", a.document, lambda tables: exports.candidate_document(tables, start, a.hours))
    elif a.command == "backfill":
        write(commands.backfill(spark, a.archive, a.start, a.days, a.least_daily, a.least_total), a.out, "activity-series-v1", a.document, exports.series_document)
    elif a.command == "enrich":
        found = commands.enrich(series(spark, a.series, "activity", "daily", "days", "integrity", "errors"), spark.read.parquet(a.metadata), a.least_daily, a.least_total)
        write(found, a.out, "activity-series-v1", a.document, exports.series_document)
    elif a.command == "lifecycle":
        limits = lifecycle.rules(a.main_daily, a.scout_weekly, a.breakout_weekly)
        inputs = [series(spark, path, "activity", "daily", "days") for path in a.series]
        named = [(Path(path).name, s) for path, s in zip(a.series, inputs, strict=True)]
        write(commands.follow(spark, inputs, limits), a.out, "repository-lifecycle-v1", a.document, lambda tables: exports.lifecycle_document(tables, named, limits))
    elif a.command == "analyze":
        if not 1 <= a.readme_limit <= MAX_README:
            raise ValueError(f"the README limit must be from 1 to {MAX_README}")
        found = commands.analyze(spark.read.parquet(a.entities), Lexicon(readme_limit=a.readme_limit))
        write(found | ({"window": window(spark, a.series).withColumn("source", F.lit(commands.SERIES))} if a.series else {}), a.out)
    else:
        windows = window(spark, a.series), *(read(spark, path, "window")["window"] for path in (a.analysis, a.states))
        if problems := [r.problem for r in commands.incompatible(*windows).collect()]:  # two at most
            raise ValueError("; ".join(problems))
        states = read(spark, a.states, "states")["states"].select("id", F.col("full_name").alias("name"), "status", "fast_ever")
        city = commands.build_city(spark.read.parquet(a.active), read(spark, a.analysis, "related", "homes"), states)
        if problems := [f"{r.problem}: {r.n}" for r in validation.city_violations(city["entities"], city["communities"], list(Lexicon().shown)).collect()]:  # a row a rule
            raise ValueError("; ".join(problems))
        levels = [f["coverage"] for f in (with_coverage(spark, path) for path in (a.series, a.analysis, a.states)) if f]
        write(city | ({"coverage": commands.with_total(*levels)} if levels else {}), a.out)


if __name__ == "__main__":
    main()
