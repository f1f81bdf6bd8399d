"""The city: identity joins, eligibility, ranks, communities, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keywords import label
from ..functions.lexicon import Lexicon
from .ranking import dense_places


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Non-null keys that occur more than once: must be empty before a join on them."""
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    for key in keys:
        found = found.filter(F.col(key).isNotNull())
    return found


def by_id_or_name(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` (id, name) with ``right`` (id, name): by id where there is one, only else by name.

    Two equi-joins on disjoint parts: an OR in one join would compare all pairs. Matches are in struct
    ``match``; rows without one keep null.
    """
    found = right.select(F.col("id").alias("id_"), F.lower("name").alias("name_"), F.struct("*").alias("match"))
    known = left.filter("id is not null").join(found.filter("id_ is not null").drop("name_"), F.col("id") == F.col("id_"), "left").drop("id_")
    unknown = left.filter("id is null").join(found.drop("id_"), F.lower("name") == F.col("name_"), "left").drop("name_")
    return known.unionByName(unknown)


def cascade(city: DataFrame, states: DataFrame) -> DataFrame:
    """``city`` (id, name, other_name) with the lifecycle state of its id, else of its name, else of its other name.

    Names only find states that have no id. The match is in struct ``state``.
    """
    rows = states.select("id", F.lower("name").alias("name_"), F.struct("*").alias("s"))
    ids = rows.filter("id is not null").select(F.col("id").alias("id_"), F.col("s").alias("by_id"))
    named = rows.filter("id is null")
    first, second = named.select("name_", F.col("s").alias("by_name")), named.select("name_", F.col("s").alias("by_other"))
    joined = city.join(ids, F.col("id") == F.col("id_"), "left").drop("id_")
    joined = joined.join(first, F.lower("name") == F.col("name_"), "left").drop("name_")
    joined = joined.join(second, F.lower("other_name") == F.col("name_"), "left").drop("name_")
    return joined.withColumn("state", F.coalesce("by_id", "by_name", "by_other")).drop("by_id", "by_name", "by_other")


def eligible(joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with metadata, and one row counting those without."""
    return joined.filter("match is not null"), joined.agg(F.count(F.lit(1)).alias("related"), F.count_if(F.col("match").isNull()).alias("excluded"))


def flags(breakout: Column, status: Column, district: Column, other: str = "frontier") -> Column:
    return F.array_compact(
        F.array(
            F.when(breakout, "breakout"),
            F.when(status == "cooling", "cooling"),
            F.when(status == "inactive", "inactive"),
            F.when(district == other, "frontier"),
        )
    )


def ordered_name(name: Column) -> Column:
    """Names in the order that people expect, case and punctuation last."""
    return F.collate(name, "UNICODE")


def global_ranks(rows: DataFrame, name: str = "global_rank") -> DataFrame:
    """By watch events, then stars, then name."""
    return dense_places(rows, [F.desc("watches"), F.desc("stars"), ordered_name(F.col("full_name"))], name)


def community_ranks(rows: DataFrame) -> DataFrame:
    """``community_rank`` by ``global_rank`` in each community.

    A community may hold most rows, so ranks come from one total order over (community, rank): the
    place there less the community's first place.
    """
    placed = dense_places(rows, [F.col("community"), F.col("global_rank")], "_place")
    first = placed.groupBy("community").agg(F.min("_place").alias("_first"))
    joined = placed.join(first.withColumnRenamed("community", "community_"), F.col("community").eqNullSafe(F.col("community_")))
    return joined.withColumn("community_rank", F.col("_place") - F.col("_first") + 1).drop("community_", "_place", "_first")


def communities(placed: DataFrame, related: DataFrame, lexicon: Lexicon) -> DataFrame:
    """community, label, district, status, entities from id, community, district and the related counts."""
    grouped = placed.groupBy("community").agg(F.min("district").alias("district"), F.count(F.lit(1)).alias("entities"))
    counts = related.select(F.col("keyword").alias("community"), F.col("entities").alias("shared"))
    status = F.when((F.col("community") != lexicon.other) & (F.coalesce("shared", F.lit(0)) >= lexicon.emerging), "emerging").otherwise("unknown")
    return grouped.join(counts, "community", "left").select("community", label(F.col("community"), lexicon).alias("label"), "district", status.alias("status"), "entities")


def shown_order(lexicon: Lexicon) -> list[Column]:
    """The order in which communities (district, entities, community) are shown."""
    place = F.array_position(F.array(*(F.lit(d) for d in lexicon.shown)), F.col("district"))
    return [place, F.desc("entities"), F.col("community")]


def detection_signals(daily: DataFrame) -> DataFrame:
    """key, total, peak day, active days."""
    return daily.groupBy("key").agg(F.sum("n").alias("total"), F.max("n").alias("max_daily"), F.count_if(F.col("n") > 0).alias("active_days"))


def selection_rule(method: str | None, least: int | None = None) -> str:
    if method is None:
        return "no selection rule was recorded"
    scope = {"any-day": "in one UTC day", "window-total": "across the full window"}[method]
    return f"at least {least} events {scope}"


def explanation(total: Column, peak: Column, active: Column, first: Column, last: Column, rule: str) -> Column:
    return F.format_string(f"Noticed after %d events from %s inclusive to %s exclusive, with a daily peak of %d across %d active days. Selection rule: {rule}.", total, first, last, peak, active)


def latest_week(weeks: DataFrame, before: Column) -> DataFrame:
    """key and its latest week that begins before ``before``."""
    return weeks.filter(F.col("week") < before).groupBy("key").agg(F.max_by(F.struct("*"), "week").alias("latest"))
