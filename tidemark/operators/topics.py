"""Keyword observations of entities, relevance scores, census, emerging communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import small_batches
from ..functions.counted import counted_keywords, counted_words
from ..functions.keywords import SOURCES, is_signal
from ..functions.lexicon import Lexicon


def cut_readmes(entities: DataFrame, limit: int) -> DataFrame:
    """``entities`` with the first ``limit`` characters of their READMEs, for callers that are asked for such a limit: nothing below cuts."""
    return entities.withColumn("readme", F.substring("readme", 1, limit))


def _given(entities: DataFrame, _: Lexicon | None = None) -> DataFrame:
    return small_batches(entities).select("id", F.col("topics").cast("array<string>").alias("topics"), "description", "readme")


def _found(given: DataFrame, lexicon: Lexicon, signals: bool = False) -> DataFrame:
    found = given.mapInArrow(counted_keywords(lexicon, signals), f"id {given.schema['id'].dataType.simpleString()}, source string, keyword string, occurrences long, first boolean")
    confidence = F.create_map(*(F.lit(x) for s, (c, _, _) in lexicon.sources.items() for x in (s, c)))
    return found.withColumn("confidence", confidence[F.col("source")])


def marked_observations(entities: DataFrame, lexicon: Lexicon, ordered: bool = False) -> DataFrame:
    """Observations with ``first``: true in one of the rows of each id and keyword, so that entities are counted without sets.

    Entities are dealt by id, and what is found in those of one id is added up where it is found: texts are a few rows,
    their keywords many. ``ordered``: dealt by ranges of ids, so that all rows come by id, source and keyword.
    """
    given = _given(entities)
    dealt = given.repartitionByRange("id") if ordered else given.repartition("id")
    return _found(dealt.sortWithinPartitions("id"), lexicon)


def observations(entities: DataFrame, lexicon: Lexicon) -> DataFrame:
    """id, source, keyword, occurrences, confidence from id, topics, description, readme (whole texts); ids that are there twice add up."""
    return marked_observations(entities, lexicon).drop("first")


def signal_observations(entities: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The observations of signals: others don't leave the tasks, and no text is dealt."""
    found = _found(_given(entities), lexicon, signals=True)
    return found.repartition("id").groupBy("id", "source", "keyword", "confidence").agg(F.sum("occurrences").alias("occurrences"))


def words(entities: DataFrame, lexicon: Lexicon) -> DataFrame:
    """word, n: every token of the descriptions and READMEs, keyword or not."""
    given = small_batches(entities).select("description", "readme")
    return given.mapInArrow(counted_words(lexicon), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def relevance(entities: DataFrame, observed: DataFrame, lexicon: Lexicon) -> DataFrame:
    """id, score in hundredths, decision, evidence (at most two keywords a source); one row for each entity."""
    first = Window.partitionBy("id", "source").orderBy("keyword")
    signals = observed.filter(is_signal(F.col("keyword"), lexicon)).withColumn("k", F.row_number().over(first)).filter("k <= 2")
    once = F.create_map(*(F.lit(x) for s, (_, a, _) in lexicon.sources.items() for x in (s, a)))
    more = F.create_map(*(F.lit(x) for s, (_, a, b) in lexicon.sources.items() for x in (s, b - a)))
    worth = F.when(F.col("k") == 1, once[F.col("source")]).otherwise(more[F.col("source")])
    scored = signals.withColumn("worth", worth).groupBy("id").agg(
        F.least(F.lit(100), F.sum("worth")).cast("long").alias("score"), F.sort_array(F.collect_list(F.struct("source", "keyword", "worth"))).alias("evidence")
    )
    score = F.coalesce("score", F.lit(0))
    decision = F.when(score >= lexicon.related, "ai-related").when(score >= lexicon.review, "review").otherwise("not-ai")
    return entities.select("id").join(scored, "id", "left").select("id", score.alias("score"), decision.alias("decision"), "evidence")


def census(observed: DataFrame) -> DataFrame:
    """keyword, entities, occurrences, sources, over all entities.

    A flag for each source is what hash aggregation can hold; sets would sort all observations. Marked observations are
    summed up where they are found.
    """
    flags = [F.when(F.bool_or(F.col("source") == s), s) for s in sorted(SOURCES)]
    entities = F.count_if("first") if "first" in observed.columns else F.countDistinct("id")
    return observed.groupBy("keyword").agg(
        entities.alias("entities"), F.sum("occurrences").alias("occurrences"), F.array_compact(F.array(*flags)).alias("sources")
    )


def related_counts(observed: DataFrame, related: DataFrame) -> DataFrame:
    """keyword, entities: over the related entities (column id) only."""
    return observed.join(related.select("id"), "id", "left_semi").groupBy("keyword").agg(F.countDistinct("id").alias("entities"))


def community_status(observed: DataFrame, assessed: DataFrame, lexicon: Lexicon) -> DataFrame:
    """id, status: emerging if one of its keywords, not a broad one, has enough related entities; null if not related."""
    related = assessed.filter("decision = 'ai-related'").select("id")
    narrow = observed.filter(~F.col("keyword").isin(*lexicon.broad))
    wide = related_counts(narrow, related).filter(F.col("entities") >= lexicon.emerging).select("keyword")
    emerging = narrow.join(wide, "keyword", "left_semi").select("id").distinct().withColumn("hit", F.lit(True))
    status = F.when(F.col("decision") == "ai-related", F.when(F.col("hit"), "emerging").otherwise("unknown"))
    return assessed.select("id", "decision").join(emerging, "id", "left").select("id", status.alias("status"))


def primary_communities(observed: DataFrame, related: DataFrame, lexicon: Lexicon) -> DataFrame:
    """id, community: the entity's keyword that most related entities have, then by confidence, occurrences, name."""
    counts = related_counts(observed, related).withColumnRenamed("entities", "shared")
    own = observed.join(related.select("id"), "id", "left_semi").filter(~F.col("keyword").isin(*lexicon.broad_communities))
    each = own.groupBy("id", "keyword").agg(F.max("confidence").alias("confidence"), F.sum("occurrences").alias("occurrences")).join(counts, "keyword")
    best = each.groupBy("id").agg(F.min_by("keyword", F.struct(-F.col("shared"), -F.col("confidence"), -F.col("occurrences"), F.col("keyword"))).alias("community"))
    return related.select("id").join(best, "id", "left").select("id", F.coalesce("community", F.lit(lexicon.other)).alias("community"))
