"""Model decisions: normalized input, content keys, cache split, batches, strict responses."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from ..functions.canonical import json_of
from ..functions.text import compatible, redacted
from .ranking import dense_places

# The decisions, and bounds of the options.
DECISIONS = ("ai-related", "review", "not-ai")
MAX_BATCH, MAX_RETRIES, MAX_BUDGET, EVIDENCE = 100, 2, 10_000, 500


def model_input(entities: DataFrame) -> DataFrame:
    """id, description (null if blank) and topics (normalized, distinct, sorted)."""
    description = compatible(F.col("description"))
    topics = F.transform(F.coalesce("topics", F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)))
    return entities.select("id", F.when(description != "", description).alias("description"), F.array_sort(F.array_distinct(F.filter(topics, lambda t: t != ""))).alias("topics"))


# What names the hashed objects.
METADATA_SCHEMA, KEY_SCHEMA = "ai-relevance-metadata-v1", "ai-relevance-cache-key-v1"


def _hashed(kinds: dict[str, DataType], *values: Column) -> Column:
    """sha256:<hex> of the JSON object with these keys, in this order."""
    kind = StructType([StructField(name, t) for name, t in kinds.items()])
    return F.concat(F.lit("sha256:"), F.sha2(json_of(F.struct(*(v.alias(n) for n, v in zip(kinds, values, strict=True))), kind, by_name=False), 256))


def _key(*values: Column) -> Column:
    names = ("schema", "repository_id", "metadata_hash", "provider", "model", "prompt_version", "methodology_version")
    return _hashed(dict.fromkeys(names, StringType()), F.lit(KEY_SCHEMA), values[0].cast("string"), *values[1:])


def cache_keys(inputs: DataFrame, provider: str, model: str, prompt_version: str, method_version: str) -> DataFrame:
    """``inputs`` with metadata_hash and key, which change with the text and with everything that decides."""
    kinds = {"schema": StringType(), "description": StringType(), "topics": ArrayType(StringType())}
    hashed = inputs.withColumn("metadata_hash", _hashed(kinds, F.lit(METADATA_SCHEMA), F.col("description"), F.col("topics")))
    return hashed.withColumn("key", _key(F.col("id"), F.col("metadata_hash"), F.lit(provider), F.lit(model), F.lit(prompt_version), F.lit(method_version)))


def cache_split(inputs: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their cached decision, misses)."""
    known = cache.select("key", "decision", "evidence")
    return inputs.join(known, "key"), inputs.join(known.select("key"), "key", "left_anti")


def corrupt_entries(cache: DataFrame) -> DataFrame:
    """Cache entries whose key doesn't follow from their fields, or with an unknown decision: must be empty."""
    again = _key(*(F.col(c) for c in ("id", "metadata_hash", "provider", "model", "prompt_version", "method_version")))
    return cache.filter(~F.col("key").eqNullSafe(again) | ~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)))


def batches(misses: DataFrame, size: int) -> DataFrame:
    """``misses`` with ``batch``: consecutive ids, ``size`` to a batch."""
    if not 1 <= size <= MAX_BATCH:
        raise ValueError(f"a batch has 1 to {MAX_BATCH} entries")
    return dense_places(misses, [F.col("id")], "_place").withColumn("batch", F.floor((F.col("_place") - 1) / size)).drop("_place")


def strict_responses(requested: DataFrame, responses: DataFrame) -> DataFrame:
    """id, batch, decision, problem from requested (id, batch) and responses (batch, id, decision, evidence).

    An unknown id spoils its whole batch; an id answered twice, not at all, or without a known decision
    is invalid.
    """
    known = requested.select("id", "batch")
    strangers = responses.join(known, ["id", "batch"], "left_anti").select("batch").distinct().withColumn("spoiled", F.lit(True))
    answers = responses.groupBy("id", "batch").agg(F.count(F.lit(1)).alias("times"), F.min("decision").alias("answer"))
    joined = known.join(answers, ["id", "batch"], "left").join(strangers, "batch", "left")
    problem = (
        F.when(F.col("spoiled"), "unknown-id")
        .when(F.col("times").isNull(), "missing")
        .when(F.col("times") > 1, "duplicate")
        .when(~F.coalesce(F.col("answer").isin(*DECISIONS), F.lit(False)), "invalid-decision")
    )
    return joined.select("id", "batch", F.when(problem.isNull(), F.col("answer")).alias("decision"), problem.alias("problem"))


_ENTRY = "array<struct<id:long,description:string,topics:array<string>>>"
_NONE = {"id": "long", "decision": "string", "evidence": "string", "failure": "string", "attempts": "int"}


def outcomes(
    misses: DataFrame,
    invoke: Callable[[list[dict]], list[dict]],
    size: int = 20,
    retries: int = 1,
    budget: int = MAX_BUDGET,
    secrets: list[str] = (),
    ledger: str | None = None,
    identity: tuple[str, ...] = (),
    save: Callable[[DataFrame], None] | None = None,
) -> tuple[DataFrame, int]:
    """id, decision, evidence, failure, attempts: what came of every row of ``misses``; and the number of requests.

    ``invoke`` answers a batch; it runs in the tasks, once for each batch, which is one row whatever the size
    of Arrow's frames. A failure is told by a code and not raised: the request failed, the response was
    invalid (for this entry, or as a whole), or the budget was used up. Entries without a decision are asked again within
    their batch, up to ``retries`` times. Rounds are sequential, since the budget counts the requests of all
    batches; batches of a round run in parallel, those with small ids first in the budget.

    With ``ledger``, a folder, no request that has an answer there is sent again, by a task that
    runs twice or by a later run with the same ``identity``. ``save`` gets each round's decisions as they come.
    """
    if not 0 <= retries <= MAX_RETRIES or not 0 <= budget <= MAX_BUDGET:
        raise ValueError("retries or budget out of bounds")
    from ..scratch import saved
    from ..sources import ledger as requests

    columns = ["description", "topics"]
    given = misses.select("id", *(F.col(c) if c in misses.columns else F.lit(None).cast("string" if c == "description" else "array<string>").alias(c) for c in columns))
    open_ = saved(batches(given, size).withColumns({"failure": F.lit(None).cast("string"), "attempts": F.lit(0)}), "requests")

    def run(frames):
        import pandas as pd

        book = requests.Ledger(ledger) if ledger else None
        for frame in frames:
            rows = []
            for batch, entries, attempt in zip(frame["batch"], frame["entries"], frame["attempt"], strict=True):
                content = [{"id": int(e["id"]), "description": e["description"], "topics": None if e["topics"] is None else [*e["topics"]]} for e in entries]
                key = requests.request_key([*identity, content, int(attempt)])
                send = lambda content=content: invoke(content)
                found = book.ask(key, content, send) if book else requests.asked(send)
                rows.append({"batch": batch, "code": found.get("failure"), "answers": found.get("answers", [])})
            yield pd.DataFrame(rows, columns=["batch", "code", "answers"])

    done, spent = None, 0
    for attempt in range(retries + 1):
        grouped = open_.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("id", *columns))).cast(_ENTRY).alias("entries"), F.lit(attempt).alias("attempt"))  # size at most
        asked = saved(grouped.orderBy("batch").limit(budget - spent), f"asked{attempt}")  # before any of them is sent
        n = asked.count()
        if not n:
            break
        spent += n
        tasks = min(n, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        told = asked.repartition(tasks).mapInPandas(run, "batch long, code string, answers array<struct<id:long,decision:string,evidence:string>>")
        answered = saved(told, f"answered{attempt}")
        normal = compatible(F.col("a.evidence"))
        fits = (normal != "") & (F.length(normal) <= EVIDENCE)
        responses = answered.select("batch", F.explode("answers").alias("a")).select("batch", "a.id", F.when(fits, F.col("a.decision")).alias("decision"), "a.evidence")
        responses = saved(responses, f"responses{attempt}")
        sent = open_.join(asked.select("batch"), "batch")
        checked = strict_responses(sent, responses).join(answered.select("batch", "code"), "batch")
        texts = responses.groupBy("id", "batch").agg(F.min("evidence").alias("evidence"))
        judged = checked.join(texts, ["id", "batch"], "left").select(
            "id", "batch", "decision", F.when(F.col("decision").isNotNull(), evidence(F.col("evidence"), secrets)).alias("evidence"), F.coalesce("code", F.lit(requests.INVALID)).alias("code")
        )
        good = saved(judged.filter("decision is not null").select("id", "decision", "evidence", F.lit(None).cast("string").alias("failure"), F.lit(attempt + 1).alias("attempts")), f"good{attempt}")
        if save and not good.isEmpty():
            save(good)
        done = good if done is None else done.unionByName(good)
        bad = judged.filter("decision is null").select("id", F.col("code").alias("code_"))
        left = open_.join(good.select("id"), "id", "left_anti").join(bad, "id", "left")
        open_ = saved(
            left.select("id", *columns, "batch", F.coalesce("code_", "failure").alias("failure"), (F.col("attempts") + F.col("code_").isNotNull().cast("int")).alias("attempts")), f"open{attempt}"
        )
    # asked as often as allowed: the last failure; else the budget ended it
    ended = F.when(F.col("attempts") > retries, F.col("failure")).otherwise(requests.EXHAUSTED)
    rest = open_.select("id", *(F.lit(None).cast("string").alias(c) for c in ("decision", "evidence")), ended.alias("failure"), F.col("attempts").cast("int").alias("attempts"))
    return (rest if done is None else done.unionByName(rest)).select(*(F.col(c).cast(t).alias(c) for c, t in _NONE.items())), spent


def classify(misses: DataFrame, invoke: Callable[[list[dict]], list[dict]], size: int = 20, retries: int = 1, budget: int = MAX_BUDGET, secrets: list[str] = ()) -> tuple[DataFrame, int]:
    """The decisions among ``outcomes``, and how many requests it took."""
    found, spent = outcomes(misses, invoke, size, retries, budget, secrets)
    return found.filter("decision is not null").select("id", "decision", "evidence"), spent


def evidence(value: Column, secrets: list[str] = ()) -> Column:
    """What a model says for its decision: secrets redacted, normalized, cut, trimmed."""
    return F.trim(F.substring(compatible(redacted(value, secrets)), 1, EVIDENCE))


class Model(NamedTuple):
    """A model: ``invoke`` answers a batch (a list of id, description, topics) with a list of id, decision, evidence."""

    invoke: Callable[[list[dict]], list[dict]]
    provider: str
    name: str
    prompt_version: str = "1"
    method_version: str = "1"
    size: int = 20
    retries: int = 1
    budget: int = MAX_BUDGET
    secrets: tuple[str, ...] = ()
    ledger: str | None = None


class Run(NamedTuple):
    """What a model's run gave: outcomes (id, decision, evidence, failure, attempts, origin), new cache entries, statistics (one row)."""

    outcomes: DataFrame
    fresh: DataFrame
    statistics: DataFrame


def model_run(entities: DataFrame, model: Model, cache: DataFrame | str | None = None) -> Run:
    """The outcome of every entity, from the cache or the model; each id is asked for once.

    ``cache``: a table of entries, or the folder of a ``store``, which then gets new entries as answers come,
    round by round, so that a run that breaks off has paid for them once. Corrupt entries are an error.
    """
    from ..scratch import saved
    from ..sources import store

    spark, folder = entities.sparkSession, cache if isinstance(cache, str) else None
    versions = (model.provider, model.name, model.prompt_version, model.method_version)
    named = dict(zip(("provider", "model", "prompt_version", "method_version"), map(F.lit, versions), strict=True))
    inputs = saved(cache_keys(model_input(entities), *versions).dropDuplicates(["id"]), "inputs")
    entries = store.read(spark, folder, corrupt_entries) if folder else cache
    if entries is None:
        hits, misses = inputs.limit(0).select("id", F.lit(None).cast("string").alias("decision"), F.lit(None).cast("string").alias("evidence")), inputs
    else:
        if not folder and not corrupt_entries(entries).isEmpty():
            raise ValueError("the cache has entries that don't follow from their fields")
        hits, misses = cache_split(inputs, entries)
        hits = hits.select("id", "decision", evidence(F.col("evidence"), list(model.secrets)).alias("evidence"))

    def as_entries(decided: DataFrame) -> DataFrame:
        return inputs.select("id", "metadata_hash", "key").join(decided.select("id", "decision", "evidence"), "id").withColumns(named)

    save = (lambda good: store.merged(as_entries(good), folder, ["key"])) if folder else None
    found, spent = outcomes(misses.select("id", "description", "topics"), model.invoke, model.size, model.retries, model.budget, list(model.secrets), model.ledger, versions, save)
    found = saved(found.withColumn("origin", F.when(F.col("decision").isNotNull(), "provider")), "outcomes")
    every = hits.select("*", F.lit(None).cast("string").alias("failure"), F.lit(0).alias("attempts"), F.lit("cache").alias("origin")).unionByName(found)
    return Run(every, as_entries(found.filter("decision is not null")), run_statistics(every, spent, model.budget))


def run_statistics(found: DataFrame, requests: int, budget: int) -> DataFrame:
    """One row: candidates, cache_hits, provider_decisions, each decision and each failure, requests, budget, and whether they add up."""
    from ..sources.ledger import EXHAUSTED, FAILED, INVALID

    count = lambda condition: F.count_if(F.coalesce(condition, F.lit(False)))
    kinds = {"request_failed": FAILED, "response_invalid": INVALID, "budget_exhausted": EXHAUSTED}
    row = found.agg(
        F.count(F.lit(1)).alias("candidates"),
        count(F.col("origin") == "cache").alias("cache_hits"),
        count(F.col("origin") == "provider").alias("provider_decisions"),
        *(count(F.col("decision") == d).alias(d.replace("-", "_")) for d in DECISIONS),
        *(count(F.col("failure") == code).alias(name) for name, code in kinds.items()),
        F.count_distinct("id").alias("ids_"),
    )
    failures = sum((F.col(k) for k in kinds), F.lit(0))
    decided_ = sum((F.col(d.replace("-", "_")) for d in DECISIONS), F.lit(0))
    adds_up = (F.col("candidates") == F.col("cache_hits") + F.col("provider_decisions") + failures) & (decided_ == F.col("cache_hits") + F.col("provider_decisions")) & (F.col("candidates") == F.col("ids_"))
    within = F.col("requests") <= F.col("budget")
    return row.withColumns({"requests": F.lit(requests), "budget": F.lit(budget)}).withColumn("adds_up", adds_up & within).drop("ids_")


def model_errors(found: DataFrame) -> DataFrame:
    """source, target, message: one row for each entity without a decision, as in ``events.coverage_errors``."""
    return found.filter("decision is null").select(F.lit("model").alias("source"), F.concat(F.lit("repository:"), F.col("id")).alias("target"), F.col("failure").alias("message"))


def decided(entities: DataFrame, model: Model, cache: DataFrame | str | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, decision, evidence) of the entities that the cache or the model decides, and the cache's new entries."""
    run = model_run(entities, model, cache)
    return run.outcomes.filter("decision is not null").select("id", "decision", "evidence"), run.fresh


def one_outcome(candidates: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``candidates`` with their id's outcome; an id that is listed twice is asked once."""
    single = outcomes.groupBy("id").agg(F.min_by("decision", "decision").alias("decision"))
    return candidates.join(single, "id", "left")


def readme_needed(assessed: DataFrame, model: bool) -> DataFrame:
    """Entities whose README is read: with metadata under rules; under a model, answered and not ruled out."""
    keep = (F.col("decision").isNotNull() & (F.col("decision") != "not-ai")) if model else F.col("has_metadata")
    return assessed.filter(keep)
