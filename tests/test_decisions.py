"""Decisions of a model: strict answers, retries, budgets, the cache."""

import pytest

from tidemark.operators import decisions
from tidemark.plans import commands

SCHEMA = "id long, topics array<string>, description string, readme string"


def entities(spark, n=4):
    return spark.createDataFrame([(i, ["x"], f"text {i}", "llm rag") for i in range(1, n + 1)], SCHEMA)


def answer(i, decision="ai-related", evidence="because"):
    return {"id": i, "decision": decision, "evidence": evidence}


def test_a_stranger_never_answers_for_another_batch(spark):
    """Batches (1, 2) and (3, 4); the second also answers 1: it is spoiled, and 1 keeps one decision."""
    def invoke(batch):
        ids = [r["id"] for r in batch]
        return [answer(i) for i in ids] + ([answer(1, "not-ai", "a stranger")] if 3 in ids else [])

    found, spent = decisions.classify(entities(spark).select("id", "description", "topics"), invoke, size=2, retries=0)
    assert sorted((r.id, r.decision, r.evidence) for r in found.collect()) == [(1, "ai-related", "because"), (2, "ai-related", "because")] and spent == 2


def test_retries_and_budget(spark):
    """Id 2 is never answered: it is asked again once, and a budget of one request stops everything after it."""
    invoke = lambda batch: [answer(r["id"]) for r in batch if r["id"] != 2]
    rows = entities(spark).select("id", "description", "topics")
    found, spent = decisions.classify(rows, invoke, size=2, retries=1)
    assert sorted(r.id for r in found.collect()) == [1, 3, 4] and spent == 3
    found, spent = decisions.classify(rows, invoke, size=2, retries=1, budget=1)
    assert sorted(r.id for r in found.collect()) == [1] and spent == 1
    found, spent = decisions.classify(rows, invoke, budget=0)
    assert found.count() == 0 and spent == 0
    for bad in ({"retries": 3}, {"budget": -1}, {"size": 0}, {"size": 101}):
        with pytest.raises(ValueError):
            decisions.classify(rows, invoke, **bad)[0].count()


def test_evidence(spark):
    rows = spark.createDataFrame([("  the  key s3cret, Authorization: Bearer abc.def\n \u2003 ﬁne ",), ("x" * 499 + " y",), (None,)], "e string")
    got = [r.e for r in rows.select(decisions.evidence(decisions.F.col("e"), ["s3cret"]).alias("e")).collect()]
    assert got == ["the key [REDACTED], Authorization: Bearer [REDACTED] fine", "x" * 499, None]


def test_model_path_of_the_analysis(spark):
    """The model decides; what it rules out keeps its README unread; a second run asks for nothing that the cache has."""
    kinds = {1: "ai-related", 2: "review", 3: "not-ai", 4: "no such decision"}
    model = decisions.Model(lambda batch: [answer(r["id"], kinds[r["id"]]) for r in batch], "p", "m", size=2)
    found = commands.analyze(entities(spark), model=model)
    got = {r.id: (r.decision, r.score) for r in found["assessed"].collect()}
    assert got == {1: ("ai-related", 100), 2: ("review", 50), 3: ("not-ai", 0), 4: ("unavailable", 0)}
    assert {r.id for r in found["observations"].filter("source = 'readme'").collect()} == {1, 2}
    assert {r.id for r in found["cache"].collect()} == {1, 2, 3} and decisions.corrupt_entries(found["cache"]).isEmpty()

    def refuse(batch):
        if {r["id"] for r in batch} != {4}:
            raise AssertionError("asked again")
        return [answer(4)]

    again = commands.analyze(entities(spark), model=model._replace(invoke=refuse), cache=found["cache"])
    assert {r.id: r.decision for r in again["assessed"].collect()} == {1: "ai-related", 2: "review", 3: "not-ai", 4: "ai-related"}


def counting(folder, behave):
    """A provider that leaves a file for each request, whatever process it runs in."""

    def invoke(batch):
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        name = "_".join(str(r["id"]) for r in batch)
        with open(f"{folder}/{len(batch)}-{name[:60]}-{uuid.uuid4().hex}", "w"):
            pass
        return behave(batch, len([f for f in os.listdir(folder) if f.startswith(f"{len(batch)}-{name[:60]}-")]))

    return invoke


def told(rows):
    return {r.id: (r.decision, r.failure, r.attempts) for r in rows.collect()}


@pytest.mark.parametrize("size", [1, 7, 20, 100])
def test_one_request_a_batch_whatever_the_frames(spark, tmp_path, size):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = spark.range(1, 231).selectExpr("id", "concat('t', id) description", "array('x') topics")
        found, spent = decisions.outcomes(rows, counting(tmp_path / "calls", lambda batch, _: [answer(r["id"]) for r in batch]), size=size)
        assert found.filter("decision = 'ai-related'").count() == 230
        assert len(list((tmp_path / "calls").iterdir())) == spent == -(-230 // size)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_failures_are_outcomes(spark, tmp_path):
    """Batches of two: one fails always, one fails once, one is malformed, one has a spoiled entry."""
    from tidemark.sources.ledger import ResponseError

    def behave(batch, times):
        first = batch[0]["id"]
        if first == 1:
            raise OSError("no connection")
        if first == 3 and times == 1:
            raise ResponseError("not JSON")
        if first == 5:
            return {"answers": "none"}
        if first == 7:
            return [answer(7), answer(8) | {"more": 1}, "noise", {"id": "8"}]
        if first == 8:  # asked again alone
            return [answer(8, evidence=" 　 ")]
        if first == 9:
            return [answer(9, evidence="y" * 501), answer(10, "perhaps")]
        return [answer(r["id"]) for r in batch]

    rows = entities(spark, 10).select("id", "description", "topics")
    found, spent = decisions.outcomes(rows, counting(tmp_path / "calls", behave), size=2, retries=1)
    failed, invalid = (None, "model-request-failed", 2), (None, "model-response-invalid", 2)
    good = lambda n: ("ai-related", None, n)
    assert told(found) == {1: failed, 2: failed, 3: good(2), 4: good(2), 5: invalid, 6: invalid, 7: good(1), 8: invalid, 9: invalid, 10: invalid}
    assert spent == len(list((tmp_path / "calls").iterdir())) == 10


def test_budget_of_one(spark, tmp_path):
    rows = entities(spark, 5).select("id", "description", "topics")
    found, spent = decisions.outcomes(rows, counting(tmp_path / "a", lambda batch, _: [answer(r["id"]) for r in batch[:1]]), size=2, retries=2, budget=1)
    out = (None, "model-budget-exhausted")
    assert told(found) == {1: ("ai-related", None, 1), 2: (*out, 1), 3: (*out, 0), 4: (*out, 0), 5: (*out, 0)}
    assert spent == len(list((tmp_path / "a").iterdir())) == 1
    found, spent = decisions.outcomes(rows, lambda batch: [], budget=0)
    assert set(told(found).values()) == {(*out, 0)} and spent == 0
    assert decisions.outcomes(rows.limit(0), lambda batch: [])[0].count() == 0


def test_the_ledger_asks_once(spark, tmp_path):
    rows, book = entities(spark, 6).select("id", "description", "topics"), str(tmp_path / "book")
    calls = tmp_path / "calls"
    invoke = counting(calls, lambda batch, _: [answer(r["id"]) for r in batch if r["id"] != 4])
    first, spent = decisions.outcomes(rows, invoke, size=2, retries=1, ledger=book, identity=("p", "m"))
    want = told(first)
    assert spent == len(list(calls.iterdir())) == 4 and want[4] == (None, "model-response-invalid", 2)
    again, _ = decisions.outcomes(rows, invoke, size=2, retries=1, ledger=book, identity=("p", "m"))
    assert told(again) == want and len(list(calls.iterdir())) == 4  # nothing is sent again
    decisions.outcomes(rows, invoke, size=2, retries=0, ledger=book, identity=("p", "other"))
    assert len(list(calls.iterdir())) == 7


def test_a_killed_task(tmp_path):
    """The process dies while its request is on the way: the request is spent, and the next attempt asks anew; answers that were kept aren't asked for."""
    import os
    import subprocess
    import sys

    code = f"""
import os
from tidemark.sources.ledger import Ledger
book = Ledger({str(tmp_path / "book")!r})
book.ask("a", ["x"], lambda: [{{"id": 1, "decision": "review", "evidence": "e"}}])
book.ask("b", ["y"], lambda: os._exit(7))
"""
    assert subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": "."}).returncode == 7
    from tidemark.sources.ledger import FAILED, Ledger

    def never():
        raise AssertionError("asked again")

    book = Ledger(str(tmp_path / "book"))
    assert book.ask("a", ["x"], never) == {"answers": [{"id": 1, "decision": "review", "evidence": "e"}]}
    assert book.ask("b", ["y"], never) == {"failure": FAILED} and book.answer("c") is None


def test_the_cache_grows_as_answers_come(spark, tmp_path):
    """A run that breaks off in its second round has saved the first one; the next run asks for the rest only; statistics add up."""
    from tidemark.sources import store

    cache = str(tmp_path / "cache")

    def behave(batch, times):
        if {r["id"] for r in batch} == {3}:
            return [answer(3, "not-ai")]
        return [answer(r["id"]) for r in batch if r["id"] != 3]

    model = decisions.Model(counting(tmp_path / "a", behave), "p", "m", size=2, retries=0, secrets=("because",))
    run = decisions.model_run(entities(spark), model, cache)
    assert told(run.outcomes)[3] == (None, "model-response-invalid", 1)
    stats = run.statistics.first()
    assert (stats.candidates, stats.provider_decisions, stats.response_invalid, stats.requests, stats.adds_up) == (4, 3, 1, 2, True)
    assert [(r.source, r.target, r.message) for r in decisions.model_errors(run.outcomes).collect()] == [("model", "repository:3", "model-response-invalid")]
    assert {r.id: r.evidence for r in store.read(spark, cache, decisions.corrupt_entries).collect()} == dict.fromkeys((1, 2, 4), "[REDACTED]")
    run = decisions.model_run(entities(spark), model, cache)
    assert {r.id: (r.decision, r.origin) for r in run.outcomes.collect()} == {1: ("ai-related", "cache"), 2: ("ai-related", "cache"), 3: ("not-ai", "provider"), 4: ("ai-related", "cache")}
    stats = run.statistics.first()
    assert (stats.cache_hits, stats.provider_decisions, stats.not_ai, stats.requests, stats.adds_up) == (3, 1, 1, 1, True)
    assert store.read(spark, cache).count() == 4 and store.current(spark, cache).number == 2
    store.changed(spark, cache, lambda rows: rows.withColumn("id", rows["id"] + 1))
    with pytest.raises(ValueError):
        decisions.model_run(entities(spark), model, cache)
