import pytest

from tidemark.functions.lexicon import Lexicon
from tidemark.operators import topics

L = Lexicon()
SCHEMA = "id long, topics array<string>, description string, readme string"


def assess(spark, *rows):
    entities = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    observed = topics.observations(entities, L)
    return observed, topics.relevance(entities, observed, L)


def test_decisions(spark):
    _, found = assess(spark, (["machine-learning"], None, None), ([], None, "An experimental transformer implementation."), ([], "A calendar and task manager for small teams.", None))
    assert [r.decision for r in found.orderBy("id").collect()] == ["ai-related", "review", "not-ai"]


@pytest.mark.parametrize("counts,score", [((1, 0, 0), 65), ((3, 0, 0), 80), ((0, 1, 0), 45), ((0, 2, 0), 60), ((0, 0, 1), 30), ((0, 0, 2), 45), ((2, 2, 0), 100), ((1, 1, 1), 100)])
def test_scores(spark, counts, score):
    words = ["llm", "rag", "multimodal"]
    row = (words[: counts[0]], " ".join(words[: counts[1]]), " ".join(words[: counts[2]]))
    _, found = assess(spark, row)
    assert found.first().score == score


def test_keywords_and_emerging(spark):
    rows = [(["graph-rag", "knowledge-graph", "typescript"], None, None), ([], "A GraphRAG toolkit for AI agents.", None)] + [(["graph-rag"], None, None)] * 3 + [([], "Agentic RAG workflows for large language models.", None)]
    observed, found = assess(spark, *rows)
    seen = {(r.id, r.keyword) for r in observed.collect()}
    assert {(0, "graph-rag"), (1, "graph-rag"), (5, "agentic-rag")} <= seen and (0, "typescript") not in seen
    status = [r.status for r in topics.community_status(observed, found, L).orderBy("id").collect()]
    assert status == ["emerging"] * 5 + ["unknown"]


def test_hyphenated_phrase_counts_twice(spark):
    observed, _ = assess(spark, ([], "machine-learning and machine learning", None))
    assert {(r.keyword, r.occurrences) for r in observed.collect()} == {("machine-learning", 3)}


def test_accents_bound_no_words(spark):
    observed, _ = assess(spark, ([], "éai ai", None))
    assert [(r.keyword, r.occurrences) for r in observed.collect()] == [("ai", 2)]


def test_normal_forms_are_those_of_the_patterns(spark):
    """The normal form against its definition, pattern by pattern; also over more topics than a task remembers."""
    import random
    import re

    from tidemark.functions import keywords
    from tidemark.functions.text import WHITE

    def defined(t):
        t = re.sub(f"[_/{WHITE}]+", "-", re.sub(rf"^[{WHITE}]+|[{WHITE}]+\Z", "", t).lower())
        t = re.sub("-+", "-", re.sub("[^a-z0-9-]", "", t))
        return re.sub(r"^-|-\Z", "", t)

    draw = random.Random(7)
    texts = ["", "-", " - ", "\x85a", "A__b//C", "İKÅa", *("".join(draw.choices("aZ9-_/ \t\x0b\x1c  ﻿Kéß中", k=draw.randrange(1, 40))) for _ in range(2000))]
    assert [keywords.normal_form(t) for t in texts] == [defined(t) for t in texts]
    many = [f"Topic {k}" for k in range(keywords.REMEMBERED + 5)] * 2
    find = keywords.Extractor(L)
    assert find.of_topics([*many, None, "", "Python"]) == [defined(t) for t in many] and len(find.named) <= keywords.REMEMBERED


def test_keywords_are_counted_where_they_are_found(spark):
    """One row a keyword and source leaves Python, whatever its repeats, in batches of a size that suits texts; ids that are there twice add up."""
    text = "machine learning " * 500
    rows = [(i, ["LLM", "llm", None], "RAG rag", text) for i in (1, 2, 2)]
    entities = spark.createDataFrame(rows, SCHEMA)
    observed = topics.observations(entities, L)
    assert {(r.id, r.source, r.keyword): r.occurrences for r in observed.collect()} == {
        (i, s, k): n * (i if i == 2 else 1) for i in (1, 2) for s, k, n in (("topics", "llm", 2), ("description", "rag", 2), ("readme", "machine-learning", 500))
    }
    assert "MapInArrow" in (plan := observed._jdf.queryExecution().toString()) and "Generate" not in plan
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_words_are_the_matches_of_the_token_pattern(spark):
    """Words, hyphens and capitals against their patterns, over texts in which hyphens stand everywhere."""
    import random
    import re

    from tidemark.functions import keywords

    draw = random.Random(3)
    parts = ["of the", "ai", "RAG", "fooBar", "http://x.y/z", *"aB9-_/ \t.\néK?", "--", " -", "- "]
    find = keywords.Extractor(L)
    for text in ["", "-", "- -a", "a--b-", *("".join(draw.choices(parts, k=draw.randrange(40))) for _ in range(5000))]:
        found = find.searchable(text)
        assert found == re.sub("[_/]+", "-", find._LINK.sub(" ", re.sub("([a-z0-9])([A-Z])", r"\1-\2", text).lower()))
        assert find.words(found) == re.findall(keywords.TOKEN, found)


def test_words_are_looked_up_once_a_text(spark):
    """Repeats are counted before anything is looked up; plain words that can't be keywords aren't looked up at all."""
    from tidemark.functions import keywords

    find, asked = keywords.Extractor(L), []
    find.known = keywords._Known(lambda w: asked.append(w) or find._of_token(w))
    assert find("plain words, llm llm and ai-tools ai-tools " * 300, ("tokens",)) == {"llm": 600, "ai-tools": 600}
    assert sorted(asked) == ["ai-tools", "llm"]


def test_census_holds_no_sets(spark):
    observed, _ = assess(spark, (["llm"], "llm rag", "rag"), ([], "llm", None))
    found = topics.census(observed)
    assert {(r.keyword, r.entities, r.occurrences, tuple(r.sources)) for r in found.collect()} == {("llm", 2, 3, ("description", "topics")), ("rag", 1, 2, ("description", "readme"))}
    assert "ObjectHashAggregate" not in found._jdf.queryExecution().executedPlan().toString()
