"""Keywords of whole batches against those of single texts, and what leaves the tasks."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark import catalogue
from tidemark.functions import counted, keywords
from tidemark.functions.lexicon import Lexicon
from tidemark.operators import topics
from tidemark.operators.ranking import numbered
from tidemark.plans import topic_queries
from tidemark.plans.topic_queries import LEXICON

SCHEMA = "id long, topics array<string>, description string, readme string"
PARTS = [
    "of the", "of-the", "of", "the ", "ai", "RAG", "fooBar", "http://x.y/z", "HTTPs://q", "_", "/", "__", "İ", "K", "é", *"aB9-_/ \t.\néK?ß",
    "--", " -", "- ", " machine learning ", "llm", "de la", "vision", "python", "Über KI",
]


def rows(seed, most=12):
    draw = random.Random(seed)
    text = lambda: None if draw.random() < 0.1 else "".join(draw.choices(PARTS, k=draw.randrange(30)))
    ids = sorted(draw.choice([None, *range(most)]) or 0 for _ in range(draw.randrange(1, 25)))
    return [(i, None if draw.random() < 0.1 else [text() for _ in range(draw.randrange(6))], text(), text()) for i in ids], draw.randrange(1, 9)


def by_text(given, lexicon):
    find, n = keywords.Extractor(lexicon), Counter()
    for i, named, *texts in given:
        n.update((i, "topics", k) for k in find.of_topics(named or []))
        for source, text in zip(("description", "readme"), texts, strict=True):
            for k, times in find(text or "", ("phrases", "tokens", "bigrams")).items():
                n[i, source, k] += times
    return n


def batches(given, size):
    kinds = [pa.int64(), pa.list_(pa.string()), pa.string(), pa.string()]
    whole = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*given, strict=True), kinds, strict=True)], ["id", "topics", "description", "readme"])
    return (whole.slice(k, size) for k in range(0, len(given), size))


@pytest.mark.parametrize("lexicon", [LEXICON, Lexicon(), Lexicon(phrases=("über ki",), signal_parts=frozenset(), aliases={})])
def test_batches_have_the_keywords_of_their_texts(lexicon):
    for seed in range(150):
        given, size = rows(seed)
        out = [r for b in counted.counted_keywords(lexicon)(batches(given, size)) for r in b.to_pylist()]
        assert {(r["id"], r["source"], r["keyword"]): r["occurrences"] for r in out} == by_text(given, lexicon)
        keys = [(r["id"], r["source"], r["keyword"]) for r in out]
        assert keys == sorted(set(keys))
        assert sorted((r["id"], r["keyword"]) for r in out if r["first"]) == sorted({(i, k) for i, _, k in keys})


def test_all_characters_that_become_ascii_letters_are_known():
    assert [c for c in map(chr, range(128, 0x110000)) if any(x.isascii() and x.isalnum() for x in c.lower())] == list(counted.FOLDED)


def test_census_of_marked_observations_deals_keywords_only(spark):
    """Entities are counted without their ids: nothing is grouped by id, and rows are summed up before they are dealt."""
    entities = spark.createDataFrame([(1, ["llm"], "llm rag", "rag"), (2, [], "llm", None), (2, ["rag"], "llm", None)], SCHEMA)
    marked = topics.census(topics.marked_observations(entities, Lexicon()))
    plain = topics.census(topics.observations(entities, Lexicon()))
    assert sorted(map(tuple, marked.collect())) == sorted(map(tuple, plain.collect())) == [("llm", 2, 4, ["description", "topics"]), ("rag", 2, 3, ["description", "readme", "topics"])]
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("partial_count_if" if "partial_count_if" in plan else "partial_count") < plan.index("MapInArrow") and "distinct" not in plan


def test_only_signals_leave_the_tasks(spark):
    """Signals are told where they are found; no text is dealt for them."""
    entities = spark.createDataFrame([(1, ["llm", "vision-agent", "ai-x", "paper"], "llm rag graph-rag rags", None), (1, ["llm"], None, "agent-vision")], SCHEMA)
    found = topics._found(topics._given(entities, Lexicon()), Lexicon(), signals=True)
    assert {r.keyword for r in found.collect()} == {"llm", "ai-x", "rag", "graph-rag"}
    signals = topics.signal_observations(entities, Lexicon())
    assert {(r.source, r.keyword): r.occurrences for r in signals.collect()} == {("topics", "llm"): 2, ("topics", "ai-x"): 1, ("description", "llm"): 1, ("description", "rag"): 1, ("description", "graph-rag"): 1}
    plan = signals._jdf.queryExecution().executedPlan().toString().rpartition("Initial Plan")[2]
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("MapInArrow")


def test_signals_are_those_of_the_column(spark):
    words = ["ai", "ai-x", "x-ai", "rag", "a-rag-b", "drag", "rag-x", "llms", "x-llms", "rag.", "", "paper", "multimodal"]
    for lexicon in (Lexicon(), LEXICON, Lexicon(signal_parts=frozenset(["r.g", "x"]))):
        told = counted._signals(pa.array(words, pa.large_string()), lexicon).to_pylist()
        assert told == [r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", keywords.is_signal(F.col("w"), lexicon).alias("s")).collect()]


def test_observations_in_order_are_numbered_as_they_come(spark):
    """Texts are dealt by ranges of ids; their keywords are neither dealt nor sorted again."""
    draw = random.Random(4)
    rows_ = [(draw.randrange(300), ["llm", draw.choice("abc")], "vision agent rag", "RAG llm") for _ in range(500)] + [(None, ["rag"], None, None)] * 2
    entities = spark.createDataFrame(rows_, SCHEMA).repartition(7)
    ordered = topics.marked_observations(entities, Lexicon(), ordered=True).select("id", "source", "keyword")
    found = [tuple(r) for r in numbered(ordered, "place").orderBy("place").collect()]
    want = sorted((tuple(r) for r in topics.observations(entities, Lexicon()).select("id", "source", "keyword").collect()), key=lambda r: (r[0] is not None, r))
    assert found == [(*r, k) for k, r in enumerate(want, 1)]
    plan = ordered._jdf.queryExecution().executedPlan().toString().rpartition("Initial Plan")[2]
    assert plan.count("Sort [") == plan.count("Exchange range") == 1 and plan.index("MapInArrow") < plan.index("Sort [") < plan.index("Exchange")


@pytest.mark.parametrize("name", ["p9_related", "f16_score"])
def test_scores_are_made_of_signals_only(spark, name, monkeypatch):
    """Other keywords don't leave the tasks of the queries over scores: their rows are what the signals' step gives."""
    sf_dir = "/root/testdata/sf0.001"
    whole = topics.relevance(topic_queries.entities(spark, sf_dir), topic_queries.observed(spark, sf_dir), LEXICON)
    want = whole.filter("decision = 'ai-related'").select("id") if name == "p9_related" else whole.select("id", "score", "decision")
    asked, count = [], counted.counted_keywords
    monkeypatch.setattr(topics, "counted_keywords", lambda lexicon, signals=False: asked.append(signals) or count(lexicon, signals))
    found = catalogue.queries()[name](spark, sf_dir)
    assert asked == [True]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sorted(found.collect()) == sorted(want.collect())
    below = plan[plan.index("MapInArrow") :].partition("Join")[0]
    assert "Exchange" not in below and "Sort" not in below


def test_words_are_counted_in_parts_of_batches(monkeypatch):
    """A worker holds the words of a few texts, whatever the batches; they are those of the token pattern."""
    given = rows(8)[0] * 40
    seen, parts = [], counted._Texts
    monkeypatch.setattr(counted, "_Texts", lambda texts, find: seen.append(len(texts)) or parts(texts, find))
    n, find = Counter(), keywords.Extractor(LEXICON)
    for b in counted.counted_words(LEXICON)(batches(given, len(given))):
        for r in b.to_pylist():
            n[r["word"]] += r["n"]
    want = Counter(LEXICON.aliases.get(w, w) for *_, d, r in given for t in (d, r) if t for w in find.words(find.searchable(t)))
    assert n == want and len(given) > counted.AT_ONCE >= max(seen)
