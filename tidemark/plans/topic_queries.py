"""Keywords over documents: the first line stands for topics, the second for the description, the rest for the README."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keywords
from ..functions.batches import small_batches
from ..functions.lexicon import Lexicon
from ..operators import topics
from ..operators.city import communities
from ..operators.ranking import dense_places
from ..scratch import saved
from .registry import query, table

#: The documents are invented syllables, so signals are words that do occur.
LEXICON = Lexicon(
    signals=frozenset("the is by and ai la".split()),
    signal_parts=frozenset(["rag", "ing"]),
    anchors=frozenset(["the", "of", "de"]),
    suffixes=frozenset(["the", "de"]),
    generic=frozenset(["in", "es", "ti"]),
    stopwords=frozenset("a an are at be to with la".split()),
    broad=frozenset(["the", "and", "de"]),
    broad_communities=frozenset(["the", "and", "de", "la"]),
    aliases={"is": "was", "der-the": "th-the"},
    phrases=("of the", "de la", "by and", "in the"),
    districts={"first": ("ai", "by"), "second": ("ing", "of-the", "th"), "third": ("of", "was")},
    shown=("third", "second", "first", "frontier"),
)


#: ``text.WHITE`` in the notation of DuckDB's patterns.
SQL_WHITE = r"\t\n\x{0b}\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


def _normal(x: str) -> str:
    text = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({x}, '^[{SQL_WHITE}]+|[{SQL_WHITE}]+$', '', 'g')), '[_/{SQL_WHITE}]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"
    return "CASE " + " ".join(f"WHEN {text} = '{a}' THEN '{k}'" for a, k in LEXICON.aliases.items()) + f" ELSE {text} END"


def _keyword(phrase: str) -> str:
    joined = phrase.replace(" ", "-")
    return LEXICON.aliases.get(joined, joined)


_COMPOUND = f"""(len(string_split(w, '-')) BETWEEN 2 AND 3
    AND len(list_filter(string_split(w, '-'), lambda p: length(p) < 2 OR regexp_matches(p, '[0-9]') OR p IN ({_list(LEXICON.stopwords)}))) = 0
    AND (string_split(w, '-')[1] = 'ai' OR list_has_any(string_split(w, '-'), [{_list(LEXICON.anchors)}])))"""

#: The README of ``parts``.
_README = "array_to_string(lines[3:], chr(10))"


def _observations(readme: str) -> str:
    return f"""
WITH parts AS (SELECT doc_id AS id, string_split(text, chr(10)) AS lines, text FROM documents),
entities AS (
    SELECT id, string_split(lines[1], ' ') AS topics, lines[2] AS description, {readme} AS readme FROM parts),
texts AS (SELECT id, 'description' AS source, coalesce(description, '') AS t FROM entities UNION ALL SELECT id, 'readme', coalesce(readme, '') FROM entities),
searched AS (
    SELECT id, source, regexp_replace(regexp_replace(lower(regexp_replace(t, '([a-z0-9])([A-Z])', '\\1-\\2', 'g')), 'https?://[^{SQL_WHITE}]+', ' ', 'g'), '[_/]+', '-', 'g') AS t FROM texts),
tokens AS (SELECT id, source, unnest(regexp_extract_all(t, '{keywords.TOKEN}')) AS raw, generate_subscripts(regexp_extract_all(t, '{keywords.TOKEN}'), 1) AS i FROM searched),
words AS (SELECT id, source, i, {_normal("raw")} AS w FROM tokens),
paired AS (SELECT *, coalesce(lead(w) OVER (PARTITION BY id, source ORDER BY i), '') AS next FROM words),
found AS (
    SELECT id, 'topics' AS source, k AS keyword FROM (SELECT id, {_normal("topic")} AS k FROM (SELECT id, unnest(topics) AS topic FROM entities)) WHERE k <> '' AND k NOT IN ({_list(LEXICON.generic)})
    {" ".join(f"UNION ALL SELECT id, source, '{_keyword(p)}' FROM (SELECT id, source, unnest(regexp_extract_all(t, '{chr(92)}b{p.replace(' ', '[ -]+')}{chr(92)}b')) FROM searched)" for p in LEXICON.phrases)}
    UNION ALL SELECT id, source, w FROM words WHERE w <> '' AND (w IN ({_list(LEXICON.signals)}) OR {_COMPOUND})
    UNION ALL SELECT id, source, {_normal("w || '-' || next")} FROM paired WHERE regexp_full_match(w, '[a-z]{{3,}}')
        AND w NOT IN ({_list(LEXICON.stopwords | LEXICON.generic | LEXICON.anchors)}) AND next IN ({_list(LEXICON.suffixes)})),
observed AS (
    SELECT id, source, keyword, count(*) AS occurrences, CASE source WHEN 'topics' THEN CAST(0.95 AS DOUBLE) WHEN 'description' THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.65 AS DOUBLE) END AS confidence
    FROM found WHERE keyword <> '' GROUP BY ALL),
signals AS (
    SELECT *, row_number() OVER (PARTITION BY id, source ORDER BY keyword) AS k FROM observed
    WHERE keyword IN ({_list(LEXICON.signals)}) OR list_has_any(string_split(keyword, '-'), [{_list(LEXICON.signal_parts)}]) OR starts_with(keyword, 'ai-')),
worths AS (SELECT id, source, keyword, CASE source WHEN 'topics' THEN CASE k WHEN 1 THEN 65 ELSE 15 END WHEN 'description' THEN CASE k WHEN 1 THEN 45 ELSE 15 END ELSE CASE k WHEN 1 THEN 30 ELSE 15 END END AS worth FROM signals WHERE k <= 2),
scored AS (SELECT id, CAST(least(100, sum(worth)) AS BIGINT) AS score FROM worths GROUP BY id),
assessed AS (SELECT e.id, coalesce(score, 0) AS score, CASE WHEN coalesce(score, 0) >= 50 THEN 'ai-related' WHEN coalesce(score, 0) >= 25 THEN 'review' ELSE 'not-ai' END AS decision FROM entities e LEFT JOIN scored USING (id)),
related AS (SELECT id FROM assessed WHERE decision = 'ai-related'),
shared AS (SELECT keyword, count(DISTINCT id) AS entities FROM observed WHERE id IN (FROM related) GROUP BY keyword),
ranked AS (
    SELECT o.id, keyword, row_number() OVER (PARTITION BY o.id ORDER BY entities DESC, max(confidence) DESC, sum(occurrences) DESC, keyword) AS k
    FROM observed o JOIN shared USING (keyword) WHERE o.id IN (FROM related) AND keyword NOT IN ({_list(LEXICON.broad_communities)}) GROUP BY o.id, keyword, entities),
homes AS (SELECT r.id, coalesce(keyword, 'frontier') AS community FROM related r LEFT JOIN (FROM ranked WHERE k = 1) USING (id))
"""


_OBSERVED = _observations(_README)
#: The same over the beginning of each README, for queries that ask for no more.
_BOUNDED = _observations(f"substr({_README}, 1, 12000)")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.split(F.get(lines, F.lit(0)), " ").alias("topics"),
        F.get(lines, F.lit(1)).alias("description"),
        F.array_join(F.slice(lines, 3, F.greatest(F.size(lines), F.lit(1))), "\n").alias("readme"),
    )


def bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.cut_readmes(entities(spark, sf_dir), LEXICON.readme_limit)


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.observations(entities(spark, sf_dir), LEXICON)


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.marked_observations(entities(spark, sf_dir), LEXICON)


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.relevance(entities(spark, sf_dir), topics.signal_observations(entities(spark, sf_dir), LEXICON), LEXICON)


def analyzed(spark: SparkSession, sf_dir: str, given: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Observations and assessments of all entities, or those ``given``; the texts are read once."""
    seen = saved(topics.observations(entities(spark, sf_dir) if given is None else given, LEXICON), "observed")
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return seen, saved(topics.relevance(ids, seen, LEXICON).drop("evidence"), "assessed")


def homes(spark: SparkSession, sf_dir: str, found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    seen, scored = found or analyzed(spark, sf_dir)
    return topics.primary_communities(seen, scored.filter("decision = 'ai-related'").select("id"), LEXICON)


@query("f5_normalize", f"SELECT doc_id, {_normal('text')} AS keyword FROM documents")
def f5(spark, sf_dir):
    return small_batches(table(spark, sf_dir, "documents")).select("doc_id", keywords.normalized(F.col("text"), LEXICON).alias("keyword"))


@query("f8_tokens", _BOUNDED + "SELECT w AS token, count(*) AS n FROM words GROUP BY w")
def f8(spark, sf_dir):
    return topics.words(bounded(spark, sf_dir), LEXICON).select(F.col("word").alias("token"), "n")


@query(
    "f7_phrases",
    "SELECT doc_id, keyword, n FROM ("
    + " UNION ALL ".join(
        f"SELECT doc_id, '{_keyword(p)}' AS keyword, len(regexp_extract_all(regexp_replace(regexp_replace(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1-\\2', 'g')), 'https?://[^{SQL_WHITE}]+', ' ', 'g'), '[_/]+', '-', 'g'), '\\b{p.replace(' ', '[ -]+')}\\b')) AS n FROM documents"
        for p in LEXICON.phrases
    )
    + ") WHERE n > 0",
)
def f7(spark, sf_dir):
    found = keywords.text_keywords(F.col("text"), LEXICON, ("phrases",))
    return small_batches(table(spark, sf_dir, "documents")).select("doc_id", F.explode(found).alias("keyword")).groupBy("doc_id", "keyword").agg(F.count(F.lit(1)).alias("n"))


@query("f10_bigrams", _BOUNDED + f"SELECT id, {_normal(chr(119) + ' || ' + chr(39) + '-' + chr(39) + ' || next')} AS keyword, count(*) AS n FROM paired WHERE regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN ({_list(LEXICON.stopwords | LEXICON.generic | LEXICON.anchors)}) AND next IN ({_list(LEXICON.suffixes)}) GROUP BY ALL")
def f10(spark, sf_dir):
    texts = small_batches(bounded(spark, sf_dir)).select("id", F.explode(F.array("description", "readme")).alias("t"))
    pairs = keywords.text_keywords(F.col("t"), LEXICON, ("bigrams",))
    return texts.select("id", F.explode(pairs).alias("keyword")).groupBy("id", "keyword").agg(F.count(F.lit(1)).alias("n"))


@query("a14_observations", _OBSERVED + "SELECT * FROM observed")
def a14(spark, sf_dir):
    return observed(spark, sf_dir)


@query("f16_score", _OBSERVED + "SELECT * FROM assessed")
def f16(spark, sf_dir):
    return assessed(spark, sf_dir).select("id", "score", "decision")


@query("f16_evidence", _OBSERVED + "SELECT id, source, keyword, worth FROM worths")
def f16_evidence(spark, sf_dir):
    return assessed(spark, sf_dir).select("id", F.inline("evidence"))


@query("a15_census", _OBSERVED + "SELECT keyword, count(DISTINCT id) AS entities, CAST(sum(occurrences) AS BIGINT) AS occurrences, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM observed GROUP BY keyword")
def a15(spark, sf_dir):
    return topics.census(marked(spark, sf_dir)).withColumn("sources", F.array_join("sources", ","))


@query("o3_census_top", _OBSERVED + "SELECT *, row_number() OVER (ORDER BY entities DESC, occurrences DESC, keyword) AS place FROM (SELECT keyword, count(DISTINCT id) AS entities, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM observed GROUP BY keyword)")
def o3(spark, sf_dir):
    return dense_places(topics.census(marked(spark, sf_dir)).select("keyword", "entities", "occurrences"), [F.desc("entities"), F.desc("occurrences"), F.col("keyword")], "place")


@query(
    "a17_emerging",
    _BOUNDED + f", wide AS (SELECT keyword FROM shared WHERE entities >= 5 AND keyword NOT IN ({_list(LEXICON.broad)})) "
    "SELECT id, CASE WHEN decision = 'ai-related' THEN CASE WHEN id IN (SELECT id FROM observed WHERE keyword IN (FROM wide)) THEN 'emerging' ELSE 'unknown' END END AS status FROM assessed",
)
def a17(spark, sf_dir):
    return topics.community_status(*analyzed(spark, sf_dir, bounded(spark, sf_dir)), LEXICON)


@query("a18_related_counts", _OBSERVED + "SELECT * FROM shared")
def a18(spark, sf_dir):
    seen, scored = analyzed(spark, sf_dir)
    return topics.related_counts(seen, scored.filter("decision = 'ai-related'"))


@query("a19_primary_community", _OBSERVED + "SELECT * FROM homes")
def a19(spark, sf_dir):
    return homes(spark, sf_dir)


_DISTRICT = "CASE " + " ".join(f"WHEN community IN ({_list(ws)}) OR list_has_any(string_split(community, '-'), [{_list(ws)}]) THEN '{d}'" for d, ws in LEXICON.districts.items()) + " ELSE 'frontier' END"
_LABEL = f"array_to_string(list_transform(string_split(community, '-'), lambda p: CASE WHEN p IN ({_list(LEXICON.acronyms)}) THEN upper(p) ELSE upper(substr(p, 1, 1)) || substr(p, 2) END), ' ')"


@query("j13_district", _OBSERVED + f"SELECT id, community, {_DISTRICT} AS district FROM homes")
def j13(spark, sf_dir):
    return homes(spark, sf_dir).withColumn("district", keywords.district(F.col("community"), LEXICON))


@query("f19_label", _OBSERVED + f"SELECT DISTINCT community, {_LABEL} AS label FROM homes")
def f19(spark, sf_dir):
    return homes(spark, sf_dir).select("community", keywords.label(F.col("community"), LEXICON).alias("label")).distinct()


@query(
    "a20_communities",
    _OBSERVED + f"SELECT community, {_LABEL} AS label, {_DISTRICT} AS district, CASE WHEN community <> 'frontier' AND coalesce(max(entities), 0) >= 5 THEN 'emerging' ELSE 'unknown' END AS status, count(*) AS entities "
    "FROM homes LEFT JOIN shared ON shared.keyword = community GROUP BY community",
)
def a20(spark, sf_dir):
    found = analyzed(spark, sf_dir)
    placed = homes(spark, sf_dir, found).withColumn("district", keywords.district(F.col("community"), LEXICON))
    related = topics.related_counts(found[0], found[1].filter("decision = 'ai-related'"))
    return communities(placed, related, LEXICON).select("community", "label", "district", "status", "entities")
