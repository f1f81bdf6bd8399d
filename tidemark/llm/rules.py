"""Quality rules whose cut-offs follow each language and source.

Every document gets counts. Ratios of them (per million) and sizes of the documents that pass the base rule
go into quantile sketches for each (language, source): histograms over buckets of equal relative width, so
sketches merge by adding counts, the quantiles are exact to one part in 32, and the same rows always
give the same sketch. A group's cut-off lies beyond a high quantile of its sketch, by a multiple of that
quantile's distance from the median. Where the two agree, what one fault makes in a document of a size that is
usual in the group stands for their distance, so no fixed ratio decides anywhere. Groups that are too
small use their language's sketches, else those of all documents, which are sums of the same buckets. The
thresholds are then joined to the documents.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import by_batch, saved, small_batches

#: Metric -> (counted, of).
METRICS = {
    "symbols": ("n_symbols", "word_chars"),
    "upper": ("n_upper", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: A group needs so many documents for a sketch of its own.
MIN_GROUP = 100
#: Metric -> (a high quantile, in hundredths; so many times its distance from the median is added; the quantile
#: of sizes in which one fault is the least such distance).
#: About a tenth of the documents may be full of symbols, so only nine tenths tell what is usual; a short text
#: with three of them is none of those. The other faults are rare, but good documents have them too, so their
#: quantile lies further out.
HIGH = {"symbols": (90, 3, 10), "upper": (99, 2, 50), "dup_lines": (99, 2, 50), "repeats": (99, 2, 50)}
#: Ratios are parts of this.
WHOLE = 1_000_000
SIZES = {METRICS[m][1]: size for m, (_, _, size) in reversed(HIGH.items())}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(WINDOW)], dtype=np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur twice or more, first occurrences included.

    Windows are first compared by a 64-bit hash; those that may be repeated are then compared as words.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashed = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        rolled += (hashed[k : k + n] ^ (hashed[k : k + n] >> np.uint64(31))) * _FACTORS[k]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = True
    maybe[order[:-1][same]] = True
    at = np.flatnonzero(maybe).tolist()
    windows = [tuple(words[i : i + WINDOW]) for i in at]
    times = Counter(windows)
    change = np.zeros(len(words) + 1, np.int64)
    for i, window in zip(at, windows, strict=True):
        if times[window] > 1:
            change[i] += 1
            change[i + WINDOW] -= 1
    return int((np.cumsum(change) > 0).sum())


def counts(raw: bytes) -> tuple[int, ...]:
    """COUNTS of a text in UTF-8."""
    words = raw.split()
    seen, lines, dup = set(), 0, 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    joined = b"".join(words)
    points = len(joined) if joined.isascii() else len(joined.decode())
    return (len(words), points, len(joined) - len(joined.translate(None, SYMBOLS)), dup, repeated_words(words), lines, len(joined) - len(joined.translate(None, CAPITALS)))


def _counted(texts: list[bytes]) -> dict:
    return dict(zip(COUNTS, zip(*map(counts, texts), strict=True), strict=True))


def count_documents(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the COUNTS; a null text counts as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), *((c, pa.int64()) for c in COUNTS)])

    def count(batch: pa.RecordBatch) -> dict:
        return {c: batch[c] for c in ("doc_id", "lang", "source")} | _counted(batch["text"].to_pylist())

    given = small_batches(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    return given.mapInArrow(by_batch(count, schema), "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def ratio(metric: str) -> Column:
    counted, of = METRICS[metric]
    return F.expr(f"{counted} * {WHOLE} div greatest({of}, 1)")


def bucket(value: Column) -> Column:
    """The lowest value of the bucket: the leading six binary digits are kept."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(counted: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n: a mergeable sketch for each group and metric, and for each size that ratios refer to."""
    measured = {m: ratio(m) for m in METRICS} | {c: F.col(c).cast("long") for c in SIZES}
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in measured.items()))
    return (
        counted.select("lang", "source", F.explode(pairs).alias("p"))
        .groupBy("lang", "source", F.col("p.metric").alias("metric"), bucket(F.col("p.value")).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _quantiles(sketch: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The keys and the metric, with suffix ``name``, and a struct ``name`` for each group: total, median and high quantile of the metric, and one fault's ratio in a document of usual size."""
    by = [*keys, "metric"]
    size = F.create_map(*(F.lit(x) for c, q in SIZES.items() for x in (c, q)))[F.col("metric")]
    high = F.coalesce(F.create_map(*(F.lit(x) for m, (h, *_) in HIGH.items() for x in (m, h)))[F.col("metric")], size)
    merged = sketch.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    below = F.sum("n").over(Window.partitionBy(*by).orderBy("bucket"))
    total = F.sum("n").over(Window.partitionBy(*by))
    at = lambda num, den: F.min(F.when(F.col("below") * den >= F.col("total") * num, F.col("bucket")))
    found = merged.select(*by, "bucket", below.alias("below"), total.alias("total")).groupBy(*by)
    found = found.agg(F.max("total").alias("total"), at(1, 2).alias("median"), at(high, 100).alias("high"))
    group = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("total", "median", "high")))).alias("q"))
    one = lambda of: F.floor(F.lit(WHOLE) / F.greatest(F.col("q")[of]["high"], F.lit(1))).alias("one")
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.struct(*(F.col("q")[m][c].alias(c) for c in ("total", "median", "high")), one(of)).alias(name)) for m, (_, of) in METRICS.items()))
    rows = group.filter(F.size("q") > 0).select(*keys, F.inline(each))
    return rows.withColumnsRenamed({k: f"{k}_{name}" for k in by})


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def thresholds(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """lang, source and one column for each metric: the largest ratio, per million, that isn't a fault.

    It is a high quantile of the group plus some times its distance from the median, and that distance is at
    least what one fault makes in a document of a usual size (HIGH). No group's threshold is over what
    its language's sketch, or that of all documents, gives for twice the reach, so a source full of junk
    doesn't raise its own.
    """
    reach = F.create_map(*(F.lit(x) for m, (_, r, _) in HIGH.items() for x in (m, r)))[F.col("metric")]
    cut = lambda q, times=1: F.col(f"{q}.high") + times * reach * F.greatest(F.col(f"{q}.high") - F.col(f"{q}.median"), F.col(f"{q}.one"))
    joined = (
        _quantiles(sketch, ["lang", "source"], "own")
        .withColumnsRenamed({"lang_own": "lang", "source_own": "source", "metric_own": "metric"})
        .join(_quantiles(sketch, ["lang"], "language"), F.col("lang").eqNullSafe(F.col("lang_language")) & (F.col("metric") == F.col("metric_language")))
        .join(_quantiles(sketch, [], "every"), F.col("metric") == F.col("metric_every"))
    )
    spoken, most = F.col("language.total") >= min_group, cut("every", 2)
    language = F.when(spoken, F.least(cut("language"), most)).otherwise(cut("every"))
    bound = F.when(spoken, F.least(cut("language", 2), most)).otherwise(most)
    chosen = F.when(F.col("own.total") >= min_group, F.least(cut("own"), bound)).otherwise(language)
    return joined.select("lang", "source", "metric", chosen.alias("most")).groupBy("lang", "source").agg(
        *(F.max(F.when(F.col("metric") == m, F.col("most"))).alias(f"most_{m}") for m in METRICS)
    )


def _judged(counted: DataFrame, min_group: int) -> DataFrame:
    """``counted`` with base_failed, the thresholds of its group and ``kept``.

    The thresholds are a small written table; Spark broadcasts it if its size allows, else it joins by group.
    A group without thresholds has no document that passes the base rule.
    """
    limits = saved(thresholds(sketches(counted.filter(~base_failed())), min_group), "thresholds").withColumnsRenamed({"lang": "lang_", "source": "source_"})
    joined = counted.join(limits, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")), "left").drop("lang_", "source_")
    passes = ~base_failed()
    for m in METRICS:
        passes &= F.coalesce(ratio(m) <= F.col(f"most_{m}"), F.lit(True))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", passes)


def quality_verdicts(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row for each row of ``docs``: its counts, base_failed, its group's thresholds and ``kept``.

    Null languages and sources form groups of their own, null texts count as empty, repeated rows give
    repeated results and count as often in the sketches; ties at a threshold are kept. A document is
    kept if it passes the base rule and no ratio is over its group's threshold. No documents give no rows.
    """
    judged = _judged(saved(count_documents(docs), "counts"), min_group)
    return judged.select("doc_id", *COUNTS, "base_failed", *(f"most_{m}" for m in METRICS), "kept")


def keep_quality(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged, whatever their columns are called.

    Nulls, repeats, ties and empty tables are as in ``quality_verdicts``. Texts are counted once: the
    rows are written with their counts, since a verdict needs the sketches of all rows.
    """

    def count(batches):
        for batch in batches:
            if batch.num_rows:
                found = _counted([(t or "").encode() for t in batch["row"].field("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch["row"], *(pa.array(found[c], pa.int64()) for c in COUNTS)], names=["row", *COUNTS])

    rows = small_batches(docs).select(F.struct("*").alias("row"))
    schema = StructType([*rows.schema, *(StructField(c, LongType()) for c in COUNTS)])
    counted = saved(rows.mapInArrow(count, schema), "counted")
    keyed = counted.select("row", F.col("row.lang").cast("string").alias("lang"), F.col("row.source").cast("string").alias("source"), *COUNTS)
    return _judged(keyed, min_group).filter("kept").select("row.*")


def _quantile_sql(name: str, keys: list[str]) -> str:
    """Total and cut-offs of merged sketches, as ``_quantiles`` and ``thresholds`` find them."""
    by, same = ", ".join([*keys, "metric"]), " AND ".join(["true", *(f"r.{k} IS NOT DISTINCT FROM s.{k}" for k in keys)])
    case = lambda values: "CASE r.metric " + " ".join(f"WHEN '{m}' THEN {v}" for m, v in values.items()) + " END"
    high, reach = case({m: h for m, (h, *_) in HIGH.items()} | SIZES).replace("r.metric", "metric"), case({m: r for m, (_, r, _) in HIGH.items()})
    of, one = case({m: f"'{of}'" for m, (_, of) in METRICS.items()}), f"{WHOLE} // greatest(s.high, 1)"
    return f"""
{name}_q AS (
    SELECT {by}, max(total) AS total, min(bucket) FILTER (below * 2 >= total) AS median, min(bucket) FILTER (below * 100 >= total * {high}) AS high
    FROM (
        SELECT {by}, bucket, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY {by}) AS total
        FROM (SELECT {by}, bucket, sum(n) AS n FROM sketches GROUP BY {by}, bucket))
    GROUP BY {by}),
{name} AS (
    SELECT {", ".join(f"r.{k}" for k in [*keys, "metric", "total"])}, r.high + {reach} * greatest(r.high - r.median, {one}) AS cut, r.high + 2 * {reach} * greatest(r.high - r.median, {one}) AS far
    FROM {name}_q r JOIN {name}_q s ON s.metric = {of} AND {same})"""


#: The verdicts in DuckDB's SQL.
ORACLE_SQL = f"""
WITH given AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
split AS (
    SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda line: regexp_matches(line, '[^\\x20\\x09-\\x0D]')) AS lines FROM given),
windows AS (SELECT doc_id, i, md5(array_to_string(words[i : i + {WINDOW - 1}], ' ')) AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM split)),
repeated AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM windows JOIN (SELECT doc_id, w FROM windows GROUP BY doc_id, w HAVING count(*) > 1) USING (doc_id, w))
    GROUP BY doc_id),
counted AS (
    SELECT s.doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines, len(regexp_extract_all(text, '[A-Z]')) AS n_upper
    FROM split s LEFT JOIN repeated r USING (doc_id)),
based AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted),
ratios AS ({" UNION ALL ".join(f"SELECT doc_id, lang, source, base_failed, '{m}' AS metric, {a} * {WHOLE} // greatest({b}, 1) AS v FROM based" for m, (a, b) in METRICS.items())}),
measured AS (SELECT doc_id, lang, source, base_failed, metric, v FROM ratios {"".join(f" UNION ALL SELECT doc_id, lang, source, base_failed, '{c}', {c} FROM based" for c in SIZES)}),
bucketed AS (SELECT *, (v >> greatest(length(bin(v)) - 6, 0)::BIGINT) << greatest(length(bin(v)) - 6, 0)::BIGINT AS bucket FROM measured),
sketches AS (SELECT lang, source, metric, bucket, count(*) AS n FROM bucketed WHERE NOT base_failed GROUP BY ALL),
{_quantile_sql("own", ["lang", "source"])}, {_quantile_sql("language", ["lang"])}, {_quantile_sql("every", [])},
chosen AS (
    SELECT o.lang, o.source, o.metric, CASE
        WHEN o.total >= {MIN_GROUP} AND l.total >= {MIN_GROUP} THEN least(o.cut, l.far, e.far)
        WHEN o.total >= {MIN_GROUP} THEN least(o.cut, e.far)
        WHEN l.total >= {MIN_GROUP} THEN least(l.cut, e.far) ELSE e.cut END AS most
    FROM own o JOIN language l ON o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric JOIN every e ON o.metric = e.metric),
passed AS (
    SELECT doc_id, bool_and(coalesce(v <= most, true)) AS passes, {", ".join(f"max(most) FILTER (r.metric = '{m}')::BIGINT AS most_{m}" for m in METRICS)}
    FROM ratios r LEFT JOIN chosen c ON r.lang IS NOT DISTINCT FROM c.lang AND r.source IS NOT DISTINCT FROM c.source AND r.metric = c.metric GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND passes AS kept, {", ".join(f"most_{m}" for m in METRICS)}
FROM based JOIN passed USING (doc_id)
"""
