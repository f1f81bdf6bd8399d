import random
import re
from collections import Counter

import duckdb

from tidemark.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_counts():
    rng = random.Random(6)
    texts = ["", " \n ", "é ü\n\né ü\n é ü", "a b c d e f g h " * 2, "a\x0bb\x0cc\x85d\xa0e\n" * 3]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["\n".join(rng.choice(["x y", "#% z", "", "  ", "x y "]) for _ in range(9)) for _ in range(50)]
    for text in texts:
        assert rules.counts(text.encode())[:5] == slow(text)


def test_buckets_keep_six_digits(spark):
    values = [0, 1, 63, 64, 65, 127, 128, 1000, 12345, 10**9]
    got = {r.v: r.b for r in spark.createDataFrame([(v,) for v in values], "v long").select("v", rules.bucket(rules.F.col("v")).alias("b")).collect()}
    for v in values:
        drop = max(v.bit_length() - 6, 0)
        assert got[v] == v >> drop << drop


def quantile(values, num, den):
    return sorted(values)[-(-len(values) * num // den) - 1]


def in_buckets(values):
    return [v >> max(v.bit_length() - 6, 0) << max(v.bit_length() - 6, 0) for v in values]


def cut_off(group, metric, times=1):
    """``group``: counts of documents."""
    counted, of = rules.METRICS[metric]
    ratios, sizes = in_buckets([c[counted] * 10**6 // max(c[of], 1) for c in group]), in_buckets([c[of] for c in group])
    share, reach, size = rules.HIGH[metric]
    median, high = quantile(ratios, 1, 2), quantile(ratios, share, 100)
    return high + times * reach * max(high - median, 10**6 // max(quantile(sizes, size, 100), 1))


def slow_verdicts(docs, min_group, limits=None):
    """Verdicts with thresholds from the sorted ratios themselves, cut to six binary digits; ``limits`` collects those."""
    rows = []
    for i, text, lang, source in docs:
        c = dict(zip(rules.COUNTS, rules.counts((text or "").encode()), strict=True))
        base = c["n_words"] >= 20 and 100 * c["n_repeat_words"] <= 30 * c["n_words"]
        rows.append((i, lang, source, base, c))
    out, limits = {}, {} if limits is None else limits
    for i, lang, source, base, c in rows:
        for m in rules.METRICS if base else ():
            if (lang, source, m) not in limits:
                own = [r[4] for r in rows if r[3] and r[1:3] == (lang, source)]
                language = [r[4] for r in rows if r[3] and r[1] == lang]
                every = [r[4] for r in rows if r[3]]
                most = bound = cut_off(every, m, 2)
                near = cut_off(every, m)
                if len(language) >= min_group:
                    near, bound = min(cut_off(language, m), most), min(cut_off(language, m, 2), most)
                limits[lang, source, m] = min(cut_off(own, m), bound) if len(own) >= min_group else near
        out[i] = base and all(c[a] * 10**6 // max(c[b], 1) <= limits[lang, source, m] for m, (a, b) in rules.METRICS.items())
    return out


def test_documents_and_filter(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path)
    given = duckdb.sql(f"select doc_id, text, lang, source from '{path}'").fetchall()
    for least in (100, 15):
        want = slow_verdicts(given, least)
        rows = {r.doc_id: r for r in rules.quality_verdicts(docs, least).collect()}
        assert {i: r.kept for i, r in rows.items()} == want
        kept = rules.keep_quality(docs, least)
        assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {i for i, k in want.items() if k}
    for i, text, *_ in given:
        assert (rows[i].n_words, rows[i].word_chars, rows[i].n_symbols, rows[i].n_dup_lines, rows[i].n_repeat_words) == slow(text)


def test_labelled_documents(spark):
    """Rejected: nearly all bad documents; kept: nearly all good ones. No fixed cut-offs give these verdicts."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    judged = rules.saved(rules.quality_verdicts(docs).join(docs.select("doc_id", "lang", "source"), "doc_id"), "judged")
    counts = {(r.quality, r.kept): r["count"] for r in judged.join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    good, bad = counts[1, True] / (counts[1, True] + counts.get((1, False), 0)), counts[0, False] / (counts[0, False] + counts.get((0, True), 0))
    assert good > 0.96 and bad > 0.95, counts
    for m in rules.METRICS:
        groups = [r[f"most_{m}"] for r in judged.filter("not base_failed").select("lang", "source", f"most_{m}").distinct().collect()]
        assert len(set(groups)) > 5, m
    share = f"n_repeat_words * {rules.WHOLE} div n_words"
    over = judged.filter(f"not base_failed and {share} > most_repeats").selectExpr(f"min({share})").first()[0]
    kept = judged.filter("kept").selectExpr(f"max({share})").first()[0]
    assert over < kept  # one is a fault in its group, a higher one none in its own


def text(k, capitals):
    """40 words of 10 letters with ``capitals`` per mille of capital letters."""
    letters = "".join(random.Random(k).choices("abcdefghij", k=400))
    letters = letters[: capitals * 4 // 10].upper() + letters[capitals * 4 // 10 :]
    return " ".join(letters[i : i + 10] for i in range(0, 400, 10))


def test_the_sketch_decides(spark):
    """190 per mille capitals are far over a norm of 20 and no fault where the source often has 100; junk doesn't raise its own cut."""
    rows = [(100 + k, text(k, 20), "en", "plain") for k in range(4000)] + [(5000 + k, text(k, 50 if k % 3 else 100), "en", "loud") for k in range(150)]
    rows += [(6000 + k, text(k, 900 if k % 2 else 20), "en", "junk") for k in range(30)]
    rows += [(1, text(1, 190), "en", "plain"), (2, text(2, 190), "en", "loud")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in rules.quality_verdicts(docs).collect()}
    assert not kept[1] and kept[2]
    assert not any(kept[6000 + k] for k in range(1, 30, 2)) and all(kept[6000 + k] for k in range(0, 30, 2))


def test_thresholds_follow_the_sizes(spark):
    """Without spread, three symbols in a document of a group's usual size are no fault yet, whatever that size: no fixed ratio decides."""
    words = lambda n, k: " ".join(f"word{(i * 7919 + k) % 9973}" for i in range(n))
    rows = [(k, words(40, k), "en", "short") for k in range(400)] + [(1000 + k, words(4000, k), "en", "long") for k in range(400)]
    rows += [(5000, words(40, 1) + " # #", "en", "short"), (5001, words(40, 1) + " #" * 9, "en", "short"), (5002, words(4000, 1) + " #" * 2, "en", "long"), (5003, words(4000, 1) + " #" * 9, "en", "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    judged = {r.doc_id: (r.kept, r.most_symbols) for r in rules.quality_verdicts(docs).collect()}
    assert [judged[5000 + k][0] for k in range(4)] == [True, False, True, False]
    assert judged[5000][1] > 50 * judged[5002][1]


def test_rows(spark):
    good = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame(
        [(1, None, None, None, 1), (2, "", "en", None, 2), (3, good, None, "s", 3), (3, good, None, "s", 3), (None, good, "en", "s", 4)],
        "doc_id long, text string, lang string, source string, most_symbols int",
    )
    assert sorted((r.doc_id or 0, r.kept) for r in rules.quality_verdicts(docs).collect()) == [(0, True), (1, False), (2, False), (3, True), (3, True)]
    assert sorted((r.doc_id or 0) for r in rules.keep_quality(docs).collect()) == [0, 3, 3]
    assert rules.quality_verdicts(docs.limit(0)).count() == 0 and rules.keep_quality(docs.limit(0)).count() == 0


def test_very_long_texts_and_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(400_000))
    names = [*rules.COUNTS, "row", "kept", "base_failed", "lang_", "source_", "most_upper", "metric"]
    docs = spark.createDataFrame([(1, long, "en", "s", *names), (2, long + " " + long, "en", "s", *names)], "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    assert {r.doc_id: (r.n_words, r.n_repeat_words, r.kept) for r in rules.quality_verdicts(docs).collect()} == {1: (400_000, 0, True), 2: (800_000, 800_000, False)}
    kept = rules.keep_quality(docs)
    assert kept.schema == docs.schema and [tuple(r) for r in kept.collect()] == [(1, long, "en", "s", *names)]
