import random
import time

from tidemark.llm import licenses

INDEX = licenses.Index(licenses.TEMPLATES)


def names(text):
    return [m[0] for m in licenses.find_licenses(text, INDEX)]


def test_every_template_is_found_whole():
    for name, text in licenses.TEMPLATES.items():
        padded = f"Some words before. {text} And some after."
        (found, start, end, matched, words), *more = licenses.find_licenses(padded, INDEX)
        assert not more and found == name and matched == words
        assert licenses.words_of(padded[start:end].encode()) == INDEX.words[name]


def lcs(a, b):
    """Longest common subsequence, over whole texts."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_edited_templates_against_whole_alignment():
    rng = random.Random(5)
    for _ in range(150):
        name = rng.choice([n for n, w in INDEX.words.items() if len(w) >= 20])
        words = list(INDEX.words[name])
        for _ in range(rng.randint(0, len(words) // 10)):
            k = rng.randrange(len(words))
            match rng.randint(0, 2):
                case 0:
                    words[k] = b"other"
                case 1:
                    del words[k]
                case _:
                    words.insert(k, b"extra")
        text = b" ".join([b"before"] * rng.randint(0, 30) + words + [b"after"] * rng.randint(0, 30)).decode()
        found = [m for m in licenses.find_licenses(text, INDEX) if m[0] == name]
        if found:
            assert found[0][3] == lcs(INDEX.words[name], words)
        else:
            near = [m for m in licenses.find_licenses(text, INDEX)]
            assert near or lcs(INDEX.words[name], words) < 0.8 * len(INDEX.words[name])


def test_clean_text_and_fragments():
    assert names("The license of this permission is hereby a word list without any notice in it.") == []
    assert names("released under the MIT") == []
    assert names("RELEASED under   the\nMIT license! " * 3) == ["MIT-statement"] * 3
    assert names("") == []


def test_many_notices_in_one_text():
    """4,000 notices, and as many that overlap: time in proportion, none lost."""
    text = "Released under the MIT License. " * 4000 + "word " * 300_000
    begin = time.monotonic()
    assert names(text) == ["MIT-statement"] * 4000
    assert time.monotonic() - begin < 10


def test_overlaps_keep_the_best():
    both = licenses.TEMPLATES["GPL-3.0-statement"] + " " + licenses.TEMPLATES["GPL-2.0-statement"]
    assert names(both) == ["GPL-3.0-statement", "GPL-2.0-statement"]


def test_rows(spark):
    line = licenses.TEMPLATES["GPL-3.0-statement"]
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "é " + line, 3), (3, "é " + line, 4), (None, "plain", 5)], "doc_id long, text string, matches int")
    rows = licenses.license_report(docs).collect()
    assert sorted((r.doc_id or 0, r.n_matches, r.spans) for r in rows) == [(0, 0, ""), (1, 0, ""), (2, 0, ""), *[(3, 1, f"GPL-3.0-statement:2:{1 + len(line)}:12:12")] * 2]
    assert licenses.license_report(docs.limit(0)).count() == 0
