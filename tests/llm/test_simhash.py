import random
import re

import duckdb
import numpy as np
import xxhash

from tidemark.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    """Smallest id reachable over links of 4 bits or fewer."""
    ids = list(prints)
    fp = np.array([prints[i] for i in ids], np.uint64)
    left, out = set(range(len(ids))), {}
    while left:
        front, group = [left.pop()], []
        while front:
            k = front.pop()
            group.append(k)
            near = [j for j in left if int(fp[j] ^ fp[k]).bit_count() <= 4]
            left.difference_update(near)
            front += near
        for k in group:
            out[ids[k]] = min(ids[g] for g in group)
    return out


def report(docs, **more):
    return {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs, **more).collect()}


def test_every_difference_within_the_radius_is_covered():
    rng = random.Random(2)
    for masks in (simhash.MASKS, *simhash.INNER):
        free = [p for p in range(64)] if masks is simhash.MASKS else None
        if free is None:
            outer = simhash.MASKS[simhash.INNER.index(masks)]
            free = [p for p in range(64) if not outer >> p & 1]
        for _ in range(300):
            flips = sum(1 << p for p in rng.sample(free, rng.randint(0, 4)))
            assert any(flips & m == 0 for m in masks)
        assert all(10 <= (m % 2**64).bit_count() <= 36 for m in masks)


def test_fingerprints():
    for text in ("", " \n", "one", "ONE two", "a b c", "a b c d", "A b  c\td e É ß", "x y " * 50, "ÀB\x0bC\x0cD\x85E F G"):
        assert simhash.fingerprint(text.encode()) % 2**64 == slow_fingerprint(text)


def test_documents(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    texts = dict(duckdb.sql(f"select doc_id, text from '{path}'").fetchall())
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    comps = slow_components(prints)
    assert report(spark.read.parquet(path)) == {i: (prints[i], comps[i]) for i in texts}


def test_dense_balls_and_chains(spark):
    """Fingerprints given directly; small buckets force the second covering."""
    rng = random.Random(4)
    prints = {}
    for start in (0, (1 << 64) - 1, 0x0123456789ABCDEF):
        at = start
        for _ in range(60):
            for p in rng.sample(range(64), rng.randint(0, 3)):
                at ^= 1 << p
            prints[rng.randrange(10**9)] = at
        for _ in range(150):
            prints[rng.randrange(10**9)] = start ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 4)))
    for _ in range(100):
        prints[rng.randrange(10**9)] = rng.getrandbits(64)
    signed = [(fp - (1 << 64) if fp >> 63 else fp, i) for i, fp in prints.items()]
    classes = spark.createDataFrame(signed, "fp long, node long").groupBy("fp").agg(simhash.F.min("node").alias("node"))
    want, ids = slow_components(prints), {r.fp: r.node for r in classes.collect()}
    for bucket in (10_000, 8):
        root = {fp: fp for fp in ids} | {r.node: r.component for r in simhash.components(simhash.links(classes, bucket)).collect()}
        least = {}
        for fp, r in root.items():
            least[r] = min(least.get(r, ids[fp]), ids[fp])
        assert {i: least[root[fp]] for fp, i in ids.items()} == {i: want[i] for i in ids.values()}


def test_long_paths_and_hubs(spark):
    rng = random.Random(9)
    path = rng.sample(range(1000), 300)
    pairs = list(zip(path, path[1:], strict=False)) + [(2000, 2000 + k) for k in range(1, 400)] + [(3000, 2400), (5001, 5000)]
    edges = spark.createDataFrame([(max(p), min(p)) for p in pairs], "u long, v long")
    want = {k: min(path) for k in path} | {k: 2000 for k in (*range(2000, 2400), 2400, 3000)} | {5000: 5000, 5001: 5000}
    want[2400] = want[3000] = 2400  # not among the hub's nodes
    got = {r.node: r.component for r in simhash.components(edges).collect()}
    assert got == want


def test_rows(spark):
    docs = spark.createDataFrame(
        [(9, None, 1), (4, "", 2), (7, "some words that are here to be read again", 3), (5, "Some words THAT are here to be read again", 4), (7, "some words that are here to be read again", 3), (None, "Some words that are here to be read again", 6), (None, "alone " * 9, 7)],
        "doc_id long, text string, component_id int",
    )
    found = simhash.fingerprint_report(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == [(0, 0), (0, 5), (4, 4), (5, 5), (7, 5), (7, 5), (9, 4)]
    assert {r.fingerprint for r in found if r.doc_id in (4, 9)} == {"0" * 16}
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 4, 5]
    twice = docs.filter("doc_id = 7")
    assert simhash.drop_near_duplicates(twice).count() == 1
    assert simhash.fingerprint_report(docs.limit(0)).count() == 0 and simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_an_id_with_several_texts(spark):
    """Id 7 has two texts; their components stay apart, and each keeps a document."""
    rng = random.Random(3)
    one, two = (" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(400)) for c in "ab")
    long = " ".join(f"w{i}" for i in range(300_000))
    docs = spark.createDataFrame([(7, one), (7, two), (8, one), (6, two), (9, long), (10, long), (7, one)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()) == [(6, 6), (7, 6), (7, 7), (7, 7), (8, 7), (9, 9), (10, 9)]
    assert sorted((r.doc_id, r.text) for r in simhash.drop_near_duplicates(docs).collect()) == sorted([(7, one), (6, two), (9, long)])


def test_clashing_names(spark):
    names = ["row", "hash", "fp", "root", "component_id", "first", "n", "node", "table", "key"]
    docs = spark.createDataFrame([(2, "a b c d e", *names), (1, "a b c d e", *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.schema == docs.schema and [r.doc_id for r in kept.collect()] == [1]
    assert [r.component_id for r in simhash.fingerprint_report(docs).collect()] == [1, 1]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_bucket_is_broadcast(spark, monkeypatch):
    """A table of 31 rows a class is taken to be as small as the classes; it stays out of the driver all the same."""
    plans, write = {}, simhash.saved
    monkeypatch.setattr(simhash, "saved", lambda df, name: write(df, name) if plans.setdefault(name, plan_of(df)) else None)
    docs = spark.createDataFrame([(k, f"word{k % 5} and {k % 3} others") for k in range(40)], "doc_id long, text string")
    assert simhash.drop_near_duplicates(docs).count() > 0
    assert "Generate explode" in plans["buckets"] and "SortMergeJoin" in plans["buckets"] and "Broadcast" not in plans["buckets"]


def test_many_ids_are_not_broadcast(spark, monkeypatch):
    """Ids of copies are a small file and many rows: by their number they are joined by sorting."""
    docs = spark.createDataFrame([(k // 2, "one text for all of them") for k in range(40)] + [(50, "another text that is alone")], "doc_id long, text string")
    few = simhash.drop_near_duplicates(docs)
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0, raising=False)
    many = simhash.drop_near_duplicates(docs)
    assert "Broadcast" in plan_of(few) and "SortMergeJoin" in plan_of(many) and "Broadcast" not in plan_of(many)
    assert sorted(few.collect()) == sorted(many.collect()) == sorted(docs.filter("doc_id in (0, 50)").distinct().collect())


def test_fingerprints_of_all_documents_are_not_broadcast(spark):
    docs = spark.createDataFrame([(k, "one text for all of them") for k in range(40)], "doc_id long, text string")
    found = simhash.fingerprint_report(docs)
    assert "SortMergeJoin" in plan_of(found).partition("BroadcastHashJoin")[0]
    assert {r.component_id for r in found.collect()} == {0} and found.count() == 40
