import random
from collections import Counter, defaultdict

import pytest

from tidemark.llm import mixing


def lags(runs, blocks, shares):
    """For each source without end in sight, how far it is ahead of and behind its share, whenever a block begins or ends."""
    given, ahead, behind = [0] * len(blocks), [0.0] * len(blocks), [0.0] * len(blocks)
    total = [sum(b) for b in blocks]
    for i, k, clock, _, _ in runs:
        for now in (clock, clock + blocks[i][k]):
            if now > clock:
                given[i] += blocks[i][k]
            for j, share in enumerate(shares):
                if given[j] < total[j]:
                    ahead[j] = max(ahead[j], given[j] - share * now)
                    behind[j] = max(behind[j], share * now - given[j])
    return ahead, behind


def test_every_source_is_less_than_one_block_off():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 9)
        blocks = [[rng.randint(1, rng.choice([3, 40, 1000])) for _ in range(rng.randint(0, 30))] for _ in range(n)]
        weights = [rng.choice([1, 1, 2, 0.1, 30]) for _ in range(n)]
        shares = [w / sum(weights) for w in weights]
        runs = mixing.schedule(blocks, shares)
        assert sorted((i, k) for i, k, *_ in runs) == [(i, k) for i, b in enumerate(blocks) for k in range(len(b))]
        largest, end = max([0, *(x for b in blocks for x in b)]), 0
        for i, k, clock, release, deadline in runs:
            assert clock >= end and release <= clock and clock + blocks[i][k] <= deadline + largest + 1
            assert abs(release * shares[i] - sum(blocks[i][:k])) < 1e-6 and abs(deadline * shares[i] - sum(blocks[i][: k + 1])) < 1e-6
            end = clock + blocks[i][k]
        for b, ahead, behind in zip(blocks, *lags(runs, blocks, shares), strict=True):
            assert ahead <= max([0, *b]) + 1 and behind <= largest + 1  # the clock is a whole number


def test_blocks_are_packed():
    rng = random.Random(5)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 7, 30, 200]) for _ in range(rng.randint(0, 60))]
        of = mixing.packed(sizes, 50)
        held = Counter()
        for size, k in zip(sizes, of, strict=True):
            held[k] += size
        assert of == sorted(of) and set(of) == set(range(len(held)))
        assert all(held[k] <= 50 or [s for s, b in zip(sizes, of) if b == k and s] == [held[k]] for k in held)
        assert all(held[k] + sizes[of.index(k + 1)] > 50 for k in range(len(held) - 1))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_every_prefix_keeps_to_the_shares(spark, sf):
    """Whole tables, default settings, all documents: after each document, every source that isn't finished is less than one block off."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = mixing.mix(docs).orderBy(*mixing.order(), "doc_id").collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    sizes, held, share, clock = Counter(), Counter(), {}, {}
    for r in rows:
        sizes[r.source] += r.size
        held[r.slot] += r.size
        share[r.source], clock[r.slot] = r.share, r.clock
    weight = {s: max(n, 1) ** mixing.TEMPERATURE for s, n in sizes.items()}
    assert all(abs(share[s] - w / sum(weight.values())) < 1e-9 for s, w in weight.items())
    block, given, inside, now = max(held.values()), Counter(), Counter(), 0
    assert block <= max(mixing.BLOCK, *(r.size for r in rows)) and len({r.source for r in rows[: len(rows) // 4]}) == len(sizes)
    most = 0
    for r in rows:
        given[r.source] += r.size
        inside[r.slot] += r.size
        now = clock[r.slot] + inside[r.slot]
        most = max([most, *(abs(given[s] - share[s] * now) for s in sizes if given[s] < sizes[s])])
    assert most < block


def test_given_weights_and_places(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "text", "case when doc_id % 5 = 0 then null else concat('s', doc_id % 3) end source")
    rows = mixing.mix(docs, {"s0": 5.0, "s1": 3.0, "s2": 1.0, None: 1.0}, 5000).collect()
    assert {r.source: round(r.share, 9) for r in rows} == {"s0": 0.5, "s1": 0.3, "s2": 0.1, None: 0.1}
    slots = defaultdict(set)
    for r in rows:
        slots[r.slot].add((r.source, r.block))
    assert all(len(x) == 1 for x in slots.values()) and set(slots) == set(range(len(slots)))
    for source in {r.source for r in rows}:
        own = [(r.hash % 2**64 >> 1, r.block, r.slot) for r in rows if r.source == source]
        by_hash = sorted(own)
        assert [b for _, b, _ in by_hash] == sorted(b for _, b, _ in own) and [s for *_, s in by_hash] == sorted(s for *_, s in own)


def test_mix_keeps_rows_and_their_order(spark):
    rows = [(i, None if i % 7 == 0 else "x " * (i % 50), None if i % 5 == 0 else "ab"[i % 2], i) for i in range(500)] + [(3, "same", "a", 1)] * 4 + [(None, "no id", "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, slot long")
    out = mixing.mixed_documents(docs, block=200)
    assert out.columns == docs.columns
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, out.collect())) == sorted(map(key, rows))
    again = mixing.mix(docs, {"a": 3.0, "b": 1.0, None: 1.0}, 200)
    assert again.count() == len(rows) and {r.size for r in again.collect()} == {len(r[1] or "") for r in rows}


def test_texts_are_not_shuffled_for_the_report(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert "text" not in plan and "Exchange hashpartitioning" not in plan


def test_unknown_source_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "t", "a")], "doc_id long, text string, source string")
    try:
        mixing.mix(docs, {"b": 1.0})
        raise AssertionError
    except ValueError:
        pass
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
