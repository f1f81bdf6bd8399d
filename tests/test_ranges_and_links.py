"""Windows spread over ranges, Link headers, written tables of a scope."""

import os
import random

import pytest

from tidemark import scratch
from tidemark.functions import text
from tidemark.functions.text import F
from tidemark.operators import layout


def slow_frames(rows, warm_up, longest, keep):
    out = {}
    for kind in {k for k, _, _ in rows}:
        own = sorted((at, i) for k, i, at in rows if k == kind)
        used = [(i, at - before) for (before, _), (at, i) in zip(own, own[1:], strict=False) if at - own[0][0] >= warm_up and at - before < longest]
        for n, (i, delta) in enumerate(used):
            last = [d for _, d in used[max(0, n + 1 - keep) : n + 1]]
            out[i] = (kind, delta, sum(last) / len(last))
    return out


def test_recent_frames_in_small_ranges(spark):
    rng = random.Random(1)
    rows = [("ab"[rng.random() < 0.2], i, rng.randrange(4000)) for i in range(700)]
    frames = spark.createDataFrame(rows, "kind string, i long, at long")
    for size in (20, 64, 100_000):
        got = {r.i: (r.kind, r.delta, r.mean) for r in layout.recent_frames(frames, 100, 30, 20, size).collect()}
        assert got == slow_frames(rows, 100, 30, 20), size
    with pytest.raises(ValueError):
        layout.recent_frames(frames, keep=100, size=50)


def test_last_page_of_a_link_header(spark):
    rows = [
        ('<https://x/y?page=2>; rel="next", <https://x/y?page=7&per=1>; rel="last"', 7),
        ('<https://x/y?per=1&page=9>; title="a, b"; rel=last', 9),
        ('<https://x/y?page=4>; REL="prev last"; hreflang=en, <https://x/?page=5>; rel="first"', 4),
        ('<https://x/y?page=3>; rel="lastly"', 30),
        ('<https://x/y?perpage=3>; rel="last"', 30),
        ("", 30),
        (None, 30),
    ]
    frame = spark.createDataFrame(rows, "link string, pages long")
    assert all(r.pages == r.got for r in frame.withColumn("got", text.page_count(F.col("link"), F.lit(30))).collect())
    assert frame.select(text.page_count(F.col("link"), F.lit(0)).alias("n")).distinct().collect()[0].n == 0


def test_compatible(spark):
    frame = spark.createDataFrame([("　a﻿  b\xa0\n",), ("\t x  y ",), (None,), ("ﬁ",)], "t string")
    assert [r.t for r in frame.select(text.compatible(F.col("t")).alias("t")).collect()] == ["a b", "x y", None, "fi"]


def test_scope_deletes_what_was_made_inside(spark):
    outside = scratch.saved(spark.range(3), "outside")
    with scratch.scope(spark):
        inside = scratch.saved(spark.range(3), "inside")
        files = [f.removeprefix("file://") for f in inside.inputFiles()]
        assert files and all(map(os.path.exists, files))
    assert not any(map(os.path.exists, files)) and outside.count() == 3
