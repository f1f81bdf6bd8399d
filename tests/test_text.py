"""White space of all scripts, canonical JSON, the order of names."""

import json
import math
import random
import struct
from datetime import date, datetime, timezone
from decimal import Decimal

from pyspark.sql import functions as F

from tidemark.functions import canonical, keywords, text
from tidemark.functions.lexicon import Lexicon
from tidemark.operators import lifecycle

LEXICON = Lexicon()
WIDE = [" ", " ", " ", " ", " ", "　", "﻿", "\x0b", " ", "\t"]


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.o for r in rows.select("k", f(F.col("v")).alias("o")).orderBy("k").collect()]


def test_white_space_of_all_scripts(spark):
    names = [f"{w}machine{w}{w}learning{w}" for w in WIDE]
    assert set(column(spark, names, lambda v: keywords.normalized(v, LEXICON))) == {keywords_of("machine-learning")}
    links = [f"see https://a.b/c?d=e{w}llm agents" for w in WIDE]
    assert column(spark, links, keywords.searchable) == [f"see  {w}llm agents" for w in WIDE]
    found = column(spark, links, lambda v: keywords.text_keywords(v, LEXICON, ("words",)))
    assert all(words == [keywords_of(w) for w in ("see", "llm", "agents")] for words in found)
    assert set(column(spark, [f" a{w} {w}b{w}" for w in WIDE], text.compatible)) == {"a b"}
    assert column(spark, ["a\x85b​c᠎d"], text.compatible) == ["a\x85b​c᠎d"]  # no white space


def keywords_of(word):
    return LEXICON.aliases.get(word, word)


def shown(x):
    """ECMAScript's form of a number, from the fewest digits that tell it apart."""
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    s, n = "".join(map(str, digits)), len(digits) + exponent
    k = len(s)
    if k <= n <= 21:
        out = s + "0" * (n - k)
    elif 0 < n <= 21:
        out = f"{s[:n]}.{s[n:]}"
    elif -6 < n <= 0:
        out = f"0.{'0' * -n}{s}"
    else:
        out = f"{s[0]}{'.' * (k > 1)}{s[1:]}e{'+' if n > 0 else '-'}{abs(n - 1)}"
    return "-" * sign + out


def test_numbers(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 1.0, -1.5, 0.1, 1e-6, 1e-7, 1.5e-7, 123456789.125, 1e20, 1e21, 1.2e21, 2.5e-320, 1.7976931348623157e308, 2.0**53, 0.001, 0.00098, 1e7, 12345678.9, 100.0]
    values += [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(2000)] + [rng.uniform(-1e6, 1e6) for _ in range(500)] + [round(rng.uniform(0, 100), 2) for _ in range(500)]
    got = column(spark, values, canonical.number, "double")
    assert got == [shown(v) if math.isfinite(v) else None for v in values]


def test_texts(spark):
    rng = random.Random(2)
    alphabet = [*map(chr, range(0x80)), "é", " ", "﻿", "日", "😀", "\\", '"', "\\u0001"]
    values = ["", "plain", *("".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(800))]
    assert column(spark, values, canonical.text) == [json.dumps(v, ensure_ascii=False) for v in values]


def test_nested_values(spark):
    kind = "struct<b:bigint,a:array<struct<y:string,x:double>>,m:map<string,boolean>,d:date,t:timestamp,n:decimal(9,2),z:string>"
    row = (7, [("q\n", 0.5), None, (None, 3.0)], {"k2": True, "k1": None}, date(2026, 7, 27), datetime(2026, 7, 27, 1, 2, 3, 450000, timezone.utc), Decimal("12.50"), None)
    df = spark.createDataFrame([(row,), (None,)], f"v {kind}")
    got = [r.o for r in df.select(canonical.json_of(F.col("v"), df.schema["v"].dataType).alias("o")).collect()]
    assert got == ['{"a":[{"x":0.5,"y":"q\\n"},null,{"x":3,"y":null}],"b":7,"d":"2026-07-27","m":{"k1":null,"k2":true},"n":12.5,"t":"2026-07-27T01:02:03.450Z","z":null}', "null"]
    ordered = df.select(canonical.json_of(F.col("v"), df.schema["v"].dataType, by_name=False).alias("o")).first().o
    assert [*json.loads(ordered)] == ["b", "a", "m", "d", "t", "n", "z"]


def test_lists_that_look_alike_have_hashes_of_their_own(spark):
    from tidemark.operators import decisions

    rows = spark.createDataFrame([(1, "d", ["a", "b"]), (2, "d", ["a\nb"]), (3, "d", ['a","b'])], "id long, description string, topics array<string>")
    assert len({r.metadata_hash for r in decisions.cache_keys(rows, "p", "m", "1", "1").collect()}) == 3


def test_order_of_the_log(spark):
    names = ["b/x", "a_b", "a-b", "a.b", "a/b", "A1", "a2", "ab", "Äb", "aB", "AC"]
    rows = spark.createDataFrame([(date(2026, 6, 1), n, 0) for n in reversed(names)] + [(date(2026, 5, 25), "z", 0)], "week date, key string, seq int")
    got = [r.key for r in rows.orderBy(*lifecycle.log_order()).collect()]
    assert got == ["z", "a_b", "a-b", "a.b", "a/b", "A1", "a2", "aB", "ab", "Äb", "AC", "b/x"]
