"""License scan: winnowed template fingerprints, then banded alignment of the candidates.

Texts are words in lower case without punctuation. From every template, 5-word shingles are hashed and
the least hash of each window of 4 is kept; the inverted index maps these fingerprints to places in
templates. All shingles of a text are looked up, so a passage that shares a kept shingle is never
missed by an unlucky window. Five words in a row must be the template's: a statement of five to eight
words names its license in one of them, and another word there is another license. Hits on nearby diagonals make a candidate, and a banded alignment of
the whole template with the text around it gives the matched words and their span.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_batch, id_text

SHINGLE, WINDOW = 5, 4
#: A match covers at least this part of a template's words.
COVERAGE = 0.8

#: Public notices and statements, by name. A parameter: any mapping of names to texts will do.
TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "MIT-statement": "Released under the MIT License.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "BSD-statement": "Released under the BSD License.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You "
        "may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "Apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "GPL-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-statement": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-statement": "Licensed under CC BY 4.0.",
    "CC-BY-SA-statement": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-statement": "Licensed under CC BY-NC 4.0.",
    "CC0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}

#: All but ASCII letters, digits and bytes of other scripts separates words.
_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
_FACTOR = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def words_of(raw: bytes) -> list[bytes]:
    return raw.lower().translate(_TABLE).split()


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """A hash of every SHINGLE words."""
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(1)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = (out ^ (h[k : k + n] * _FACTOR[k])) * _FACTOR[0]
    return out ^ (out >> np.uint64(32))


def winnowed(hashes: np.ndarray) -> list[int]:
    """Places of the least hash (the last of equals) of each WINDOW hashes."""
    n = max(len(hashes) - WINDOW + 1, min(len(hashes), 1))
    kept = {i + len(w) - 1 - int(np.argmin(w[::-1])) for i in range(n) if len(w := hashes[i : i + WINDOW])}
    return sorted(kept)


class Index:
    """The inverted index of a set of templates; its size follows theirs."""

    def __init__(self, templates: dict[str, str]):
        self.words = {name: words_of(text.encode()) for name, text in templates.items()}
        if short := [name for name, words in self.words.items() if len(words) < SHINGLE]:
            raise ValueError(f"templates of under {SHINGLE} words: {short}")
        places = defaultdict(list)
        for name, words in self.words.items():
            hashes = shingle_hashes(words)
            for i in winnowed(hashes):
                places[int(hashes[i])].append((name, i))
        self.places = dict(places)
        self.keys = np.sort(np.array(list(places), np.uint64))

    def candidates(self, words: list[bytes]) -> list[tuple[str, int]]:
        """(template, place in the text where it would begin), one for each group of nearby diagonals."""
        hashes = shingle_hashes(words)
        if not len(hashes):
            return []
        at = np.searchsorted(self.keys, hashes)
        hits = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == hashes)
        starts = defaultdict(set)
        for i in hits.tolist():
            for name, j in self.places[int(hashes[i])]:
                starts[name].add(i - j)
        out = []
        for name, found in starts.items():
            reach, last = band(len(self.words[name])), None
            for d in sorted(found):
                if last is None or d - last > reach:
                    out.append((name, d))
                    last = d
        return out


def band(n: int) -> int:
    """Words that a text may have more or fewer than a template of ``n`` words."""
    return max(2, n // 4)


def align(template: list[bytes], words: list[bytes], start: int) -> tuple[int, int, int]:
    """(matched words, first, last matched word) of the best alignment within ``band`` of ``start``.

    Most matches, then the fewest words between the first and the last: row by row over the template,
    each cell holds (matches, minus the first matched word, last matched word) for texts up to a word.
    """
    reach = 2 * band(len(template))
    low, row = start - reach, {}
    none = (0, 0, -1)
    for i, word in enumerate(template):
        new = {}
        left = none
        for d in range(2 * reach + 1):
            j = low + i + d
            if not 0 <= j < len(words):
                continue
            best = max(row.get(j, none), left, key=lambda c: (c[0], c[1] - c[2]))
            if words[j] == word:
                n, first, _ = row.get(j - 1, none)
                taken = (n + 1, first if n else -j, j)
                best = max(best, taken, key=lambda c: (c[0], c[1] - c[2]))
            new[j] = left = best
        if new:
            edge = max(new)  # the next row may look one word further
            new[edge + 1] = new[edge]
            row = new
    n, first, last = max(row.values(), key=lambda c: (c[0], c[1] - c[2]), default=none)
    return n, -first, last


@lru_cache(8)
def index_of(templates: tuple[tuple[str, str], ...]) -> Index:
    """One for each set of templates in a worker."""
    return Index(dict(templates))


def find_licenses(text: str, index: Index) -> list[tuple[str, int, int, int, int]]:
    """(name, start, end, matched, words in template), by start; code points, end exclusive.

    Of overlapping matches the one with most matched words stays, then the higher coverage, then the
    first name.
    """
    words = words_of(text.encode())
    if not (candidates := index.candidates(words)):
        return []
    found = set()
    for name, start in candidates:
        n, first, last = align(index.words[name], words, start)
        if n >= COVERAGE * len(index.words[name]):
            found.add((name, first, last, n, len(index.words[name])))
    spans = [m.span() for m in _WORD.finditer(text)]
    kept, taken = [], []  # spans that don't overlap, in order
    for name, first, last, n, total in sorted(found, key=lambda f: (-f[3], -f[3] / f[4], f[0], f[1])):
        k = bisect_right(taken, last, key=lambda t: t[0])  # the nearest span that begins at ``last`` or before
        if not k or taken[k - 1][1] < first:
            taken.insert(k, (first, last))
            kept.append((name, spans[first][0], spans[last][1], n, total))
    return sorted(kept, key=lambda k: k[1])


MATCHES = "array<struct<license:string,start:int,end:int,matched:int,words:int>>"


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id and ``matches``, one row for each row of ``docs``; null and empty texts have none, and no documents give no rows.

    Ids are whole numbers here as in all operators (a text that isn't one is an error of Spark's cast); null ids stay null.
    """
    given = tuple(templates.items())
    item = pa.struct([("license", pa.string()), *((c, pa.int32()) for c in ("start", "end", "matched", "words"))])
    schema = pa.schema([("doc_id", pa.int64()), ("matches", pa.list_(item))])

    def scan(batch: pa.RecordBatch) -> dict:
        names = item.names
        found = [[dict(zip(names, m, strict=True)) for m in find_licenses(t, index_of(given))] for t in batch["text"].to_pylist()]
        return {"doc_id": batch["doc_id"], "matches": found}

    return id_text(docs).mapInArrow(by_batch(scan, schema), f"doc_id long, matches {MATCHES}")


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_matches, licenses, best coverage (null without a match) and the spans as name:start:end:matched:words."""
    text = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"], m["end"], m["matched"], m["words"]))
    return scan_licenses(docs).select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        F.array_max(F.transform("matches", lambda m: m["matched"] / m["words"])).alias("coverage"),
        F.array_join(text, ",").alias("spans"),
    )
