"""License notices found by patience alignment.

A template is anchored in a text on the words that occur once in both; the longest increasing subsequence of anchors is
kept, and the gaps between them are aligned the same way, down to equal words at the edges of a gap. The share of the
template's words that are matched is its coverage; from ``min_coverage`` on it is reported with its place in the text.

A text may hold a template more than once, and words that are rare in a notice are common in a long text. So anchoring
looks at stretches of the text: each distinctive word of a template that occurs in the text proposes where the template
would begin, and proposals that agree are aligned in a window of the template's length with a margin.

Rows are independent: one pass over whole texts, no shuffle. Templates are a fixed list of known size.

Defined results: null and empty texts hold nothing; all occurrences are reported, overlapping ones of several templates
too unless a longer match covers them; ties go to the longer template, then by name; repeated rows give a row each; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

MIN_COVERAGE = 0.8
_WORD = re.compile(r"[^\W_]+")

# Texts of public licenses and their usual short notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software"
        " without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit"
        " persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies"
        " or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\""
        " BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either"
        " version 3 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must"
        " retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of"
        " conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its"
        " contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this"
        " permission notice appear in all copies.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Words that propose no place: they are common in any English text.
_COMMON = frozenset("a above all an and any are as at be by for free from general in is it may must no not of on or other that the this to under use v version with without work you your".split())


def _lis(pairs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, in order of the first number, in which the second goes up too."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back.append(at[k - 1] if k else -1)
        tops[k:], at[k:] = [b, *tops[k + 1 :]], [i, *at[k + 1 :]]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(template: Sequence[str], text: Sequence[str]) -> list[tuple[int, int]]:
    """Matched places (in template, in text), both ascending."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(template), 0, len(text))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and template[a] == text[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and template[b - 1] == text[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        left, right = Counter(template[a:b]), Counter(text[c:d])
        where = {w: i for i, w in enumerate(text[c:d], c) if right[w] == 1}
        anchors = _lis([(i, where[w]) for i, w in enumerate(template[a:b], a) if left[w] == 1 and w in where])
        if not anchors:
            continue
        out += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


@lru_cache(4)
def _compiled(templates: tuple[tuple[str, str], ...]):
    """(name, words, number of distinctive words) of each template; word -> (template, place)."""
    made, seeds = [], defaultdict(list)
    for t, (name, text) in enumerate(templates):
        words = _WORD.findall(text.lower())
        once = Counter(words)
        own = [i for i, w in enumerate(words) if once[w] == 1 and w not in _COMMON]
        made.append((name, words, len(own)))
        for i in own:
            seeds[words[i]].append((t, i))
    return made, dict(seeds)


def scan(text: str | None, min_coverage: float = MIN_COVERAGE, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[tuple[str, float, int, int]]:
    """(license, coverage, start, end) of each notice in the text, by place; offsets in code points."""
    made, seeds = _compiled(templates)
    low = (text or "").lower()
    same = len(low) == len(text or "")
    found = [(m[0], m.start(), m.end()) for m in _WORD.finditer(low if same else text)] if text else []
    words = [w if same else w.lower() for w, _, _ in found]
    if not seeds.keys() & set(words):
        return []
    starts = defaultdict(list)
    for p, w in enumerate(words):
        for t, i in seeds.get(w, ()):
            starts[t].append((p - i, i))
    hits = []
    for t, proposed in starts.items():
        name, template, own = made[t]
        slack = max(3, len(template) // 4)
        proposed.sort()
        k = 0
        while k < len(proposed):
            j, marks = k, set()
            while j < len(proposed) and proposed[j][0] <= proposed[k][0] + slack:
                marks.add(proposed[j][1])
                j += 1
            if len(marks) >= max(1, own // 2):
                lo = max(0, proposed[k][0] - slack)
                hi = min(len(words), proposed[j - 1][0] + len(template) + slack)
                pairs = align(template, words[lo:hi])
                coverage = len(pairs) / len(template)
                if coverage >= min_coverage and pairs[-1][1] - pairs[0][1] < 2 * len(template):
                    first, last = lo + pairs[0][1], lo + pairs[-1][1]
                    hits.append((found[first][1], found[last][2], name, coverage, len(template)))
                    while j < len(proposed) and proposed[j][0] <= first + slack // 2:
                        j += 1
            k = j
    kept: list[tuple[int, int, str, float, int]] = []
    for h in sorted(set(hits), key=lambda h: (-(h[4] * h[3]), -h[3], h[2], h[0])):
        if all(h[1] <= o[0] or h[0] >= o[1] for o in kept):
            kept.append(h)
    return [(h[2], h[3], h[0], h[1]) for h in sorted(kept)]


def scan_documents(docs: DataFrame, min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row for each row of ``docs``: id, license (best covered; null if none), coverage, n_notices, notices."""
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [scan(x.as_py(), min_coverage, templates) for x in b.column(1)]
            best = [max(g, key=lambda h: (h[1], -h[2]), default=(None, 0.0)) for g in got]
            columns = [
                b.column(0),
                pa.array([x[0] for x in best], pa.string()),
                pa.array([x[1] for x in best], pa.float64()),
                pa.array([len(g) for g in got], pa.int64()),
                pa.array([[dict(zip(("license", "coverage", "start", "end"), h, strict=True)) for h in g] for g in got], kind),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "license", "coverage", "n_notices", "notices"])

    schema = f"`{id_col}` long, license string, coverage double, n_notices long, notices array<struct<license:string,coverage:double,start:long,end:long>>"
    return map_arrow(docs.select(F.col(id_col).cast("long"), text_col), run, schema)
