"""License scans by patience alignment of texts with license templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from heapq import heapify, heappop, heappush
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentry.session import pickle_by_value

#: Notices as licensors publish them, shortest first within a family.
TEMPLATES: dict[str, str] = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit-line": "Released under the MIT License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."),
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."),
    "isc-notice": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
}

#: Share of a template's words that a text must cover.
MIN_COVERAGE = 0.8

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of ``pairs`` (in order of the first) whose second numbers rise."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, second) in enumerate(pairs):
        k = bisect_left(tails, second)
        before[i] = ends[k - 1] if k else -1
        tails[k:k + 1], ends[k:k + 1] = [second], [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def align(text: list[str], template: list[str], open_end: bool = False) -> list[tuple[int, int]]:
    """Pairs (position in text, position in template) of a patience alignment, rising in both.

    Within a range of both, equal words at its two ends are paired; then words that are unique in both ranges are
    anchors, of which the longest increasing run stays, and the gaps between anchors are aligned the same way. A gap
    without anchors gives what its ends gave. With ``open_end`` the text's end is no end of the template's: words there
    are not paired because they are last.
    """
    pairs: list[tuple[int, int]] = []
    ranges = [(0, len(text), 0, len(template))]
    while ranges:
        a, b, c, d = ranges.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1] and not (open_end and b == len(text)):
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        wanted = Counter(template[c:d])
        once = {w for w, n in wanted.items() if n == 1}
        seen: dict[str, int] = {}
        for i in range(a, b):
            w = text[i]
            if w in once:
                seen[w] = -1 if w in seen else i
        anchors = longest_increasing(sorted((seen[template[j]], j) for j in range(c, d)
                                            if seen.get(template[j], -1) >= 0))
        pairs += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        if anchors:
            ranges += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges, edges[1:], strict=False)]
    return sorted(pairs)


class Scanner:
    def __init__(self, templates: dict[str, str], min_coverage: float):
        self.least = min_coverage
        self.templates = [(name, words_of(t)) for name, t in templates.items()]
        self.counts = [Counter(words) for _, words in self.templates]

    def scan(self, text: str | None) -> list[tuple]:
        """(license, coverage, matched words, first and last word) of each place of each template, by first word."""
        words = words_of(text or "")
        have = set(words)
        found = []
        for (name, template), counts in zip(self.templates, self.counts, strict=True):
            if not template:
                continue
            # no alignment can cover more than the words that occur at all
            if sum(n for w, n in counts.items() if w in have) < self.least * len(template):
                continue
            found += [(name, len(pairs) / len(template), len(pairs), pairs[0][0], pairs[-1][0])
                      for pairs in self.places(words, template)]
        return sorted(found, key=lambda f: f[3:])

    def best(self, found: list[tuple]) -> tuple:
        """The place of most words covered; of equal ones that of the template named first, then the first."""
        named = {name: i for i, (name, _) in enumerate(self.templates)}
        return min(found, key=lambda f: (-f[2], named[f[0]], f[3]), default=(None, 0.0, 0, None, None))

    def places(self, words: list[str], template: list[str]) -> list[list[tuple[int, int]]]:
        """Alignments of the template with places of the text that cover enough of it: those of most pairs first, each
        between those before it.

        An alignment that may leave out ``n`` words of the template pairs at least one of any ``n + 1``: it is sought
        from each occurrence of the ``n + 1`` that are rarest in the text, by :func:`grown` to both sides, so it
        depends on the words around and not on where in the text they are.
        """
        size = len(template)
        least = max(1, ceil(self.least * size))
        at: dict[str, list[int]] = {w: [] for w in template}
        for i, w in enumerate(words):
            if w in at:
                at[w].append(i)
        rare = sorted(range(size), key=lambda j: (len(at[template[j]]), j))[:size - least + 1]
        backwards, turned = words[::-1], template[::-1]

        def fit(i: int, j: int, begin: int, end: int) -> list[tuple[int, int]]:
            last = len(words) - 1
            left = grown(backwards, last - i + 1, last - begin + 1, turned, size - j)
            right = grown(words, i + 1, end, template, j + 1)
            pairs = [(last - x, size - 1 - y) for x, y in left[::-1]] + [(i, j), *right]
            return pairs if len(pairs) >= least else []

        waiting: list[tuple] = []
        whole: set[tuple[int, int]] = set()
        for i, j in sorted((i, j) for j in rare for i in at[template[j]]):
            # no alignment through a pair of a whole one is better
            if (i, j) not in whole and (x := fit(i, j, 0, len(words))):
                waiting.append((-len(x), x[-1][0] - x[0][0], x[0][0], i, j, x))
                if len(x) == size:
                    whole.update(x)
        heapify(waiting)
        firsts: list[int] = []
        lasts: list[int] = []
        out = []
        while waiting:
            *_, i, j, pairs = heappop(waiting)
            k = bisect_left(lasts, i)
            if k < len(lasts) and firsts[k] <= i:
                continue
            begin, end = lasts[k - 1] + 1 if k else 0, firsts[k] if k < len(lasts) else len(words)
            if begin <= pairs[0][0] and pairs[-1][0] < end:
                firsts.insert(k, pairs[0][0])
                lasts.insert(k, pairs[-1][0])
                out.append(pairs)
            elif x := fit(i, j, begin, end):  # again, between the places taken
                heappush(waiting, (-len(x), x[-1][0] - x[0][0], x[0][0], i, j, x))
        return out


def grown(text: list[str], begin: int, end: int, template: list[str], start: int) -> list[tuple[int, int]]:
    """Alignment of ``template`` from ``start`` with ``text`` from ``begin``, both open to the right.

    A stretch holds the rest of the template and as many words again as the template has, so that this many may be
    inserted; it grows from its last pair as long as further words of the template follow. Stretches with fewer
    inserted words, in which another notice close by does not spoil the uniqueness of anchors, are tried too.
    """
    best: list[tuple[int, int]] = []
    for inserted in (len(template), len(template) // 4):
        pairs: list[tuple[int, int]] = []
        a, c = begin, start
        while c < len(template) and a < end:
            more = align(text[a:min(end, a + len(template) - c + inserted)], template[c:], True)
            if not more:
                break
            pairs += [(a + x, c + y) for x, y in more]
            a, c = pairs[-1][0] + 1, pairs[-1][1] + 1
        if len(pairs) > len(best):
            best = pairs
        if len(best) == len(template) - start:
            break
    return best


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, license, coverage, matched_words, first_word, last_word, licenses of each row of ``docs``.

    ``licenses`` is an array of (license, coverage, matched_words, first_word, last_word): every place of every template
    of which the text covers ``min_coverage`` of the words there, in order of the first word. Places of one template do
    not overlap; those of different ones may (a long notice can hold a short one). The columns before it are the best
    of them, that of most words covered, or null with coverage 0.

    Words are runs of letters, digits and underscores in lower case; texts are read whole. A template is aligned from
    every occurrence of its words that are rarest in the text, of which any place of enough coverage has one. A place
    may hold inserted words, as many as the template has and more if its words go on between them; what is found there
    is what the patience alignment pairs, wherever in the text it stands. Nothing is shuffled.

    Edge cases: null and empty texts have no license; of templates that match equally many words the first named wins;
    of a
    notice repeated in a text the best is where most is covered, then the first; an empty table gives no rows; other columns are
    ignored whatever their names.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates, min_coverage)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    names = ["license", "coverage", "matched_words", "first_word", "last_word"]
    types = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())

    def scan(batches):
        for b in batches:
            found = [scanner.scan(x.as_py()) for x in b.column(1)]
            best = [scanner.best(f) for f in found]
            columns = [pa.array([f[i] for f in best], t) for i, t in enumerate(types)]
            every = pa.array([[dict(zip(names, f, strict=True)) for f in fs] for fs in found],
                             pa.list_(pa.struct(list(zip(names, types, strict=True)))))
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, every], ["_id", *names, "licenses"])

    fields = "license string, coverage double, matched_words long, first_word long, last_word long"
    each = fields.replace(" ", ":").replace(",:", ",")
    return rows.mapInArrow(scan, f"_id {kind}, {fields}, licenses array<struct<{each}>>").withColumnRenamed("_id", id_col)


pickle_by_value(__name__)
