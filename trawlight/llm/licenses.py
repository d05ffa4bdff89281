"""License scans by patience alignment.

A text is compared with license templates word by word. Words that stand exactly once in both are
anchors; the longest increasing subsequence of their places keeps those in the same order; the gaps
between kept anchors, and the ends around them, are aligned in the same way. The coverage of a
template is the share of its words that found their place.

Whole documents are not aligned with every template. A template is tried only around its trigger
words: so many of its least common words that a text without any of them cannot reach the wanted coverage.
Each occurrence of a trigger gives a window around the place where the template would lie, and
repeated notices are found one by one. Windows that lie within a template's length of each other make a
region; if none of its windows reaches the coverage the whole region is aligned, so words put into
the middle of a license do not hide it as long as each of its pieces holds a trigger.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from trawlight.llm.common import doc_text

# Wording of public licenses and of the notices that name them.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "MIT-notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer."
    ),
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "proprietary-notice": "All rights reserved.",
}
MIN_COVERAGE = 0.8

_WORD = re.compile(r"[^\W_]+")


def split_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(places: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tails, ends, before = [], [], []
    for i, place in enumerate(places):
        at = bisect_left(tails, place)
        before.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(place)
            ends.append(i)
        else:
            tails[at], ends[at] = place, i
    chain, i = [], ends[-1] if ends else -1
    while i >= 0:
        chain.append(i)
        i = before[i]
    return chain[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs ``(place in text, place in template)`` of words that a patience alignment matches."""
    matched, work = [], [(0, len(text), 0, len(template))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and text[a] == template[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a == b or c == d:
            continue
        counts = Counter(text[a:b])
        wanted = Counter(template[c:d])
        places = {word: i for i, word in enumerate(text[a:b], a) if counts[word] == 1 and wanted[word] == 1}
        anchors = [(places[word], i) for i, word in enumerate(template[c:d], c) if word in places]
        kept = [anchors[i] for i in _increasing([place for place, _ in anchors])]
        if not kept:
            continue
        matched += kept
        edges = [(a - 1, c - 1), *kept, (b, d)]
        work += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges, edges[1:])]
    return sorted(matched)


@cache
def _plans(templates: tuple[tuple[str, str], ...], coverage: float):
    """Per template: name, words, and triggers with their places in it."""
    everywhere = Counter(word for _, text in templates for word in set(split_words(text)))
    plans = []
    for name, text in templates:
        words = split_words(text)
        counts = Counter(words)
        triggers, held = [], 0
        # Without these words at most coverage * len(words) - 1 words can match.
        for word in sorted(counts, key=lambda w: (counts[w], everywhere[w], -len(w), w)):
            if len(words) - held < coverage * len(words):
                break
            triggers.append(word)
            held += counts[word]
        plans.append((name, words, {word: [i for i, w in enumerate(words) if w == word] for word in triggers}))
    return plans


def _regions(starts: list[int], size: int, slack: int) -> list[list[int]]:
    """Starts in runs that are at most a template apart."""
    runs: list[list[int]] = []
    for start in starts:
        if runs and start - runs[-1][-1] <= size + 2 * slack:
            runs[-1].append(start)
        else:
            runs.append([start])
    return runs


def _matches(words: list[str], template: list[str], starts: list[int], slack: int, needed: float) -> list[tuple[int, int, int]]:
    """``(matched words, first word, words)`` of each occurrence around some starts.

    Where a template lies in one piece its own length is aligned, then with slack on both sides. What
    no such window covers is aligned as a whole, so that words put into the middle, however
    many, do not hide a template whose own words are all there.
    """
    size, found, done = len(template), [], -1
    for start in starts:
        if start < done:
            continue
        for low, high in ((start, start + size), (start - slack, start + size + slack)):
            low, high = max(0, low, done), min(len(words), high)
            pairs = align(words[low:high], template) if high - low >= needed else []
            if len(pairs) >= needed:
                first, last = low + pairs[0][0], low + pairs[-1][0]
                found.append((len(pairs), first, last - first + 1))
                done = last + 1
                break
    if not found:
        low, high = max(0, starts[0] - slack), min(len(words), starts[-1] + size + slack)
        pairs = align(words[low:high], template) if high - low > size + 2 * slack else []
        if len(pairs) >= needed:
            first, last = low + pairs[0][0], low + pairs[-1][0]
            found.append((len(pairs), first, last - first + 1))
    return found


def scan_text(text: str, templates: tuple[tuple[str, str], ...], coverage: float) -> list[tuple[str, float, int, int]]:
    """``(template, coverage, first word, words)`` of each place where a template reaches the coverage."""
    words = split_words(text)
    found = []
    present: dict[str, list[int]] = {}
    for i, word in enumerate(words):
        present.setdefault(word, []).append(i)
    for name, template, triggers in _plans(templates, coverage):
        size, slack = len(template), max(2, len(template) // 4)
        starts = sorted(
            {place - offset for word, offsets in triggers.items() for place in present.get(word, ()) for offset in offsets}
        )
        for run in _regions(starts, size, slack):
            for matched, first, count in _matches(words, template, run, slack, coverage * size):
                found.append((name, matched / size, first, count))
    return found


def scan(
    docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = MIN_COVERAGE
) -> DataFrame:
    """``(doc_id, license, coverage, n_found, found)`` of every row of ``docs``.

    ``found`` lists template, coverage, first word and number of words of each occurrence in the whole
    text; ``license`` and ``coverage`` are those of the best covered template, longer templates
    first among equals, then by name; without any, ``license`` is null and ``coverage`` 0. Null and
    empty texts have none. Whole texts of any length are scanned; other columns play no part, whatever
    their names. Repeated rows are scanned one by one. An empty table stays empty.
    """
    wanted = tuple((templates or TEMPLATES).items())
    sizes = {name: len(split_words(text)) for name, text in wanted}
    struct = "array<struct<license: string, coverage: double, start: int, words: int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_type = pa.list_(
            pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("words", pa.int32())])
        )
        for batch in batches:
            hits = [scan_text(text.as_py(), wanted, coverage) for text in batch.column(1)]
            best = [max(h, key=lambda x: (x[1], sizes[x[0]], x[0])) if h else None for h in hits]
            keys = ("license", "coverage", "start", "words")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([b and b[0] for b in best], pa.string()),
                    pa.array([b[1] if b else 0.0 for b in best], pa.float64()),
                    pa.array([len(h) for h in hits], pa.int32()),
                    pa.array([[dict(zip(keys, x)) for x in h] for h in hits], found_type),
                ],
                ["doc_id", "license", "coverage", "n_found", "found"],
            )

    return doc_text(docs).mapInArrow(
        run, f"doc_id long, license string, coverage double, n_found int, found {struct}"
    )
