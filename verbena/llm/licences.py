"""Licence scan with a generalised suffix automaton of licence tokens.

The notices of a table of templates are inserted into one suffix automaton over word tokens
(lower case, without punctuation). A text is streamed through it: the automaton's state and the
matched length are the matching statistics, the longest piece of any template that ends at each
word. Maximal matches of at least ``min_match`` words are placed in the templates they occur in
and chained in order (gaps of at most ``max_gap`` words on either side) to spans; a span that
covers at least ``min_coverage`` of its template is a finding. Where findings overlap, the one
with more matched words stays (then the better covered, then the first template).

Words that are in no template, and neighbours that follow each other in no template, can't be
part of a long match; they are found by vectorised lookups, so the automaton is run only over the
stretches between them. That is exact.

Defined cases: a null or empty text has no findings; every row is scanned, so repeated rows give
repeated findings, and a null doc_id is kept; a notice that stands several times is found each
time; an empty table gives an empty result; further columns are ignored; the templates are a
parameter, limited to ``MAX_TOKENS`` words because every worker holds them.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, word_hashes

MIN_MATCH = 4
MAX_GAP = 12
MIN_COVERAGE = 0.75
MAX_TOKENS = 2_000_000

#: identifier, names under which notices cite it
LICENCES = {
    "MIT": ("MIT License", "MIT licence"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3",),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, version 2.0"),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License, Version 1.0",),
    "Unlicense": ("The Unlicense",),
    "CC0-1.0": ("CC0 1.0 Universal", "Creative Commons Zero 1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}
FORMS = ("Licensed under {}", "Licensed under the {}", "Released under the {}", "Distributed under the {}", "This work is licensed under {}", "This work is licensed under the {}", "under the terms of the {}")
#: longer notices
TEXTS = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "Apache-2.0": ("you may not use this file except in compliance with the License. You may obtain a copy of the License at",),
    "GPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file",),
}


def default_templates() -> list[tuple[str, str]]:
    """(licence, notice) pairs, in a fixed order."""
    out = [(k, form.format(name)) for k, names in LICENCES.items() for name in names for form in FORMS]
    out += [(k, f"SPDX-License-Identifier: {k}") for k in LICENCES]
    return out + [(k, t) for k, texts in TEXTS.items() for t in texts]


class Automaton:
    """A generalised suffix automaton: the suffixes of all inserted sequences of integers."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        self._all: dict[int, list[tuple[int, int]]] = {}
        self._children: list[list[int]] | None = None

    def _new(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def insert(self, sequence, name: int) -> None:
        last = 0
        for at, c in enumerate(sequence, 1):
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
            else:
                new, p = self._new(self.length[last] + 1, 0, {}), last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][c]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
                last = new
            self.ends[last].append((name, at))

    def occurrences(self, state: int) -> list[tuple[int, int]]:
        """(sequence, end) of every occurrence of a state's strings."""
        if state not in self._all:
            if self._children is None:
                self._children = [[] for _ in self.link]
                for s, p in enumerate(self.link[1:], 1):
                    self._children[p].append(s)
            found, stack = [], [state]
            while stack:
                s = stack.pop()
                found += self.ends[s]
                stack += self._children[s]
            self._all[state] = sorted(found)
        return self._all[state]

    def statistics(self, sequence) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest suffix of each prefix of the sequence that occurs."""
        state = length = 0
        for c in sequence:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
            yield state, length


def chain(matches: list[tuple[int, int, int]], max_gap: int) -> list[tuple[int, int, int]]:
    """Chain matches (text start, template start, length) of one template: spans (start, end, matched words), each match used once.

    A match that overlaps the one before it, in the text or the template, counts without the overlap.
    """
    order = sorted(set(matches))
    reach = max(n for _, _, n in order) + max_gap
    best = [n for _, _, n in order]
    back = [-1] * len(order)
    for i, (s, t, n) in enumerate(order):
        j = i - 1
        while j >= 0 and s - order[j][0] <= reach:
            a, b, m = order[j]
            lap = max(0, a + m - s, b + m - t)
            if a < s and b < t and lap < n and a + n > 0 and s + n > a + m and s - a - m <= max_gap and t - b - m <= max_gap and best[j] + n - lap > best[i]:
                best[i], back[i] = best[j] + n - lap, j
            j -= 1
    used, spans = [False] * len(order), []
    for i in sorted(range(len(order)), key=lambda i: (-best[i], i)):
        if used[i]:
            continue
        path = [i]
        while back[path[-1]] >= 0 and not used[back[path[-1]]]:
            path.append(back[path[-1]])
        below = back[path[-1]]
        for p in path:
            used[p] = True
        spans.append((order[path[-1]][0], order[i][0] + order[i][2], best[i] - (best[below] if below >= 0 else 0)))
    return spans


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], min_match: int, max_gap: int, min_coverage: float) -> None:
        hashes, of = word_hashes([t for _, t in templates])
        if len(hashes) > MAX_TOKENS:
            raise ValueError(f"the templates have {len(hashes)} words; {MAX_TOKENS} is the most")
        self.names = [k for k, _ in templates]
        self.min_match, self.max_gap, self.min_coverage = min_match, max_gap, min_coverage
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        self.sizes = np.bincount(of, minlength=len(templates)).tolist()
        self.automaton = Automaton()
        for k in range(len(templates)):
            self.automaton.insert(ids[of == k].tolist(), k)
        together = of[1:] == of[:-1]
        self.pairs = np.unique(ids[:-1][together] * len(self.vocabulary) + ids[1:][together])

    def scan(self, texts: list[str | None]) -> list[tuple[int, str, int, int, int, float]]:
        """(index of the text, licence, first word, end word, matched words, coverage) of each finding."""
        out = []
        if not len(self.vocabulary):
            return out
        for lo, hi in chunks(texts):
            hashes, of = word_hashes(texts[lo:hi])
            if not len(hashes):
                continue
            at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
            ids = np.where(self.vocabulary[at] == hashes, at, -1)
            first = np.searchsorted(of, np.arange(hi - lo))
            code = ids[:-1] * len(self.vocabulary) + ids[1:]
            if len(self.pairs):
                near = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
                ok = (self.pairs[near] == code) & (ids[:-1] >= 0) & (ids[1:] >= 0) & (of[:-1] == of[1:])
            else:
                ok = np.zeros(len(code), bool)
            if self.min_match == 1:
                edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).view(np.int8)))
                runs = zip(edges[::2].tolist(), edges[1::2].tolist())
            else:
                edges = np.flatnonzero(np.diff(np.concatenate(([False], ok, [False])).view(np.int8)))
                start, end = edges[::2], edges[1::2] + 1
                long = end - start >= self.min_match
                runs = zip(start[long].tolist(), end[long].tolist())
            matches: dict[int, dict[int, list[tuple[int, int, int]]]] = {}
            for s, e in runs:
                doc = int(of[s])
                self._run(ids[s:e].tolist(), s - int(first[doc]), matches.setdefault(doc, {}))
            for doc, found in matches.items():
                out += [(lo + doc, *f) for f in self._findings(found)]
        return out

    def _run(self, ids: list[int], base: int, found: dict) -> None:
        held = None
        for i, (state, n) in enumerate([*self.automaton.statistics(ids), (0, 0)]):
            if held and held[1] >= self.min_match and n != held[1] + 1:
                for name, end in self.automaton.occurrences(held[0]):
                    found.setdefault(name, []).append((base + i - held[1], end - held[1], held[1]))
            held = (state, n)

    def _findings(self, found: dict) -> list[tuple[str, int, int, int, float]]:
        spans = []
        for name, matches in found.items():
            for s, e, n in chain(matches, self.max_gap):
                if n >= self.min_coverage * self.sizes[name]:
                    spans.append((-n, -n / self.sizes[name], name, s, e))
        kept: list[tuple[int, int]] = []
        out = []
        for n, cover, name, s, e in sorted(spans):
            at = bisect.bisect_left(kept, (s, e))
            if (at and kept[at - 1][1] > s) or (at < len(kept) and kept[at][0] < e):
                continue
            kept.insert(at, (s, e))
            out.append((self.names[name], s, e, -n, round(-cover, 4)))
        return sorted(out, key=lambda f: f[1])


def scan(
    docs: DataFrame,
    templates: list[tuple[str, str]] | None = None,
    min_match: int = MIN_MATCH,
    max_gap: int = MAX_GAP,
    min_coverage: float = MIN_COVERAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows (doc_id, licence, start_word, end_word, matched, coverage), one a finding; nothing is shuffled."""
    scanner = Scanner(default_templates() if templates is None else templates, min_match, max_gap, min_coverage)
    shared = docs.sparkSession.sparkContext.broadcast(scanner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = shared.value.scan(b.column(1).to_pylist())
            at = pa.array([r[0] for r in rows], pa.int64())
            cols = [pa.array([r[i] for r in rows], t) for i, t in ((1, pa.string()), (2, pa.int64()), (3, pa.int64()), (4, pa.int64()), (5, pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), *cols], names=["doc_id", "licence", "start_word", "end_word", "matched", "coverage"])

    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return base.mapInArrow(run, f"doc_id {kind}, licence string, start_word bigint, end_word bigint, matched bigint, coverage double")
