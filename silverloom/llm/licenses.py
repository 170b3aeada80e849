"""License scan by a generalised suffix automaton over the words of license texts (operator 8).

Texts are streamed through the automaton: at each word it holds the longest suffix of what was read
that occurs in any template (the matching statistic), and where in which template it occurs, each place.
What matches there for ``MIN_MATCH`` words or more, as far as it goes, is chained, template by
template, by dynamic programming: of all sequences of matches that go forward in text and template
with gaps of at most ``MAX_GAP`` words that which covers most. A chain that covers ``MIN_COVER`` of its
template gives a span and the template's label; of chains that overlap in the text those that cover
most together. Exact phrases give the base places and labels. A text's score is the largest share of a
template that a chain covers.

Defined results: a null or empty text has no words, no places, empty labels and score 0; repeated
rows each get their row; of two chains that cover as much the later start counts; every template counts
by itself; columns other than
doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, text_bytes

#: Phrases of the base scan and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: License notices by label, as publicly used.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced."),
]

MIN_MATCH, MIN_COVER, MAX_GAP = 3, 0.8, 12
#: Bytes that end a word become spaces, A-Z become a-z, the rest stays.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


class Automaton:
    """Suffix automaton of several word sequences; every state knows all (sequence, place) at which its
    words end."""

    def __init__(self, sequences: Iterable[list[int]]):
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].add((number, at))
        for state in sorted(range(1, len(self.go)), key=lambda s: -self.length[s]):  # longest first, so links get all
            if self.link[state]:
                self.ends[self.link[state]] |= self.ends[state]

    def _add(self, length: int, go: dict[int, int], link: int) -> int:
        self.go.append(go)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.go) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._add(self.length[p] + 1, dict(self.go[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.go[p].get(word) == q:
            self.go[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.go[last]:  # read before, in another sequence
            q = self.go[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._add(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.go[p]:
            self.go[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.go[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def matches(self, words: list[int], least: int) -> list[tuple[int, int, int, int]]:
        """(sequence, end in words, end in the sequence, length) of all matches of so many words or more
        that go as far as they can."""
        out, state, length = [], 0, 0
        going: dict[tuple[int, int], int] = {}  # sequence, words ahead of it: where the match began
        for at, word in enumerate(words):
            while state and word not in self.go[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.go[state]:
                state, length = self.go[state][word], length + 1
            else:
                length = 0
            now = {}
            if length >= least:
                short = state
                while self.length[self.link[short]] >= least:
                    short = self.link[short]
                for number, place in self.ends[short]:  # wherever the last ``least`` words stand
                    now[number, at - place] = going.get((number, at - place), at + 1 - least)
            out += [(n, at, at - ahead, at - first) for (n, ahead), first in going.items() if (n, ahead) not in now]
            going = now
        return out + [(n, len(words), len(words) - ahead, len(words) - first) for (n, ahead), first in going.items()]


def best_chains(matches: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(covered, first, end) of the best chain that ends with each match; matches: (end, end in the
    template, length) in order. Words in which two matches overlap count once."""
    out: list[tuple[int, int, int]] = []
    for j, (end, reached, length) in enumerate(matches):
        best = (length, end - length)
        for i in range(j - 1, -1, -1):
            last, before, _ = matches[i]
            if last < end - length - gap:
                break
            fresh = min(length, end - last, reached - before)
            if fresh > 0 and reached - length - before <= gap:
                best = max(best, (out[i][0] + fresh, out[i][1]))
        out.append((*best, end))
    return out


def apart(chains: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of chains, in order of their ends, those that don't overlap and cover most together."""
    ends, total, picked = [c[2] for c in chains], [0], []
    for covered, first, _ in chains:
        before = bisect.bisect_right(ends, first, 0, len(picked))
        good = total[before] + covered > total[-1]
        picked.append(before if good else -1)
        total.append(total[before] + covered if good else total[-1])
    out, at = [], len(chains)
    while at:
        if picked[at - 1] >= 0:
            out.append(chains[at - 1])
            at = picked[at - 1]
        else:
            at -= 1
    return out[::-1]


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, min_match: int = MIN_MATCH, min_cover: float = MIN_COVER, max_gap: int = MAX_GAP):
        self.labels = [x for x, _ in templates]
        texts = [words_of(x.encode()) for _, x in templates]
        self.ids: dict[bytes, int] = {}
        for text in texts:
            for word in text:
                self.ids.setdefault(word, len(self.ids) + 1)
        self.sizes = [len(x) for x in texts]
        self.automaton = Automaton([[self.ids[w] for w in x] for x in texts])
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        self.min_match, self.min_cover, self.max_gap = min_match, min_cover, max_gap

    def places(self, words: list[bytes], text: bytes) -> tuple[list[int], list[int], set[str]]:
        starts, ends, labels = [], [], set()
        for phrase, label in self.phrases:
            if not all(w in text for w in phrase):
                continue
            at, n = -1, len(phrase)
            try:
                while True:
                    at = words.index(phrase[0], at + 1)
                    if words[at : at + n] == phrase:
                        starts.append(at)
                        ends.append(at + n)
                        labels.add(label)
            except ValueError:
                pass
        return starts, ends, labels

    def chains(self, words: list[bytes]) -> tuple[list[tuple[int, int, int]], float]:
        """(first word, end, template) of the chains that cover enough, and the best share covered."""
        get = self.ids.get
        known = [get(w, 0) for w in words]
        by: dict[int, list[tuple[int, int, int]]] = {}
        at, n = 0, len(known)
        while at < n:
            if not known[at]:
                at += 1
                continue
            stop = at + 1
            while stop < n and known[stop]:
                stop += 1
            if stop - at >= self.min_match:  # no match goes over a word that no template has
                for number, end, reached, length in self.automaton.matches(known[at:stop], self.min_match):
                    by.setdefault(number, []).append((at + end, reached, length))
            at = stop
        spans, best = [], 0.0
        for number, matches in by.items():
            size, found = self.sizes[number], best_chains(sorted(matches), self.max_gap)
            best = max(best, max(c[0] for c in found) / size)
            spans += [(first, end, number) for _, first, end in apart([c for c in found if c[0] >= self.min_cover * size])]
        return sorted(spans), best

    def scan(self, text: bytes) -> dict:
        low = text.translate(LETTERS)
        words = low.split()
        starts, _, base = self.places(words, low)
        chains, best = self.chains(words)
        spans = {(first, end, self.labels[number]) for first, end, number in chains}
        return {"n_words": len(words), "starts": starts, "base": base, "spans": sorted(spans), "score": 1.0 if base else best}


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, starts of the base phrases, base labels, license spans by word, and the score."""
    made: list[Scanner] = []

    def prepare() -> None:
        made[:] = made or [Scanner(templates, phrases)]

    def each(batch: pa.RecordBatch) -> dict:
        found = [made[0].scan(x) for x in text_bytes(batch.column("text"))]
        return {
            "doc_id": batch.column("doc_id"),
            "n_words": [x["n_words"] for x in found],
            "starts": [x["starts"] for x in found],
            "base": [sorted(x["base"]) for x in found],
            "spans": [[dict(zip(("first", "end", "label"), s)) for s in x["spans"]] for x in found],
            "score": [x["score"] for x in found],
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), f"doc_id {kind}, n_words long, starts array<long>, base array<string>, spans array<struct<first: long, end: long, label: string>>, score double", each, prepare)


def license_digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"),
        F.array_max("starts").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.array_distinct("spans.label"))), ",").alias("labels"),
        "score",
    )
