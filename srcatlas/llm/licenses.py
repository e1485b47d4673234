r"""Licence scan: a generalised suffix automaton over the words of licence templates.

The automaton knows every run of words of every template. A document's words are streamed
through it, which gives its matching statistics: at each word, how many words up to there are
a run of some template, and of which. Runs of `LEAST` words or more that can't be extended
are matches; for each template, matches that go forward in both texts and stand close together
are chained, and a chain that covers enough of its template is a span with that template's
label. The phrases of the base are short templates that must be covered whole; the automaton
finds their places at the states that end in them.

Only words of templates move the automaton, so runs of them are cut out by hash first, for a
whole column at once, and decided on their bytes. Documents are independent: no shuffle. The
automaton has at most two states for each word of a template, whatever is scanned.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.llm import words as W
from srcatlas.llm._store import bound_batches, release

#: Bytes between words: ASCII other than digits and lower-case letters (text is lower-cased first).
BREAKS = np.array([b < 0x80 and not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A) for b in range(256)])
#: Words of a match, words between two matches of a chain, and the share of a template that a span covers, at least or at most.
LEAST, GAP, COVER = 4, 12, 0.6

# Phrases of the base and their labels.
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

# The licences' own words, as they are published; notices that name a licence, then texts.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
]


class Match(NamedTuple):
    """A run of words that document and template share and that goes on at neither end: both ends, exclusive, and the length."""

    end: int
    at: int
    length: int


class Span(NamedTuple):
    label: str
    template: int
    start: int  # words of the document
    end: int
    covered: int  # words of the template
    score: float


def words_of(text: str) -> list[bytes]:
    """A text's words, as a document's are found."""
    out: list[bytes] = []
    for part in W.tokenized(pa.array([text]), breaks=BREAKS, fold=W.FOLD):
        raw = part.data.tobytes()
        out += [raw[a:b] for a, b in zip(part.start.tolist(), part.end.tolist(), strict=True)]
    return out


class Automaton:
    """The generalised suffix automaton of some word sequences."""

    def __init__(self, sequences: Iterable[list[bytes]]) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (sequence, end) of each occurrence of the state's words
        self.whole: list[list[int]] = [[]]  # sequences that are a suffix of the state's words
        self.sizes: list[int] = []
        finals: list[int] = []
        for k, sequence in enumerate(sequences):
            last = 0
            for i, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].append((k, i + 1))
            self.sizes.append(len(sequence))
            finals.append(last)
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for v in reversed(order):
            self.ends[self.link[v]] += self.ends[v]
        self.ends = [sorted(set(x)) for x in self.ends]
        for k, v in enumerate(finals):
            # The state at a sequence's end may stand for longer runs too; its own length decides.
            if v:
                self.whole[v].append(k)
        for v in order:
            self.whole[v] = self.whole[v] + self.whole[self.link[v]]

    def _state(self, length: int, of: int | None = None) -> int:
        self.next.append(dict(self.next[of]) if of is not None else {})
        self.link.append(self.link[of] if of is not None else -1)
        self.length.append(length)
        self.ends.append([])
        self.whole.append([])
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """A copy of q for the runs of p and one more word alone."""
        copy = self._state(self.length[p] + 1, q)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        q = self.next[last].get(word)
        if q is not None:  # another sequence has come this way
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def stream(self, words: Iterable[bytes]) -> Iterator[tuple[int, int]]:
        """Matching statistics: after each word, the state and the length of the longest run up to there."""
        state = length = 0
        step, link, longest = self.next, self.link, self.length
        for word in words:
            to = step[state].get(word)
            while to is None and state:
                state = link[state]
                length = longest[state]
                to = step[state].get(word)
            if to is None:
                length = 0
            else:
                state, length = to, length + 1
            yield state, length


class Scanner:
    """Finds phrases and template spans in streams of words."""

    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]], least: int = LEAST, gap: int = GAP, cover: float = COVER) -> None:
        self.labels = [label for label, _ in [*phrases, *templates]]
        self.n_phrases, self.least, self.gap, self.cover = len(phrases), least, gap, cover
        self.sequences = sequences = [words_of(text) for _, text in [*phrases, *templates]]
        if not all(sequences):
            raise ValueError("a template has no words")
        self.a = Automaton(sequences)
        #: A template of few words is one match.
        self.need = [min(least, n) for n in self.a.sizes]
        self.least_need = min(self.need[self.n_phrases :], default=1 << 62)
        self.shortest = min([*self.a.sizes[: self.n_phrases], self.least_need])
        self.words = sorted({w for s in sequences for w in s})
        self.known = frozenset(self.words)
        joined = next(W.tokenized(pa.array([" ".join(w.decode() for w in self.words)]), breaks=BREAKS, fold=W.FOLD))
        self.hashes = np.sort(joined.hashes())

    def scan(self, words: list[bytes], at: int, places: list[tuple[int, int]], matches: dict[int, list[Match]]) -> None:
        """Adds one run of words, which begins at a document's word `at`, to its phrases' places and its matches."""
        a, sizes = self.a, self.a.sizes
        for i, (state, length) in enumerate(a.stream(words)):
            if length < self.shortest:
                continue
            for k in a.whole[state]:
                if k < self.n_phrases and sizes[k] <= length:
                    places.append((at + i + 1 - sizes[k], k))
            following = words[i + 1] if i + 1 < len(words) else None
            held: set[tuple[int, int]] = set()
            while length >= self.least_need:
                # Shorter runs that end here have more occurrences, maybe in other templates.
                for k, e in a.ends[state]:
                    if k >= self.n_phrases and length >= self.need[k] and (k, e) not in held:
                        held.add((k, e))
                        if e == sizes[k] or self.sequences[k][e] != following:
                            matches.setdefault(k, []).append(Match(at + i + 1, e, length))
                state = a.link[state]
                length = a.length[state]

    def spans(self, matches: dict[int, list[Match]]) -> list[Span]:
        """For each template the chains of its matches that cover enough of it, and don't overlap."""
        out: list[Span] = []
        for k, found in sorted(matches.items()):
            chains: deque[tuple[int, int, int, int]] = deque()  # (document end, template end, start, covered) that may go on
            done: list[tuple[int, int, int]] = []  # (covered, start, end)
            for end, at, length in sorted(found):
                begin, first = end - length, at - length
                best = (length, begin)
                while chains and chains[0][0] + self.gap + self.a.sizes[k] < begin:
                    chains.popleft()
                for e, t, start, covered in chains:
                    # What two matches both hold counts once.
                    new = length - max(0, e - begin, t - first)
                    if e < end and t < at and new > 0 and begin - e <= self.gap:
                        best = max(best, (covered + new, start))
                chains.append((end, at, best[1], best[0]))
                done.append((best[0], best[1], end))
            starts: list[int] = []
            ends: list[int] = []
            for covered, start, end in sorted(done, key=lambda c: (-c[0], c[1], c[2])):
                if covered < self.cover * self.a.sizes[k]:
                    break
                spot = bisect_left(starts, start)
                if (spot == 0 or ends[spot - 1] <= start) and (spot == len(starts) or starts[spot] >= end):
                    starts.insert(spot, start)
                    ends.insert(spot, end)
                    out.append(Span(self.labels[k], k - self.n_phrases, start, end, covered, min(1.0, covered / self.a.sizes[k])))
        return sorted(out, key=lambda s: (s.start, s.end, s.template))


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, template: int, start: int, end: int, score: double>>"

_SCANNERS: dict[tuple, Scanner] = {}


def scanner_of(templates: tuple, phrases: tuple, least: int, gap: int, cover: float) -> Scanner:
    """One for each worker process."""
    key = templates, phrases, least, gap, cover
    if key not in _SCANNERS:
        _SCANNERS[key] = Scanner(list(templates), list(phrases), least, gap, cover)
    return _SCANNERS[key]


def found_in(scanner: Scanner, part: W.Words) -> Iterator[tuple]:
    """The result of each document of some: n_words, places of phrases, spans."""
    hashes = part.hashes()
    at = np.searchsorted(scanner.hashes, hashes)
    hit = scanner.hashes[np.minimum(at, len(scanner.hashes) - 1)] == hashes
    doc = part.doc()
    # Runs of words that templates hold, inside one document.
    begins = hit.copy()
    begins[1:] &= ~(hit[:-1] & (doc[1:] == doc[:-1]))
    ends = hit.copy()
    ends[:-1] &= ~(hit[1:] & (doc[1:] == doc[:-1]))
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    wide = end - start >= scanner.shortest
    start, end = start[wide], end[wide]
    bounds = np.searchsorted(start, part.first)
    counts, known = part.counts(), scanner.known
    for d in range(part.hi - part.lo):
        places: list[tuple[int, int]] = []
        matches: dict[int, list[Match]] = {}
        first = int(part.first[d])
        for r in range(int(bounds[d]), int(bounds[d + 1])):
            run: list[bytes] = []
            lo = int(start[r])
            for w in range(lo, int(end[r])):
                word = part.data[part.start[w] : part.end[w]].tobytes()
                if word in known:
                    run.append(word)
                else:  # the hash was another word's
                    scanner.scan(run, lo - first, places, matches)
                    run, lo = [], w + 1
            scanner.scan(run, lo - first, places, matches)
        yield int(counts[d]), places, scanner.spans(matches) if matches else []


def scan(docs: DataFrame, templates: Iterable[tuple[str, str]] = TEMPLATES, phrases: Iterable[tuple[str, str]] = PHRASES, least: int = LEAST, gap: int = GAP, cover: float = COVER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: doc_id, n_words, n_base (places of phrases), first_word, last_word (null without any), base_labels, labels (with the spans'), score (the best covered share of a template or phrase, 0 without any), and the spans.

    Templates and phrases are (label, text); a label may have several. A null text is an
    empty one and has no words. Repeated rows, null ids and an empty table need no care;
    other columns are not read. Spans of one template don't overlap; those of different
    templates may. Words are counted from 0, ends are exclusive.
    """
    bound_batches(docs.sparkSession)
    setup = (tuple(templates), tuple(phrases), least, gap, cover)
    shared = docs.sparkSession.sparkContext.broadcast(setup)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scanner = scanner_of(*shared.value)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            ids, rows = batch.column(0), []
            for part in W.tokenized(batch.column(1), breaks=BREAKS, fold=W.FOLD):
                for n_words, places, spans in found_in(scanner, part):
                    base = sorted({scanner.labels[k] for _, k in places})
                    every = sorted({*base, *(s.label for s in spans)})
                    at = [p for p, _ in places]
                    score = max([1.0] * bool(places) + [s.score for s in spans], default=0.0)
                    rows.append((n_words, len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(every), score, [{"label": s.label, "template": s.template, "start": s.start, "end": s.end, "score": s.score} for s in spans]))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(task, RESULT)


def query(spark, sf_dir):
    from srcatlas.llm._store import table

    return scan(table(spark, sf_dir, "documents")).drop("spans")
