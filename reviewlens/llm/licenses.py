"""Licence scan with a generalised suffix automaton of licence words.

The automaton holds every statement of the templates. A text's words are streamed through it, which
gives at each word the longest template passage that ends there (matching statistics). Passages
that cannot be extended and are long enough are chained, in order in text and template and with
small gaps, into spans that cover a share of a statement. A statement covered far enough gives its label.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reviewlens.llm.words import NON_ALNUM, U64, Words, blocks, mix

# Phrases whose places count, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Statements of public licences and notices, by label.
TEMPLATES = {
    "agpl": ["licensed under the GNU Affero General Public License, version 3"],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed under the Apache License, Version 2.0.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Released under the BSD License.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "This work is licensed under the GNU General Public License, version 3.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "lgpl": ["licensed under the GNU Lesser General Public License, version 3"],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "proprietary": ["All rights reserved."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}

MIN_WORDS = 3  # shortest passage that can be part of a chain
MAX_GAP = 6  # words between passages of a chain, in the text and in the template
COVER = 0.8  # share of a statement's words that gives its label


class Span(NamedTuple):
    label: str
    statement: int
    begin: int  # word places in the text, the end exclusive
    end: int
    cover: float  # share of the statement's words


class Automaton:
    """Generalised suffix automaton over word numbers, with the places where each state's passages end."""

    def __init__(self, statements: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for k, words in enumerate(statements):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, word)
                self.ends[last].append((k, at + 1))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] = sorted({*self.ends[self.link[state]], *self.ends[state]})
        self.ends[0] = []

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        clone = self._new(self.length[p] + 1)
        self.next[clone] = dict(self.next[q])
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if (q := self.next[last].get(word)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new, p = self._new(self.length[last] + 1), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def statistics(self, words: list[int]) -> list[tuple[int, int]]:
        """(state, length) of the longest passage that ends at each word."""
        state = length = 0
        out = []
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            out.append((state, length))
        return out


class Scanner:
    """Templates compiled once per task."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> None:
        texts = [(label, text) for label in sorted(templates) for text in templates[label]]
        _, _, w = next(blocks(pa.array([t for _, t in texts]), NON_ALNUM))
        self.labels = [label for label, _ in texts]
        self.vocabulary = np.unique(w.hash)
        number = np.searchsorted(self.vocabulary, w.hash)
        statements = [number[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        self.sizes = [len(s) for s in statements]
        self.automaton = Automaton(statements)
        short = min([MIN_WORDS, *self.sizes])
        self.gram = short
        inside = [k for a, b in zip(w.first[:-1], w.first[1:], strict=True) for k in range(a, b - short + 1)]
        self.grams = np.unique(self._grams(w.hash, short)[inside])
        _, _, p = next(blocks(pa.array(list(phrases)), NON_ALNUM))
        self.phrases = [(p.hash[a:b], label) for a, b, label in zip(p.first[:-1], p.first[1:], phrases.values(), strict=True)]

    @staticmethod
    def _grams(h: np.ndarray, size: int) -> np.ndarray:
        n = max(0, len(h) - size + 1)
        out = np.zeros(n, U64)
        for k in range(size):
            out = mix(out + U64(k + 1)) + h[k : k + n]
        return out

    def phrase_places(self, w: Words) -> list[tuple[np.ndarray, str]]:
        """Word places of every phrase; none crosses from one text into the next."""
        found, row = [], w.row()
        for words, label in self.phrases:
            size = len(words)
            n = max(0, len(w.hash) - size + 1)
            at = np.ones(n, bool)
            for k in range(size):
                at &= w.hash[k : k + n] == words[k]
            at = np.flatnonzero(at)
            found.append((at[row[at] == row[at + size - 1]], label))
        return found

    def spans(self, w: Words) -> dict[int, list[Span]]:
        """Covered template spans by text, for the texts that have any."""
        grams = self._grams(w.hash, self.gram)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        hits = np.flatnonzero(self.grams[at] == grams)
        out = {}
        for i in np.unique(np.searchsorted(w.first, hits, side="right") - 1).tolist():
            words = w.hash[w.first[i] : w.first[i + 1]]
            number = np.searchsorted(self.vocabulary, words)
            known = self.vocabulary[np.minimum(number, len(self.vocabulary) - 1)] == words
            if found := self._chains(np.where(known, number, -1).tolist()):
                out[i] = found
        return out

    def _chains(self, words: list[int]) -> list[Span]:
        stats = self.automaton.statistics(words)
        open_chains: dict[int, list[list[int]]] = {}  # statement -> [begin, end, template end, words]
        done: list[tuple[int, list[int]]] = []
        for at, (state, length) in enumerate(stats):
            longest = at + 1 == len(stats) or stats[at + 1][1] <= length
            for k, end in self.automaton.ends[state] if longest and length >= min(MIN_WORDS, self.gram) else ():
                chains = open_chains.setdefault(k, [])
                for c in [c for c in chains if at + 1 - length - c[1] > MAX_GAP]:
                    chains.remove(c)
                    done.append((k, c))
                best = max(
                    (c for c in chains if c[1] < at + 1 and c[2] < end and end - length - c[2] <= MAX_GAP),
                    key=lambda c: c[3], default=None,
                )
                if best:
                    new = min(length, at + 1 - best[1], end - best[2])
                    chains.append([best[0], at + 1, end, best[3] + new])
                else:
                    chains.append([at + 1 - length, at + 1, end, length])
        done += [(k, c) for k, chains in open_chains.items() for c in chains]
        best: dict[tuple[int, int], Span] = {}
        for k, (begin, end, _, covered) in done:
            if covered >= COVER * self.sizes[k]:
                span = Span(self.labels[k], k, begin, end, covered / self.sizes[k])
                best[k, begin] = max(best.get((k, begin), span), span, key=lambda s: (s.cover, -s.end))
        return sorted(best.values(), key=lambda s: (s.begin, s.end, s.statement))


_SPAN = pa.list_(pa.struct([("label", pa.string()), ("statement", pa.int32()), ("begin", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Base places are those where a phrase's words stand consecutively. labels holds base labels and
    those of covered statements. score is the largest covered share of a statement, 1 where a phrase
    stands. A null, empty or wordless text has no places, empty labels and score 0.
    """

    def run(batches):
        scanner = Scanner(templates, phrases)
        for batch in batches:
            rows = []
            for at, to, w in blocks(batch.column("text"), NON_ALNUM):
                base: list[list[tuple[int, str]]] = [[] for _ in range(to - at)]
                for places, label in scanner.phrase_places(w):
                    for i, p in zip((np.searchsorted(w.first, places, side="right") - 1).tolist(), places.tolist(), strict=True):
                        base[i].append((p - int(w.first[i]), label))
                spans = scanner.spans(w)
                for i, found in enumerate(base):
                    own = spans.get(i, [])
                    labels = {x for _, x in found}
                    score = 1.0 if found else max([s.cover for s in own], default=0.0)
                    rows.append((
                        int(w.first[i + 1] - w.first[i]), len(found), min(found)[0] if found else None, max(found)[0] if found else None,
                        ",".join(sorted(labels)), ",".join(sorted(labels | {s.label for s in own})), min(1.0, score), [s._asdict() for s in own],
                    ))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _SPAN]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label string, statement int, begin long, end long, cover double>>"
    )
    return docs.select("doc_id", "text").mapInArrow(run, schema)
