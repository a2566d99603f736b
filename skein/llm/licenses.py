"""License scans with a generalised suffix automaton of license tokens.

All templates are put into one automaton over word numbers. A file's words are streamed through
it to get matching statistics: at each word the longest template substring that ends there. Long
matches are placed in every template that has them and chained, in order in both text and
template, into covered spans; a template whose words are covered enough gives its label. Short
fixed phrases are found exactly besides and give the base labels.

Only runs of words that occur in a template are streamed, as any other word ends a match.

Defined cases: a null text is empty; without words all counts are 0, first and last are null,
labels are empty strings and the score is 0; overlapping places of a phrase all count; a text of
any length is streamed whole; repeated rows each give a row.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.textscan import ALNUM, Scan, slices, texts_of, word_hash

#: Fixed phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Fixed wording of public license notices, by label.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal "
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
}
#: Least words of a match that is chained, and least covered share of a template.
LEAST, COVER = 3, 0.8

#: Words are digits, letters and non-ASCII characters; upper case counts, as it is lowered first.
_WORDS = ALNUM


def words_of(text: str) -> list[str]:
    """The words of one text."""
    data, offsets = texts_of(pa.array([text]))
    scan = Scan(data, offsets, _WORDS)
    raw = scan.data.tobytes()
    return [raw[a:b].decode(errors="replace") for a, b in zip(scan.start, scan.end, strict=True)]


class Automaton:
    """Generalised suffix automaton: every substring of every template is a path from the root."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: For each state, the (template, end) places at which its strings were made.
        self.ends: list[list[tuple[int, int]]] = [[]]
        for t, sequence in enumerate(sequences):
            last = 0
            for i, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].append((t, i + 1))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):  # longer strings end where their suffixes do
            if self.link[s] > 0:
                self.ends[self.link[s]] += self.ends[s]
        self.ends = [sorted(set(e)) for e in self.ends]

    def _state(self, length: int, steps: dict[int, int], link: int) -> int:
        self.next.append(steps)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        """The state for the strings of q that are one longer than p's, taken out of q."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            q = self.next[last][token]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, token)
        made, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = made
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[made] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
        return made

    def stream(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: after each token, the state and length of the longest match that ends there."""
        state = length = 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            yield state, length


class Scanner:
    """Templates, phrases and the automaton, ready to scan."""

    def __init__(self, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None, least: int = LEAST, cover: float = COVER):
        templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
        self.least, self.cover = least, cover
        pairs = [(label, words_of(t)) for label in sorted(templates) for t in templates[label]]
        self.labels = [label for label, _ in pairs]
        vocabulary = sorted({w for _, ws in pairs for w in ws})
        number = {w: i for i, w in enumerate(vocabulary)}
        self.templates = [[number[w] for w in ws] for _, ws in pairs]
        self.automaton = Automaton(self.templates)
        hashes = np.array([word_hash(w) for w in vocabulary], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        self.front = np.zeros(1 << 16, bool)
        self.front[(hashes >> np.uint64(48)).astype(np.int64)] = True
        self.phrases = [(np.array([word_hash(w) for w in words_of(p)], np.uint64), label) for p, label in sorted(phrases.items())]

    def spans(self, tokens: list[int], at: int) -> list[tuple[int, int, int, int]]:
        """Maximal matches of a run: template, start in it, start in the text, length."""
        states = [*self.automaton.stream(tokens), (0, 0)]
        found = []
        for i, (state, length) in enumerate(states[:-1]):
            if length >= self.least and states[i + 1][1] <= length:  # not a part of a longer match
                for t, end in self.automaton.ends[state]:
                    if end >= length:
                        found.append((t, end - length, at + i + 1 - length, length))
            elif length and states[i + 1][1] <= length and length == len(tokens):
                for t, end in self.automaton.ends[state]:
                    if len(self.templates[t]) == length == end:
                        found.append((t, 0, at, length))
        return found

    def chains(self, found: list[tuple[int, int, int, int]]) -> dict[int, float]:
        """For each template, the largest share of its words in a chain of matches that keeps their order.

        A chain's matches lie within twice the template's length of text, so distant scraps do not add up.
        """
        best: dict[int, float] = {}
        by: dict[int, list[tuple[int, int, int]]] = {}
        for t, a, i, n in found:
            by.setdefault(t, []).append((i, a, n))
        for t, matches in by.items():
            size = len(self.templates[t])
            matches = sorted(set(matches))
            starts = [i for i, _, _ in matches]
            got: list[tuple[int, int]] = []  # words covered by the best chain that ends with each match, and where it begins
            for k, (i, a, n) in enumerate(matches):
                top = (n, i)
                for m in range(bisect_left(starts, i - 2 * size, 0, k), k):
                    j, b, o = matches[m]
                    lap = max(0, j + o - i, b + o - a)
                    if b < a and lap < n and i + n - got[m][1] <= 2 * size:
                        top = max(top, (got[m][0] + n - lap, got[m][1]), key=lambda x: x[0])
                got.append(top)
                best[t] = max(best.get(t, 0), min(1.0, top[0] / size))
        return best

    def scan(self, column: pa.Array) -> list[tuple]:
        """Per text: n_words, n_base, first_word, last_word, base_labels, labels, score."""
        out: list[tuple] = []
        for a, b, part, cut in slices(*texts_of(column)):
            scan = Scan(part, cut, _WORDS)
            words, n = scan.hashes(), b - a
            base: list[set[str]] = [set() for _ in range(n)]
            count, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            for phrase, label in self.phrases:
                size = len(phrase)
                hit = np.flatnonzero(words[: len(words) - size + 1] == phrase[0]) if len(words) >= size else np.zeros(0, np.int64)
                for k in range(1, size):
                    hit = hit[words[hit + k] == phrase[k]]
                hit = hit[scan.text[hit] == scan.text[hit + size - 1]]
                text = scan.text[hit]
                where = hit - scan.first[text]
                np.add.at(count, text, 1)
                np.minimum.at(low, text, where)
                np.maximum.at(high, text, where)
                for i in set(text.tolist()):
                    base[i].add(label)
            found = self._long(scan, words)
            counts = scan.counts
            for i in range(n):
                share = self.chains(found.get(i, []))
                more = {self.labels[t] for t, s in share.items() if s >= self.cover}
                score = max([1.0 if base[i] else 0.0, *share.values()])
                out.append((int(counts[i]), int(count[i]), int(low[i]) if count[i] else None, int(high[i]) if count[i] else None, ",".join(sorted(base[i])), ",".join(sorted(base[i] | more)), float(score)))
        return out

    def _long(self, scan: Scan, words: np.ndarray) -> dict[int, list[tuple[int, int, int, int]]]:
        """Stream the runs of template words that are long enough."""
        if not len(words) or not len(self.hashes):
            return {}
        at = np.flatnonzero(self.front[(words >> np.uint64(48)).astype(np.int64)])
        near = np.minimum(np.searchsorted(self.hashes, words[at]), len(self.hashes) - 1)
        ok = self.hashes[near] == words[at]
        at, number = at[ok], self.numbers[near[ok]]
        breaks = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(scan.text[at], prepend=-1) != 0))
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        ends = np.append(breaks[1:], len(at))
        long = ends - breaks >= self.least
        for x, y in zip(breaks[long].tolist(), ends[long].tolist(), strict=True):
            text = int(scan.text[at[x]])
            if got := self.spans(number[x:y].tolist(), int(at[x] - scan.first[text])):
                found.setdefault(text, []).extend(got)
        return found


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """One row a document: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner or Scanner())
    schema = pa.schema([(id_col, pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = shared.value.scan(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], f.type) for k, f in enumerate(list(schema)[1:]))], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


__all__ = ["PHRASES", "TEMPLATES", "Automaton", "Scanner", "scan_licenses", "words_of"]
