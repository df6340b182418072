"""License scan: matching statistics against a generalised suffix automaton of licence texts.

The templates' words form one automaton; each text is streamed through it to get, at every
word, the length of the longest template run that ends there. Long matches of one template
are chained, and a template whose words are covered enough adds its label with the covered
span. Runs of words that are adjacent in no template can only have statistics below 2, so
streaming starts anew at each of them; the statistics are exact everywhere else.

Defined cases: a null or empty text has no words, no labels and score 0; very long texts are
scanned whole; the score is the best cover of any template, also where it is too low for a label; of labels whose spans overlap the best cover stays, and all of equal ones; repeated rows are scanned one by one; rows
with a null id pass through; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliant.llm import textbytes as tb

#: phrases of the base rule and their labels
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Texts of well-known licences in sections, or the notices that name them, by label.
TEMPLATES = {
    "mit": [
        "released under the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "apache-2": [
        "licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "cc-by-nc": [
        "this work is licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "this work is licensed under CC BY-SA 4.0"],
    "cc-by-nd": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    ],
    "gpl-3": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "gpl-2": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc.",
    ],
    "lgpl-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "lgpl-3": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "agpl-3": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "mpl-2": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    ],
    "epl-2": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "bsd-2": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "bsd-3": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
    "boost": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
        "Distributed under the Boost Software License, Version 1.0.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "all-rights-reserved": ["all rights reserved no part of this publication may be reproduced"],
}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Shortest match that is chained, and the share of a template's words that makes a label.
MIN_MATCH, MIN_COVER = 3, 0.8
#: Longest run of other words between two chained matches.
MAX_GAP = 4

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,end_word:long,cover:double>>"


@dataclass
class Automaton:
    """Suffix automaton of several token sequences; `ends` gives a state one place (template, end) where its string occurs."""

    go: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])

    def _state(self, length: int, go: dict[int, int], link: int) -> int:
        self.go.append(go)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.go) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        c = self._state(self.length[p] + 1, dict(self.go[q]), self.link[q])
        while p != -1 and self.go[p].get(token) == q:
            self.go[p][token] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def extend(self, last: int, token: int) -> int:
        q = self.go[last].get(token)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
        cur = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and token not in self.go[p]:
            self.go[p][token] = cur
            p = self.link[p]
        if p != -1:
            q = self.go[p][token]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
        return cur

    def close(self, sequences: list[list[int]]) -> None:
        """Every state gets all places where its strings end."""
        for k, seq in enumerate(sequences):
            at = 0
            for i, token in enumerate(seq):
                at = self.go[at][token]
                self.ends[at].add((k, i + 1))
        for s in sorted(range(1, len(self.go)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]

    def stream(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """State and matching statistic after each token."""
        s = n = 0
        for t in tokens:
            while s and t not in self.go[s]:
                s = self.link[s]
                n = self.length[s]
            if t in self.go[s]:
                s, n = self.go[s][t], n + 1
            yield s, n


class Scanner:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, min_match: int = MIN_MATCH, min_cover: float = MIN_COVER):
        self.min_match, self.min_cover = min_match, min_cover
        self.names = [label for label, texts in templates.items() for _ in texts]
        texts = [_WORD.findall(t.lower()) for ts in templates.values() for t in ts]
        vocabulary = sorted({w for t in texts for w in t} | {w for p in phrases for w in p.split()})
        hashes = [int(self._hash(w)) for w in vocabulary]
        order = np.argsort(np.array(hashes, np.uint64))
        self.known = np.array(hashes, np.uint64)[order]
        self.number = {vocabulary[k]: i for i, k in enumerate(order.tolist())}
        self.seqs = [[self.number[w] for w in t] for t in texts]
        self.phrases = [([self.number[w] for w in p.split()], label) for p, label in phrases.items()]
        self.automaton = Automaton()
        for seq in self.seqs:
            last = 0
            for token in seq:
                last = self.automaton.extend(last, token)
        self.automaton.close(self.seqs)
        v = len(vocabulary)
        pairs = {a * v + b for seq in [*self.seqs, *(p for p, _ in self.phrases)] for a, b in zip(seq, seq[1:], strict=False)}
        self.pair = np.zeros(v * v, bool)
        self.pair[list(pairs)] = True

    @staticmethod
    def _hash(word: str) -> np.uint64:
        raw = np.frombuffer(word.encode(), np.uint8)
        return tb.span_hash(tb.prefix(raw), np.array([0]), np.array([len(raw)]))[0]

    def runs(self, hashes: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """(text, first word, token numbers) of the runs of template-adjacent words, two words at least."""
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        token = np.where(self.known[at] == hashes, at, -1)
        if len(token) < 2:
            return
        v = len(self.known)
        joined = (token[:-1] >= 0) & (token[1:] >= 0) & (doc[:-1] == doc[1:])
        joined[joined] = self.pair[token[:-1][joined] * v + token[1:][joined]]
        edge = np.diff(np.concatenate(([0], joined.astype(np.int8), [0])))
        head = np.searchsorted(doc, np.arange(doc[-1] + 1))
        for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            yield int(doc[i]), i - int(head[doc[i]]), token[i : j + 1].tolist()

    def matches(self, tokens: list[int]) -> Iterator[tuple[int, int, int, int]]:
        """Right-maximal matches of min_match words or more: (first, end) in the run, template, end in the template."""
        stats = list(self.automaton.stream(tokens))
        for i, (state, n) in enumerate(stats):
            if n >= self.min_match and (i + 1 == len(stats) or stats[i + 1][1] <= n):
                for k, end in self.automaton.ends[state]:
                    yield i + 1 - n, i + 1, k, end

    def chain(self, found: list[tuple[int, int, int, int]]) -> tuple[list[tuple[str, int, int, float]], float]:
        """Chains of one template's matches, in order in text and template, that cover enough of its words, and the best cover of any."""
        out: dict[str, tuple[float, int, int]] = {}
        most = 0.0
        by: dict[int, list[tuple[int, int, int]]] = {}
        for first, end, k, at in found:
            by.setdefault(k, []).append((first, end, at))
        for k, ms in by.items():
            size = len(self.seqs[k])
            ms.sort()
            best: list[tuple[int, int]] = []
            reach = 0  # matches before it end too early for any later one
            for i, (first, end, at) in enumerate(ms):
                got, start = end - first, first
                while reach < i and first - ms[reach][1] > MAX_GAP:
                    reach += 1
                for j in range(reach, i):
                    f2, e2, a2 = ms[j]
                    new = min(end - max(first, e2), at - max(at - (end - first), a2))
                    if e2 <= first + MAX_GAP and first - e2 <= MAX_GAP and a2 < at and new > 0 and best[j][0] + new > got:
                        got, start = best[j][0] + new, best[j][1]
                best.append((got, start))
                cover = min(1.0, got / size)
                most = max(most, cover)
                label = self.names[k]
                if cover >= self.min_cover and (cover, -start) > (out[label][0], -out[label][1]) if label in out else cover >= self.min_cover:
                    out[label] = (cover, start, end)
        # where spans overlap, as those of licences that share most words, the best cover alone counts
        best = {label: x for label, x in out.items() if not any(c > x[0] and s < x[2] and x[1] < e for c, s, e in out.values())}
        return [(label, s, e, c) for label, (c, s, e) in sorted(best.items())], most

    def scan(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, dict[int, dict]]:
        """Word counts of all texts, and the findings of those that have any."""
        low = tb.LOWER[buf]
        ws, we, doc = tb.spans(low, offs, tb.ALNUM)
        found: dict[int, dict] = {}
        for d, at, tokens in self.runs(tb.span_hash(tb.prefix(low), ws, we), doc):
            got = found.setdefault(d, {"base": [], "matches": []})
            for phrase, label in self.phrases:
                n = len(phrase)
                got["base"] += [(at + i, label) for i in range(len(tokens) - n + 1) if tokens[i : i + n] == phrase]
            got["matches"] += [(at + f, at + e, k, end) for f, e, k, end in self.matches(tokens)]
        for got in found.values():
            got["spans"], got["most"] = self.chain(got["matches"])
        return np.bincount(doc, minlength=len(offs) - 1), found


def license_scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, min_match: int = MIN_MATCH, min_cover: float = MIN_COVER) -> DataFrame:
    """One row per document: base places, labels with their covered spans, and the best coverage as score."""
    names = [x.split(" ", 1)[0] for x in SCHEMA.split(", ")]
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("cover", pa.float64())]))

    @tb.tidied
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, PHRASES, min_match, min_cover)
        for b in batches:
            for i, j, buf, offs in tb.chunks(b.column("text")):
                n_words, found = scanner.scan(buf, offs)
                cols: list[list] = [[] for _ in range(7)]
                for d in range(j - i):
                    got = found.get(d)
                    base = sorted(got["base"]) if got else []
                    spans = got["spans"] if got else []
                    labels = {x for _, x in base}
                    row = (
                        len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)), ",".join(sorted(labels | {s[0] for s in spans})),
                        1.0 if base else got["most"] if got else 0.0, [dict(zip(("label", "first_word", "end_word", "cover"), s, strict=True)) for s in spans],
                    )
                    for c, x in zip(cols, row, strict=True):
                        c.append(x)
                kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64(), span]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(n_words.astype(np.int64)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, SCHEMA)


def base_by_regex(text: str) -> list[tuple[int, str]]:
    """The base rule word by word, for tests: (start word, label) of every place."""
    words = _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return sorted((i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
