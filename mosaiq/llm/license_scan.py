"""Licence texts in documents: matching statistics by a generalised suffix automaton, and chains of long matches.

All templates' words are put into one suffix automaton. A document's words are
streamed through it; at each word the length of the longest match that ends there is
known, and by the suffix links every template and place where it, or a shorter part
of it, ends. Matches of at least min_match words that can't be longer on either side
are chained per template, in the order of both texts, where the next match begins at
most GAP words after the end of the one before. A chain covers the runs of min_match
words that lie in its matches, and of these only runs that tell a label from the others
count: those that stand in no other label's templates and not in STOCK. A template
whose counting runs are covered to min_cover or more by a chain gives its label and a
span. Fixed phrases give base labels.

Defined results: null or empty text has no words and no labels, score 0 and null
positions; repeated rows give repeated results; rows are never dropped; columns named
as the new ones are replaced. Templates are broadcast with the code, so they are to be
licences, not a corpus.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public licence texts, or the notices that licences ask for; a label before a slash.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl/3": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/""",
    "gpl/2": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "lgpl/3": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see https://www.gnu.org/licenses/""",
    "lgpl/2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA""",
    "agpl/3": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/""",
    "bsd/2": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd/3": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "mpl/2": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "epl/2": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.""",
    "cc0": """To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.""",
    "cc by": """This work is licensed under a Creative Commons Attribution 4.0 International License.""",
}
# Wording that many licences share and that tells none of them.
STOCK = (
    "This work is licensed under the terms of the", "This program is free software: you can redistribute it and/or modify it under the terms of the", "This software is provided as is without warranty of any kind express or implied",
    "Unless required by applicable law or agreed to in writing", "permitted provided that the following conditions are met", "You may obtain a copy of the License at",
)
MIN_MATCH, MIN_COVER, GAP = 4, 0.5, 48

#: Bytes of UTF-8: A-Z in lower case, other ASCII than digits and letters as spaces, the rest as it is.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


class SuffixAutomaton:
    """Of several sequences; each state knows all places (sequence, word) where its words end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for k, sequence in enumerate(sequences):
            last = 0
            for at, symbol in enumerate(sequence):
                last = self._extend(last, symbol, ends)
                ends[last].add((k, at))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state]:
                ends[self.link[state]] |= ends[state]
        self.ends = ends

    def _new(self, length: int, ends: list[set[tuple[int, int]]]) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        ends.append(set())
        return len(self.link) - 1

    def _split(self, before: int, symbol: int, state: int, ends: list[set[tuple[int, int]]]) -> int:
        """A copy of state for its suffixes that also follow before."""
        twin = self._new(self.length[before] + 1, ends)
        self.next[twin] = dict(self.next[state])
        self.link[twin], self.link[state] = self.link[state], twin
        while before >= 0 and self.next[before].get(symbol) == state:
            self.next[before][symbol] = twin
            before = self.link[before]
        return twin

    def _extend(self, last: int, symbol: int, ends: list[set[tuple[int, int]]]) -> int:
        there = self.next[last].get(symbol)
        if there is not None:  # another sequence has these words
            return there if self.length[there] == self.length[last] + 1 else self._split(last, symbol, there, ends)
        new, before = self._new(self.length[last] + 1, ends), last
        while before >= 0 and symbol not in self.next[before]:
            self.next[before][symbol] = new
            before = self.link[before]
        if before >= 0:
            there = self.next[before][symbol]
            self.link[new] = there if self.length[there] == self.length[before] + 1 else self._split(before, symbol, there, ends)
        return new

    def statistics(self, sequence: list[int]) -> list[tuple[int, int]]:
        """For each place the length of the longest match that ends there, and its state."""
        state = length = 0
        out = []
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            to = self.next[state].get(symbol)
            if to is not None:
                state, length = to, length + 1
            out.append((length, state))
        return out


def label_of(template: str) -> str:
    return template.split("/")[0]


class LicenseScanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str], min_match: int, min_cover: float, stock: tuple[str, ...] = STOCK):
        self.min_match, self.min_cover = min_match, min_cover
        self.names = list(templates)
        self.phrases = [(words_of(p), label) for p, label in phrases.items()]
        words = [words_of(t) for t in templates.values()]
        self.ids = {w: k for k, w in enumerate(sorted({w for s in [*words, *(p for p, _ in self.phrases)] for w in s}))}
        self.phrases = [(tuple(self.ids[w] for w in p), label) for p, label in self.phrases]
        self.sequences = [[self.ids[w] for w in s] for s in words]
        self.automaton = SuffixAutomaton(self.sequences)
        self.counted = self._counted([[self.ids.get(w, -1) for w in words_of(t)] for t in stock])

    def _counted(self, stock: list[list[int]]) -> list[np.ndarray]:
        """Per template how many counting runs begin before each place."""
        runs = lambda s: [tuple(s[k : k + self.min_match]) for k in range(len(s) - self.min_match + 1)]
        holders: dict[tuple, set[str | None]] = {}
        for label, s in [*zip(map(label_of, self.names), self.sequences, strict=True), *((None, s) for s in stock)]:
            for r in runs(s):
                holders.setdefault(r, set()).add(label)
        return [np.concatenate([[0], np.cumsum([len(holders[r]) == 1 for r in runs(s)], dtype=np.int64)]) for s in self.sequences]

    def matches(self, words: np.ndarray) -> list[tuple[int, int, int, int]]:
        """All matches of at least min_match words that can't be longer on either side, as (template, start in it, start in the document, words).

        Runs of known words that are too short for one aren't streamed.
        """
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (words >= 0).astype(np.int8), [0]])))
        automaton, out = self.automaton, []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a < self.min_match:
                continue
            run = words[a:b].tolist()
            for k, (length, state) in enumerate(automaton.statistics(run)):
                met: set[tuple[int, int]] = set()
                while length >= self.min_match:
                    for template, end in automaton.ends[state] - met:
                        sequence = self.sequences[template]
                        if k + 1 == len(run) or end + 1 == len(sequence) or sequence[end + 1] != run[k + 1]:
                            out.append((template, end - length + 1, a + k - length + 1, length))
                    met |= automaton.ends[state]
                    state = automaton.link[state]
                    length = automaton.length[state]
        return out

    def chains(self, matches: list[tuple[int, int, int, int]]) -> dict[int, tuple[float, int, int]]:
        """Per template the share of its counting runs that its best chain covers, and the chain's span of words."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for template, t, d, n in matches:
            by.setdefault(template, []).append((d, t, n))
        best = {template: self.best_chain(template, sorted(found)) for template, found in by.items()}
        return {template: chain for template, chain in best.items() if chain}

    def best_chain(self, template: int, found: list[tuple[int, int, int]]) -> tuple[float, int, int] | None:
        """The chain of sorted matches (document, template, words) that covers most: its share and span; null if it covers nothing."""
        count, best, less = self.counted[template], [], self.min_match - 1
        longest, low = max((n for _, _, n in found), default=0), 0
        for k, (d, t, n) in enumerate(found):
            while found[low][0] < d - GAP - longest:
                low += 1
            covered, start = count[t + n - less] - count[t], d
            for j in range(k - 1, low - 1, -1):
                dj, tj, nj = found[j]
                over = max(0, dj + nj - less - d, tj + nj - less - t)  # runs that the match before has
                if tj < t and over < n - less and d - dj - nj <= GAP:
                    whole = best[j][0] + count[t + n - less] - count[t + over]
                    if whole > covered:
                        covered, start = whole, best[j][1]
            best.append((covered, start, d + n))
        covered, start, end = max(best, key=lambda x: (x[0], -x[1], -x[2]), default=(0, 0, 0))
        return (float(covered / count[-1]), start, end) if covered else None

    def spans(self, matches: list[tuple[int, int, int, int]], chained: dict[int, tuple[float, int, int]]) -> list[tuple[int, int, int, float]]:
        """(template, start, end, share) of all chains that cover enough: the best one of each template, then of what lies before and after it."""
        out = []
        for template, whole in chained.items():
            found = sorted((d, t, n) for x, t, d, n in matches if x == template)
            parts = [(found, whole)]
            while parts:
                rest, chain = parts.pop()
                if chain is None or chain[0] < self.min_cover:
                    continue
                share, start, end = chain
                out.append((template, start, end, share))
                for side in ([m for m in rest if m[0] + m[2] <= start], [m for m in rest if m[0] >= end]):
                    parts.append((side, self.best_chain(template, side)))
        return sorted(out)

    def base_places(self, ids: np.ndarray) -> list[tuple[int, str]]:
        out = []
        for phrase, label in self.phrases:
            n = len(ids) - len(phrase) + 1
            if n > 0:
                hit = ids[:n] == phrase[0]
                for k in range(1, len(phrase)):
                    hit = hit & (ids[k : k + n] == phrase[k])
                out += [(int(p), label) for p in np.flatnonzero(hit)]
        return sorted(out)

    def scan(self, text: str) -> tuple:
        words = words_of(text)
        ids = np.array(list(map(self.ids.get, words, [-1] * len(words))), dtype=np.int32)
        places = self.base_places(ids)
        base = {label for _, label in places}
        matches = self.matches(ids)
        chained = self.chains(matches)
        spans = [(self.names[t], start, end, share) for t, start, end, share in self.spans(matches, chained)]
        labels = base | {label_of(name) for name, *_ in spans}
        score = max((share for share, _, _ in chained.values()), default=0.0)
        return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


@lru_cache(maxsize=2)
def _scanner(templates: tuple, phrases: tuple, min_match: int, min_cover: float) -> LicenseScanner:
    return LicenseScanner(dict(templates), dict(phrases), min_match, min_cover)


def templates_in(spark: SparkSession, folder: str) -> dict[str, str]:
    """Templates from a folder of text files, named as these without their endings; for a list of licences, which is small."""
    rows = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[a-z]+)?$", 1).alias("name"), "value").orderBy("name").collect()
    return {r["name"]: r["value"] for r in rows}


SPANS = pa.list_(pa.struct([("template", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("cover", pa.float64())]))


def scan_licenses(
    docs: DataFrame, text: str = "text", templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, min_match: int = MIN_MATCH, min_cover: float = MIN_COVER
) -> DataFrame:
    """Adds word counts, base places, labels, score and template_spans (in words, end exclusive)."""
    key = (tuple(templates.items()), tuple(phrases.items()), min_match, min_cover)

    def make():
        scanner = _scanner(*key)

        def work(texts: list[str]) -> list[pa.Array]:
            columns = list(zip(*map(scanner.scan, texts), strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            spans = [[dict(zip(("template", "first_word", "end_word", "cover"), s, strict=True)) for s in row] for row in columns[7]]
            return [*(pa.array(c, k) for c, k in zip(columns, kinds, strict=False)), pa.array(spans, SPANS)]

        return work

    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, template_spans array<struct<template:string,first_word:long,end_word:long,cover:double>>"
    return map_texts(docs, make, schema, text)
