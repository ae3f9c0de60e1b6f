"""License scans with a generalised suffix automaton of licence tokens.

The automaton knows every run of words of every template. Streaming a file's words through it
gives the matching statistics: at each word, the longest run ending there that some template
has. The parts of these runs that a template has, at all of its places, are chained into one
covered span where they follow each other in it.
"""

from __future__ import annotations

import functools
import pathlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, slices

#: Base phrases and their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_LIABLE = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."

#: Notices by label (fixed values: the wording of public licences and their usual notices).
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "mit": ["Released under the MIT License", "Licensed under the MIT License", _MIT, f"{_MIT} {_LIABLE}"],
    "bsd": ["Licensed under the BSD License", _BSD],
    "bsd-2-clause": ["Licensed under the BSD 2-Clause License", "Licensed under the Simplified BSD License", f"{_BSD} {_AS_IS}"],
    "bsd-3-clause": ["Licensed under the BSD 3-Clause License", "Licensed under the New BSD License", f"{_BSD} {_ENDORSE} {_AS_IS}"],
    "isc": [_ISC],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0"],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ],
    "epl-1.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0", "Licensed under the Eclipse Public License, version 1.0"],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 2.0"],
    "cc0-1.0": ["This work is dedicated to the public domain under CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}
#: Names and versions from which the other notices are made (fixed values).
GNU = (("gpl", "GNU General Public License", ("2", "3")), ("lgpl", "GNU Library General Public License", ("2",)), ("lgpl", "GNU Lesser General Public License", ("2.1", "3")), ("agpl", "GNU Affero General Public License", ("3",)))
CC_KINDS = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic"}
CC_PARTS = {"by": "Attribution", "nc": "NonCommercial", "nd": "NoDerivatives", "sa": "ShareAlike"}
CC_CODES = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
for _code, _name, _versions in GNU:
    for _v in _versions:
        TEMPLATES[f"{_code}-{_v}" if "." in _v else f"{_code}-{_v}.0"] = [
            f"This work is licensed under the {_name}, version {_v}",
            f"{_name}, version {_v}",
            f"{_name} v{_v}",
            *[
                f"This {x} is free software: you can redistribute it and/or modify it under the terms of the {_name} as published by the Free Software Foundation, either version {_v} of the License, or (at your option) any later version. This {x} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {_name} for more details."
                for x in ("program", "library")
            ],
        ]
for _v, _kind in CC_KINDS.items():
    for _code in CC_CODES:
        _name = "-".join(CC_PARTS[x] if _v == "4.0" or x != "nd" else "NoDerivs" for x in _code.split("-"))
        TEMPLATES[f"cc-{_code}-{_v}"] = [f"Licensed under CC {_code.upper()} {_v}", f"This work is licensed under a Creative Commons {_name} {_v} {_kind} License", f"Creative Commons {_name} {_v}", f"creativecommons.org/licenses/{_code}/{_v}"]

#: Words that tell the licences of a family apart, and what they count as; in these families numbers
#: are such words too. A chain must have all those of its template, in it or within MAX_GAP words of
#: it, and may skip no other in the text.
DECIDING = {"nc": "nc", "noncommercial": "nc", "nd": "nd", "noderivatives": "nd", "noderivs": "nd", "sa": "sa", "sharealike": "sa", "lesser": "lesser", "library": "library", "affero": "affero"}
FAMILIES = ("apache", "gpl", "lgpl", "agpl", "cc", "mpl", "epl", "bsl")

#: A match counts from so many words on; a template is found when so large a share is covered.
MIN_MATCH = 4
MIN_COVER = 0.8
#: Words that may stand between two chained matches, in the file and in the template.
MAX_GAP = 8

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.encode().translate(_TABLE).split()


def _decides(word: bytes) -> str | None:
    """What a word counts as if it tells licences apart, else None."""
    w = word.decode()
    number = w.removeprefix("v")
    return number if number.isdigit() else DECIDING.get(w)


@dataclass
class Automaton:
    """A generalised suffix automaton over word ids. ``place`` has for each state one place
    (template, end) of its words, and ``where`` for each word all its places in all templates."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    place: list[tuple[int, int]] = field(default_factory=lambda: [(0, 0)])
    templates: list[list[int]] = field(default_factory=list)
    where: dict[int, list[tuple[int, int]]] = field(default_factory=dict)

    def _state(self, next_: dict[int, int], link: int, length: int, place: tuple[int, int]) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.length.append(length)
        self.place.append(place)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """Make the part of state ``q`` that ``p`` reaches by ``word`` a state of its own."""
        clone = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.place[q])
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, word: int, place: tuple[int, int]) -> int:
        if (q := self.next[last].get(word)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new, p = self._state({}, 0, self.length[last] + 1, place), last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def add(self, words: list[int]) -> None:
        template, last = len(self.templates), 0
        self.templates.append(words)
        for i, w in enumerate(words):
            last = self._extend(last, w, (template, i + 1))
            self.where.setdefault(w, []).append((template, i))

    def parts(self, state: int, size: int) -> list[tuple[int, int, int, int]]:
        """What templates have of the last ``size`` words of a state, longest at each place:
        (template, first word, past the last, place of the first in the template)."""
        template, end = self.place[state]
        found, open_ = [], {}
        for i, w in enumerate([*self.templates[template][end - size : end], None]):
            here = {(t, at - i): open_.pop((t, at - i), i) for t, at in self.where.get(w, ())}
            found += [(t, a, i, a + shift) for (t, shift), a in open_.items() if i - a >= min(MIN_MATCH, len(self.templates[t]))]
            open_ = here
        return found


@dataclass
class Scanner:
    """Labels texts; made of templates and base phrases."""

    vocabulary: dict[bytes, int]
    automaton: Automaton
    labels: list[str]
    sizes: list[int]
    phrases: dict[int, tuple[str, int]]
    deciding: list[dict[int, str]]  # of each template: its deciding words by their place
    known: dict[tuple[int, int], list[tuple[int, int, int, int]]] = field(default_factory=dict)

    def runs(self, words: list[bytes]) -> tuple[list[tuple[int, int, int]], list[tuple[int, str]]]:
        """Maximal matches of two words or more, as (start, end, state), and the places of base
        phrases, as (start, label). Only stretches of known words are streamed."""
        ids = list(map(self.vocabulary.get, words))
        known = np.fromiter([i is not None for i in ids], np.int8, len(ids))
        edge = np.flatnonzero(np.diff(known, prepend=0, append=0))
        runs, places = [], []
        next_, link, length, phrases = self.automaton.next, self.automaton.link, self.automaton.length, self.phrases
        for a, b in edge.reshape(-1, 2).tolist():
            if b - a < 2:
                continue
            state = size = 0
            for i in range(a, b):
                w = ids[i]
                if w not in next_[state]:
                    if size >= 2:
                        runs.append((i - size, i, state))
                    while state and w not in next_[state]:
                        state = link[state]
                        size = length[state]
                state = next_[state].get(w, 0)
                size = size + 1 if state else 0
                s = state
                while s > 0 and length[s] > 1:  # the phrases that end here are suffixes of the match
                    if (p := phrases.get(s)) is not None and size >= p[1]:
                        places.append((i + 1 - p[1], p[0]))
                    s = link[s]
            if size >= 2:
                runs.append((b - size, b, state))
        return runs, places

    def spans(self, runs: list[tuple[int, int, int]], text: list[bytes]) -> list[tuple[str, int, int, float]]:
        """Chains of long matches: (label, first word, past the last, covered share). A chain goes
        if it lacks a deciding word of its template or skips one that is not, and if another
        template's has all its words and more, or a larger share by the same words."""
        by_template: dict[int, dict[int, list[list[int]]]] = {}
        for a, b, s in runs:
            if (parts := self.known.get((s, b - a))) is None:
                parts = self.known[s, b - a] = self.automaton.parts(s, b - a)
            for t, first, end, at in parts:
                same = by_template.setdefault(t, {}).setdefault(a + first - at, [])
                if same and a + first <= same[-1][1]:  # runs overlap
                    same[-1][1] = max(same[-1][1], a + end)
                else:
                    same.append([a + first, a + end, at])
        found = []
        for t, places in by_template.items():
            for chain in self._chains(t, sorted((a, b, at) for x in places.values() for a, b, at in x)):
                covered, words = set(), set()
                for a, b, at in chain:
                    covered.update(range(at, at + b - a))
                    words.update(range(a, b))
                if len(covered) >= MIN_COVER * self.sizes[t] and self._decided(t, covered, text, chain):
                    found.append((self.labels[t], chain[0][0], max(b for _, b, _ in chain), len(covered) / self.sizes[t], words))
        by_word: dict[int, list[int]] = {}
        for k, x in enumerate(found):
            for w in x[4]:
                by_word.setdefault(w, []).append(k)
        return [x[:4] for x in found if not any(x[4] <= found[k][4] and (len(x[4]), x[3]) < (len(found[k][4]), found[k][3]) for k in by_word[x[1]])]

    def _decided(self, t: int, covered: set[int], text: list[bytes], chain: list[tuple[int, int, int]]) -> bool:
        """Does a chain have its template's deciding words, and skip no others?"""
        own = self.deciding[t]
        if not own:
            return True
        skipped = {_decides(w) for (_, b, _), (a, _, _) in zip(chain, chain[1:], strict=False) for w in text[b:a]} - {None}
        first, past = chain[0][0], max(b for _, b, _ in chain)
        beside = {_decides(w) for w in [*text[max(0, first - MAX_GAP) : first], *text[past : past + MAX_GAP]]}
        return skipped <= set(own.values()) and {d for i, d in own.items() if i not in covered} <= skipped | beside

    def _chains(self, t: int, parts: list[tuple[int, int, int]]):
        """The chains of a template that cover most, each word of the text in one at most."""
        best: list[int] = []
        before: list[int] = []
        for k, (a, b, at) in enumerate(parts):
            most, prev = b - a, -1
            for i in range(k - 1, -1, -1):
                pa, pb, pat = parts[i]
                if a - pa > self.sizes[t] + MAX_GAP:
                    break
                gap = at - (pat + pb - pa)
                if a - pb <= MAX_GAP and gap <= MAX_GAP and gap + b - a > 0 and (n := best[i] + min(b - a, gap + b - a)) > most:
                    most, prev = n, i
            best.append(most)
            before.append(prev)
        taken: set[int] = set()
        for k in sorted(range(len(parts)), key=lambda k: -best[k]):
            if best[k] < MIN_COVER * self.sizes[t]:
                return
            chain = []
            while k >= 0:
                chain.append(parts[k])
                k = before[k]
            words = range(chain[-1][0], max(b for _, b, _ in chain))
            if taken.isdisjoint(words):
                taken.update(words)
                yield chain[::-1]

    def scan(self, text: str) -> dict:
        """Number of words, base places, and template spans of a text."""
        words = words_of(text)
        runs, places = self.runs(words)
        return {"n_words": len(words), "places": places, "spans": self.spans(runs, words) if runs else []}


def build(templates: dict[str, list[str]], phrases: dict[str, str] = PHRASES) -> Scanner:
    """A scanner of notices by label and base phrases with their labels. Labels whose first part
    is one of FAMILIES have deciding words."""
    vocabulary: dict[bytes, int] = {}
    automaton, labels, sizes, deciding = Automaton(), [], [], []
    coded = lambda s: [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(s)]
    for label, notices in templates.items():
        for notice in notices:
            ids = coded(notice)
            automaton.add(ids)
            labels.append(label)
            sizes.append(len(ids))
            family = label.split("-")[0] in FAMILIES
            deciding.append({i: d for i, w in enumerate(words_of(notice)) if family and (d := _decides(w))})
    base = []
    for phrase, label in phrases.items():
        ids = coded(phrase)
        automaton.add(ids)
        labels.append(label)
        sizes.append(len(ids))
        deciding.append({})
        base.append((ids, label))
    ends = {}
    for ids, label in base:
        s = 0
        for w in ids:
            s = automaton.next[s][w]
        ends[s] = (label, len(ids))
    return Scanner(vocabulary, automaton, labels, sizes, ends, deciding)


def from_folder(path: str) -> dict[str, list[str]]:
    """TEMPLATES and the whole licence texts of a folder, labelled by their lower-case file names."""
    more = {p.name.lower(): [p.read_text(errors="replace")] for p in sorted(pathlib.Path(path).iterdir()) if p.is_file() and not p.is_symlink()}
    return {k: [*TEMPLATES.get(k, []), *more.get(k, [])] for k in [*TEMPLATES, *more]}


@functools.lru_cache(2)
def default_scanner() -> Scanner:
    return build(TEMPLATES)


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """``doc_id, n_words, places, spans`` for every whole text, in one pass without a shuffle:
    ``places`` are the base phrases' (first word, label), ``spans`` the template spans (label,
    first word, past the last word, covered share of the template). A null text is an empty one,
    and an empty one has no words and no findings; an empty table gives an empty result. Texts of
    any length are scanned whole, one at a time; ids may be null or repeat, and repeated rows give
    repeated results. Other columns, whatever their names, are ignored. ``templates``: notices by
    label in place of TEMPLATES, for instance of :func:`from_folder`."""
    kind = df.schema[doc_id].dataType.simpleString()
    place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))

    def run(batches):
        scanner = default_scanner() if templates is None else build(templates)
        for b in slices(batches):
            got = [scanner.scan(t or "") for t in b.column("text").to_pylist()]
            places = [[{"word": w, "label": x} for w, x in g["places"]] for g in got]
            spans = [[dict(zip(("label", "first", "end", "covered"), s, strict=True)) for s in g["spans"]] for g in got]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([g["n_words"] for g in got], pa.int64()), pa.array(places, place), pa.array(spans, span)], ["doc_id", "n_words", "places", "spans"])

    return only(df, doc_id=doc_id, text=text).mapInArrow(run, f"doc_id {kind}, n_words long, places array<struct<word:long,label:string>>, spans array<struct<label:string,first:long,end:long,covered:double>>")


def op10(spark, sf_dir: str) -> DataFrame:
    """Every document's licence findings."""
    s = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return s.selectExpr(
        "doc_id",
        "n_words",
        "cast(size(places) as long) as n_base",
        "array_min(places.word) as first_word",
        "array_max(places.word) as last_word",
        "array_join(array_sort(array_distinct(places.label)), ',') as base_labels",
        "array_join(array_sort(array_distinct(concat(places.label, spans.label))), ',') as labels",
        "greatest(coalesce(array_max(spans.covered), 0.0D), if(size(places) > 0, 1.0D, 0.0D)) as score",
    )


def license_base(spark, sf_dir: str) -> DataFrame:
    """The part of :func:`op10` that SQL can express."""
    return op10(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
