"""Licence texts and notices in documents, by a generalised suffix automaton.

The automaton is built over the words of all templates. A document's words are
streamed through it; after every word the automaton knows the longest run of
words ending there that stands in some template (the matching statistics). Runs
that cannot be extended and have LEAST_RUN words or more, or make up half of a
template, are long matches. Those of one template that follow each other in the text
as they do in the template are chained; between two of them GAP other words may stand,
and one more for every GAP_SHARE words of the template the chain has covered. A chain
that covers LEAST_COVER of a template's words, each counted once, gives the document
its label. Every paragraph of a licence is a template of its own, so that any of
them is found without the others; short licences are there in full. Where chains of
several licences share half of a stretch, the one that covers most is kept.

Base phrases are part of the automaton: their places are where its state ends in
them. Words are runs of a-z, 0-9 and characters beyond ASCII, A-Z read as a-z.
NULL and empty texts have no words, places or labels, and score 0. Equal texts have
equal results. The score is the share of a document's words that are covered by
chains that gave a label, or by base phrases.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from evenkeel.llm.common import bounded_batches

FOUND = """struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:array<string>,
labels:array<string>,covered:long,spans:array<struct<label:string,start:int,end:int>>>"""

# Phrases that count wherever they stand, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Paragraphs and notices of public licences, by label.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "Released under the MIT License",
        "Licensed under the MIT License",
        "This project is licensed under the terms of the MIT license",
        "SPDX-License-Identifier: MIT",
        "The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed under the Apache License, Version 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, "
        "worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare "
        "Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such "
        "Derivative Works in Source or Object form.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, "
        "worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) "
        "patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work",
        "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or "
        "without modifications, and in Source or Object form, provided that You meet the following conditions",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
        "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
        "This work is licensed under the GNU General Public License, version 3",
        "under the terms of the GNU General Public License version 2",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General "
        "Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public "
        "License, v. 2.0.",
        "All distribution of Covered Software in Source Code Form, including any Modifications that You create "
        "or to which You contribute, must be under the terms of this License. You must inform recipients that "
        "the Source Code Form of the Covered Software is governed by the terms of this License, and how they can "
        "obtain a copy of this License.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
        "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Licensed under CC BY-SA 4.0",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Licensed under CC BY-NC 4.0",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
        "this work",
        "Licensed under CC0 1.0 Universal",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
        "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and "
        "all copyright interest in the software to the public domain. We make this dedication for the benefit of "
        "the public at large and to the detriment of our heirs and successors. We intend this dedication to be "
        "an overt act of relinquishment in perpetuity of all present and future rights to this software under "
        "copyright law.",
    ],
}

LEAST_RUN = 4
GAP = 3
GAP_SHARE = 4
LEAST_COVER = 0.8

_TABLE = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


class Automaton:
    """Suffix automaton of several word sequences; state 0 is the root."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def extend(self, last: int, word: int) -> int:
        """The state after ``word`` follows the sequence that ends in ``last``."""
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new


def chained(parts: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """Stretches of a text, and how many words of a template they cover, of LEAST_COVER of its ``size`` or more.
    None overlaps another.

    Parts are (start, end, end in the template), starts and ends growing. Each follows the part before it that
    gives the most covered words, of those near enough; as a part reaches back no further than the gap of a whole
    template, this is linear in the parts.
    """
    far = max(GAP, size // GAP_SHARE)
    best, before, first = [], [], 0
    for j, (start, end, at) in enumerate(parts):
        covered, previous = end - start, -1
        while parts[first][1] + far < start:
            first += 1
        for i in range(first, j):
            _, i_end, i_at = parts[i]
            if start - i_end <= max(GAP, best[i] // GAP_SHARE):
                fresh = end - start - max(0, i_end - start, i_at - (at - (end - start)))
                if fresh > 0 and best[i] + fresh > covered:
                    covered, previous = best[i] + fresh, i
        best.append(covered)
        before.append(previous)
    found: list[tuple[int, int, int]] = []
    enough = [j for j in range(len(parts)) if best[j] >= LEAST_COVER * size]
    for j in sorted(enough, key=lambda j: (-best[j], parts[j][1])):
        i = j
        while before[i] >= 0:
            i = before[i]
        a, b = parts[i][0], parts[j][1]
        k = bisect_left(found, (b,))
        if k == 0 or found[k - 1][1] <= a:
            insort(found, (a, b, best[j]))
    return found


class Scanner:
    """Templates and phrases in one automaton; small, so it is sent to every task."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        texts = [(label, words_of(t)) for label, group in templates.items() for t in group]
        self.labels = [label for label, _ in texts]
        self.sizes = [len(w) for _, w in texts]
        phrase_words = [words_of(p) for p in phrases]
        self.phrase_labels = list(phrases.values())
        self.phrase_sizes = [len(p) for p in phrase_words]
        self.ids: dict[bytes, int] = {}
        for seq in [*(w for _, w in texts), *phrase_words]:
            for w in seq:
                self.ids.setdefault(w, len(self.ids) + 1)
        sam = self.sam = Automaton()
        for seq in [*(w for _, w in texts), *phrase_words]:
            last = 0
            for w in seq:
                last = sam.extend(last, self.ids[w])
        n = len(sam.next)
        # where the words of a state end in the templates that hold them, and the phrases it ends in
        self.holds: list[dict[int, list[int]]] = [{} for _ in range(n)]
        for k, (_, seq) in enumerate(texts):
            state = 0
            for i, w in enumerate(seq, 1):
                state = sam.next[state][self.ids[w]]
                up = state
                while up > 0:
                    self.holds[up].setdefault(k, []).append(i)
                    up = sam.link[up]
        self.ends: list[tuple[int, ...]] = [()] * n
        goal = {}
        for k, seq in enumerate(phrase_words):
            state = 0
            for w in seq:
                state = sam.next[state][self.ids[w]]
            goal.setdefault(state, []).append(k)
        for state in sorted(range(n), key=sam.length.__getitem__):
            up = self.ends[sam.link[state]] if state else ()
            self.ends[state] = up + tuple(goal.get(state, ()))

    def matches(self, ids: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
        """Runs (start, end, state) that cannot be extended, and places (start, phrase)."""
        runs, places = [], []
        known = np.flatnonzero(ids)
        if not len(known):
            return runs, places
        # stretches of words the templates have; a single one is no match
        cuts = np.flatnonzero(np.diff(known) > 1) + 1
        firsts, lasts = known[np.concatenate([[0], cuts])], known[np.concatenate([cuts - 1, [len(known) - 1]])]
        step, link, length, ends, sizes = self.sam.next, self.sam.link, self.sam.length, self.ends, self.phrase_sizes
        shortest = min([LEAST_RUN, *sizes, *self.sizes])
        for a, b in zip(firsts.tolist(), lasts.tolist()):
            if b - a + 1 < shortest:
                continue
            state = size = 0
            for i, w in enumerate(ids[a : b + 1].tolist(), a):
                if w in step[state]:
                    state, size = step[state][w], size + 1
                else:
                    if size > 1:
                        runs.append((i - size, i, state))
                    while state and w not in step[state]:
                        state = link[state]
                    size = length[state] if state else 0
                    if w in step[state]:
                        state, size = step[state][w], size + 1
                for k in ends[state]:
                    if size >= sizes[k]:
                        places.append((i + 1 - sizes[k], k))
            if size > 1:
                runs.append((b + 1 - size, b + 1, state))
        return runs, places

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Words; places (start, phrase); chains (start, end, template) that cover their template."""
        words = words_of(text)
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        runs, places = self.matches(ids)
        of: dict[int, list[tuple[int, int, int]]] = {}
        for start, end, state in runs:
            for k, ends in self.holds[state].items():
                if end - start >= min(LEAST_RUN, (self.sizes[k] + 1) // 2):
                    of.setdefault(k, []).extend((start, end, at) for at in ends)
        chains = [(covered, a, b, k) for k, parts in of.items() for a, b, covered in chained(parts, self.sizes[k])]
        return len(words), sorted(set(places)), self.strongest(chains)

    def strongest(self, chains: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
        """Chains without those half of which a stronger chain of another licence has.

        Stronger is what covers more words, then more of its template: licences quote each other's paragraphs
        with a word changed.
        """
        if not chains:
            return []
        base = min(a for _, a, _, _ in chains)
        owner = np.zeros(max(b for _, _, b, _ in chains) - base, np.int16)
        numbers = {label: i for i, label in enumerate(dict.fromkeys(self.labels), 1)}
        kept = []
        for covered, a, b, k in sorted(chains, key=lambda c: (-c[0], self.sizes[c[3]], c[1], c[3])):
            mine, held = numbers[self.labels[k]], owner[a - base : b - base]
            if 2 * np.count_nonzero((held != 0) & (held != mine)) < b - a:
                held[held == 0] = mine
                kept.append((a, b, k))
        return sorted(kept)

    def row(self, text: str) -> dict:
        n, places, chains = self.scan(text)
        base = sorted({self.phrase_labels[k] for _, k in places})
        spans = sorted({(a, b, self.labels[k]) for a, b, k in chains})
        touched = [(a, b) for a, b, _ in spans] + [(a, a + self.phrase_sizes[k]) for a, k in places]
        covered, reach = 0, 0
        for a, b in sorted(touched):
            covered += max(0, b - max(a, reach))
            reach = max(reach, b)
        return {
            "n_words": n,
            "n_base": len(places),
            "first_word": places[0][0] if places else None,
            "last_word": places[-1][0] if places else None,
            "base_labels": base,
            "labels": sorted({*base, *(label for _, _, label in spans)}),
            "covered": covered,
            "spans": [{"label": label, "start": a, "end": b} for a, b, label in spans],
        }


def licence_scan(text: Column, scanner: Scanner | None = None) -> Column:
    """A struct for each text: words, base places, labels, covered words and labelled spans (in words)."""
    bounded_batches()
    scanner = scanner or Scanner()
    span = pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    kind = pa.struct(
        [
            ("n_words", pa.int64()),
            ("n_base", pa.int64()),
            ("first_word", pa.int64()),
            ("last_word", pa.int64()),
            ("base_labels", pa.list_(pa.string())),
            ("labels", pa.list_(pa.string())),
            ("covered", pa.int64()),
            ("spans", pa.list_(span)),
        ]
    )

    @F.arrow_udf(FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([scanner.row(v.as_py() or "") for v in batch], kind)

    return find(text)
