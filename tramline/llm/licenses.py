"""License scans (operator 4): patience alignment of texts with license templates.

A template is looked for around its telling words. Each occurrence of a word that the
template has once is tried as a fixed point; the text before it, back to the same word
before, and the text behind it, up to the same word behind, are aligned with the
template's two halves, so copies that follow each other are told apart. Words that are
unique both there and in the template are anchors; the longest chain of them that ascends
in both is kept, and the gaps between are aligned in the same way, with equal words at
their ends first. What share of the template's words is aligned is its coverage.

Coverage alone doesn't tell a licence from its neighbours, which differ in one word. So the
words that decide (a name, a version) must be aligned without another word between them, a short notice as a whole, and a
longer one must not be scattered over foreign text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least coverage of a hit, and least share of aligned words in the text from the first to the last of them.
COVERAGE, DENSITY = 0.8, 0.6
#: Templates of so many words or fewer are found word for word only.
SHORT = 12
#: The notices and headers that public licenses ask for.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License",
    "MIT-header": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."
    ),
    "MIT-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        'of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "LGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "BSD-2-Clause-full": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "BSD-3-Clause-full": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "ISC-full": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare '
        "derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "all-rights-reserved": "All rights reserved",
}

# What tells these from other licences of the same wording.
DECIDING = {
    "Apache-2.0-header": ("Apache License, Version 2.0",),
    "GPL-3.0-header": ("GNU General Public License", "version 3"),
    "GPL-2.0-header": ("GNU General Public License", "version 2"),
    "LGPL-3.0-header": ("GNU Lesser General Public License", "version 3"),
    "AGPL-3.0-header": ("GNU Affero General Public License", "version 3"),
    "MPL-2.0-header": ("Mozilla Public License, v. 2.0",),
    "BSD-3-Clause-full": ("Neither the name",),
    "BSL-1.0": ("person or organization",),
}

_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-cased words and their code point spans in the text."""
    found = list(_WORD.finditer(text))
    return [m[0].lower() for m in found], [m.span() for m in found]


def _ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain of pairs, sorted by their first, that ascends in the second too: patience piles with back pointers."""
    tops: list[int] = []
    top_pair: list[int] = []
    back: list[int | None] = []
    for k, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        back.append(top_pair[pile - 1] if pile else None)
        if pile == len(tops):
            tops.append(y)
            top_pair.append(k)
        else:
            tops[pile], top_pair[pile] = y, k
    chain, k = [], top_pair[-1] if top_pair else None
    while k is not None:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of aligned positions of equal words, ascending in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a.get(w) == 1}
        anchors = _ascending([(i, where[a[i]]) for i in range(a0, a1) if a[i] in where])
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        out += anchors
        if anchors:
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:]) if k > i + 1 and m > j + 1]
    return sorted(out)


def _near(pairs: list[tuple[int, int]], fixed: int, reach: int) -> list[tuple[int, int]]:
    """The pairs around that of index ``fixed`` whose text positions are at most ``reach`` apart; others are chance.

    On each side as far as aligned words outweigh foreign ones, two to one: a few words that agree beyond a longer gap belong to other text.
    """

    def end(step: int) -> int:
        k = best = fixed
        score = most = 0.0
        while 0 <= k + step < len(pairs):
            gap, own = abs(pairs[k + step][0] - pairs[k][0]), abs(pairs[k + step][1] - pairs[k][1])
            if gap > reach:
                break
            k += step
            score += 1 - max(0, gap - own) / 2
            if score >= most:
                best, most = k, score
        return best

    return pairs[end(-1) : end(1) + 1]


class Template:
    """Words of a template, its telling words, and how many of these a text of the least coverage has."""

    def __init__(self, text: str, least: float, deciding: tuple[str, ...] = ()):
        self.words = words_of(text)[0]
        self.least = 1.0 if len(self.words) <= SHORT else least
        least = self.least
        self.deciding = [self._place(words_of(d)[0]) for d in deciding]
        counts = Counter(self.words)
        # The longest words, a third of them at least: more than a text of the least coverage may lack.
        lacking = int((1 - least) * len(self.words) + 1e-9)
        ordered = sorted(counts, key=lambda w: (-len(w), w))
        self.telling = set(ordered[: max(2, -(-len(ordered) // 3), lacking + 1)])
        self.needed = max(1, len(self.telling) - lacking)
        self.fixed = {w: k for k, w in enumerate(self.words) if counts[w] == 1 and (w in self.telling or len(self.telling) > len(ordered) / 2)}

    def _place(self, words: list[str]) -> range:
        for k in range(len(self.words) - len(words) + 1):
            if self.words[k : k + len(words)] == words:
                return range(k, k + len(words))
        raise ValueError(f"the template doesn't say {' '.join(words)!r}")

    def accepts(self, pairs: list[tuple[int, int]]) -> bool:
        """Whether aligned words, by their places in text and template, are a copy."""
        span = pairs[-1][0] - pairs[0][0] + 1
        if len(self.words) <= SHORT:
            return len(pairs) == len(self.words) == span
        if len(pairs) < self.least * len(self.words) - 1e-9 or len(pairs) < DENSITY * span:
            return False
        at = {j: i for i, j in pairs} if self.deciding else {}
        return all(j in at and at[j] - at.get(d[0], -1) == j - d[0] for d in self.deciding for j in d)


def _merged(places: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places (first, last) in order, those that meet as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(places):
        if out and a <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


class Scanner:
    """Finds each copy of each template in a text."""

    def __init__(self, templates: dict[str, str], least: float = COVERAGE, deciding: dict[str, tuple[str, ...]] | None = None):
        import ahocorasick

        deciding = (DECIDING if templates is TEMPLATES else {}) if deciding is None else deciding
        self.templates = {name: Template(text, least, deciding.get(name, ())) for name, text in sorted(templates.items())}
        self.owners: dict[str, list[str]] = {}
        self.any_word = ahocorasick.Automaton()
        for name, t in self.templates.items():
            for w in t.telling | set(t.fixed):
                self.owners.setdefault(w, []).append(name)
                self.any_word.add_word(w, w)
        if self.owners:
            self.any_word.make_automaton()

    def _copies(self, name: str, words: list[str], places: dict[str, list[int]], taken: list[tuple[int, int]]) -> Iterator[tuple[float, int, int]]:
        """(coverage, first word, last word) of the copies of a template, from left to right, none of which overlap.

        taken: places in order that belong to copies of more aligned words than this template has; a copy there would be dropped.
        """
        template = self.templates[name]
        size, telling = len(template.words), template.telling
        told = sorted((k, w) for w in telling for k in places.get(w, ()))
        at = [k for k, _ in told]
        done = 0
        for k, w in sorted((k, w) for w in template.fixed for k in places.get(w, ())):
            if k < done:
                continue
            y = bisect_left(taken, (k + 1,))
            if y and taken[y - 1][1] >= k:
                continue
            own, o = places[w], template.fixed[w]
            x = bisect_left(own, k)
            left = max(done, own[x - 1] + 1 if x else 0, k - o - size)
            right = min(own[x + 1] if x + 1 < len(own) else len(words), k + 2 * size - o)
            if len({w for _, w in told[bisect_left(at, left) : bisect_left(at, right)]}) < template.needed:
                continue
            before = [(i + left, j) for i, j in align(words[left:k], template.words[:o])]
            behind = [(i + k + 1, j + o + 1) for i, j in align(words[k + 1 : right], template.words[o + 1 :])]
            pairs = _near([*before, (k, o), *behind], len(before), max(10, size // 2))
            if template.accepts(pairs):
                done = pairs[-1][0] + 1
                yield len(pairs) / size, pairs[0][0], pairs[-1][0]

    def scan(self, text: str | None) -> list[dict]:
        """Hits (license, coverage, start, end), best first for each place; overlapping lesser ones are left out."""
        if not text or not self.owners or next(self.any_word.iter(text.lower()), None) is None:
            return []
        words, spans = words_of(text)
        places: dict[str, list[int]] = {}
        for k, w in enumerate(words):
            if w in self.owners:
                places.setdefault(w, []).append(k)
        found = Counter(name for w in places for name in self.owners[w] if w in self.templates[name].telling)
        hits = []
        # Long templates first: where one is found, shorter ones, often its beginning, need not be tried.
        aligned: list[tuple[int, int, float]] = []
        for name in sorted((n for n, k in found.items() if k >= self.templates[n].needed), key=lambda n: (-len(self.templates[n].words), n)):
            size = len(self.templates[name].words)
            copies = list(self._copies(name, words, places, _merged((a, b) for a, b, n in aligned if n > size)))
            aligned += [(a, b, c * size) for c, a, b in copies]
            hits += [(c, size, name, spans[a][0], spans[b][1]) for c, a, b in copies]
        hits.sort(key=lambda h: (-h[0] * h[1], -h[0], h[2], h[3]))
        kept: list[tuple[int, int, str, float]] = []
        for c, _, name, start, end in hits:
            x = bisect_left(kept, (start,))
            if (x == 0 or kept[x - 1][1] <= start) and (x == len(kept) or kept[x][0] >= end):
                kept.insert(x, (start, end, name, c))
        return [{"license": name, "coverage": c, "start": start, "end": end} for start, end, name, c in kept]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE,
         deciding: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(id, license, coverage, n_hits, hits), one row for each input row, in the map stage of the scan.

    hits lists (license, coverage, start, end) in the order of the text; license and
    coverage are those of the best one (most words aligned, then the name), null without a
    hit. Each copy in a text is a hit of its own, copies one after the other too. Null and empty texts have none; rows with the same id stay rows of their own; null
    ids stay null; other columns are ignored. Templates, and the words that decide them, are constants of the code, or given.
    """
    own = DECIDING if templates is None and deciding is None else deciding or {}
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage, own)
        sizes = {name: len(t.words) for name, t in scanner.templates.items()}
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.column(1)]
            best = [max(h, key=lambda x: (x["coverage"] * sizes[x["license"]], x["coverage"]), default={}) for h in found]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([b.get("license") for b in best], pa.string()), pa.array([b.get("coverage") for b in best], pa.float64()),
                pa.array([len(h) for h in found], pa.int32()), pa.array(found, kind)], ["_id", "license", "coverage", "n_hits", "hits"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(
        run, f"_id {kind}, license string, coverage double, n_hits int, hits array<struct<license: string, coverage: double, start: int, end: int>>"
    ).withColumnRenamed("_id", id_col)
