"""License scans: MinHash bands retrieve templates, exact shingle containment verifies them in windows at every start.

Templates of similar length share a window: as many words as the longest of them and a stride more, which leaves room for
words that were inserted. A band is a template's least shingle under one order. There are as many bands as keep the chance
of a window sharing none under ``MISS``, and more until every template has more different least shingles than a match can
lack, so that no match is lost. Templates are few and fixed, so they travel with the code, and documents are not shuffled.

Words are lower-cased (A-Z) and stripped of ASCII punctuation at both ends. Where a document has a least
shingle of a template, the share of the template's distinct shingles is counted in every window that starts with one of them;
other windows hold no more. Of windows with the largest share the first is reported.

Defined results: null text has no words and no license; a template shorter than a shingle is one shingle of all its words, one
without words matches nothing; repeated rows are scanned alike; columns besides doc_id and text are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, released, slices
from .words import Words, mixed, shingles

SHINGLE, CONTAINMENT, MISS = 5, 0.75, 1e-3
#: Public notices by SPDX id; several notices of a license are numbered.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT/2": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "Apache-2.0/2": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
    ),
    "GPL-3.0/2": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    ),
    "MIT/3": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        "AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
        "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Apache-2.0/3": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0/3": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with "
        "this program. If not, see https://www.gnu.org/licenses/."
    ),
    "Zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission "
        "is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The "
        "origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This "
        "notice may not be removed or altered from any source distribution."
    ),
}


def _words(texts: list[bytes]) -> Words:
    return Words(pa.array(texts, pa.binary()), lower=True, strip=True)


class _Group:
    """Templates of similar length and of shingles of one size, with their window and bands."""

    def __init__(self, templates: list[tuple[int, str, np.ndarray]], size: int, containment: float):
        longest = max(n for n, _, _ in templates)
        # an exact match of one shingle needs no room
        self.window = longest + max(3, longest // 4) if size == SHINGLE else longest
        self.size, self.templates = size, [(name, own) for _, name, own in templates]
        n = self.window - size + 1
        similar = min(containment * len(s) / (n + (1 - containment) * len(s)) for _, s in self.templates)
        bands = math.ceil(math.log(MISS) / math.log(1 - similar)) if similar < 1 else 1
        while True:
            seeds = mixed(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            least = [[own[mixed(own ^ seed).argmin()] for seed in seeds] for _, own in self.templates]
            # a match holds at least one of its template's least shingles if these outnumber what it may lack
            if all(len(set(x)) > len(own) - math.ceil(containment * len(own)) for x, (_, own) in zip(least, self.templates)):
                break
            bands += 1
        self.least = np.array(least)
        self.anchors = np.unique(self.least)
        self.table = np.zeros(1 << 16, bool)
        self.table[self.anchors & np.uint64(0xFFFF)] = True


class Scanner:
    """Templates grouped by length."""

    def __init__(self, templates: Mapping[str, str], containment: float = CONTAINMENT):
        self.containment = containment
        w = _words([t.encode() for t in templates.values()])
        sized = []
        for k, name in enumerate(templates):
            h = w.row(k)
            if len(h):
                sized.append((len(h), name, np.unique(shingles(h, min(SHINGLE, len(h))))))
        self.groups = []
        while sized:
            n = min(sized)[0]
            most = n if n < SHINGLE else 2 * n
            self.groups.append(_Group([x for x in sized if x[0] <= most], min(SHINGLE, n), containment))
            sized = [x for x in sized if x[0] > most]

    def scan(self, column: pa.Array) -> list[tuple[int, list[tuple[str, int, float]]]]:
        """For each text (words, [(template, first word of the best window, containment)])."""
        w = Words(column, lower=True, strip=True)
        found: list[dict[str, tuple[float, int]]] = [{} for _ in range(len(column))]
        for size in sorted({g.size for g in self.groups}):
            s = shingles(w.hashes, size)
            for g in (g for g in self.groups if g.size == size):
                at = np.flatnonzero(g.table[s & np.uint64(0xFFFF)])
                at = at[np.isin(s[at], g.anchors)]
                # a shingle lies in the text that its first word is in
                row = np.searchsorted(w.first, at, side="right") - 1
                for k in np.unique(row[at + size <= w.first[row + 1]]).tolist():
                    own_s = s[w.first[k] : w.first[k + 1] - size + 1]
                    for t in np.flatnonzero(np.isin(g.least, own_s).any(axis=1)):
                        name, own = g.templates[t]
                        share, start = self.best(own_s, own, g.window - size + 1)
                        if share >= self.containment:
                            found[k][name] = (share, start)
        return [(n, sorted((name, a, share) for name, (share, a) in f.items())) for n, f in zip(np.diff(w.first).tolist(), found)]

    def best(self, s: np.ndarray, own: np.ndarray, n: int) -> tuple[float, int]:
        """The largest share of ``own`` in n shingles of ``s`` that follow each other, and the first start of such ones."""
        at = np.flatnonzero(np.isin(s, own))
        which = np.searchsorted(own, s[at]).tolist()
        at = at.tolist()
        if len(set(which)) / len(own) < self.containment:
            return 0.0, 0
        count, held, most, start, end = [0] * len(own), 0, 0, 0, 0
        for i, a in enumerate(at):
            while end < len(at) and at[end] < a + n:
                count[which[end]] += 1
                held += count[which[end]] == 1
                end += 1
            if held > most:
                most, start = held, a
            count[which[i]] -= 1
            held -= count[which[i]] == 0
        return most / len(own), start


_scanners: dict[tuple, Scanner] = {}


def scan(docs: DataFrame, templates: Mapping[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, licenses (ids joined by commas, sorted), n_templates, containment (the largest), matches (template@word=containment, joined by semicolons)."""
    key = (tuple((templates or TEMPLATES).items()), containment)
    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scanners:
            _scanners[key] = Scanner(dict(key[0]), key[1])
        scanner = _scanners[key]
        for batch in slices(batches, "text", 1 << 23):
            rows = scanner.scan(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([n for n, _ in rows], pa.int64()),
                    pa.array([",".join(sorted({name.split("/")[0] for name, _, _ in f})) for _, f in rows], pa.string()),
                    pa.array([len(f) for _, f in rows], pa.int32()),
                    pa.array([max((c for _, _, c in f), default=0.0) for _, f in rows], pa.float64()),
                    pa.array([";".join(f"{name}@{a}={c:.4f}" for name, a, c in f) for _, f in rows], pa.string()),
                ],
                ["doc_id", "n_words", "licenses", "n_templates", "containment", "matches"],
            )
        released()

    return source.mapInArrow(run, f"doc_id {kind}, n_words long, licenses string, n_templates int, containment double, matches string")


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
