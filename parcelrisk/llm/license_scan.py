"""License scan: Dice coefficient over word bigrams against license templates.

A text's units are its lines, its paragraphs of several lines (runs of lines
with words) and, if it has several paragraphs, the whole text.  A unit is
normalised (A-Z lower-cased, words of letters and digits) and compared with
each template by the Dice coefficient of the two bags of word bigrams.  With
sizes a and b the coefficient is at most 2 min(a, b) / (a + b), so only
templates of similar size are candidates: they are sorted by size, and a
binary search finds their range before the unit is normalised further.

Passages are windows of the whole word sequence, across lines and paragraphs,
that reach the same score: a notice within a long line, a license text in its
usual paragraphs amid other text.  Full license texts are templates for these
too.  A template is searched only where a window of permitted size holds enough
of its bigrams.  Its best windows that do not overlap are kept, and of
overlapping windows of different templates the one with the largest surplus of
shared over unshared bigrams.  A passage that is mostly within a unit reported
for the same license is not reported again.

Edge cases: a null or empty text, or one without words, has no unit.  Units or
templates of one word have the word itself as their only bigram; passages need
templates of two words or more.  Ties in
score go to the template whose name sorts first.  Rows are scanned one by one,
so null ids and repeated rows need no rule.  Other input columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import pkgutil
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col



def _gnu_notice(kind: str, version: str, work: str = "program") -> str:
    return (f"This {work} is free software: you can redistribute it and/or modify it under the terms "
            f"of the GNU {kind}General Public License as published by the Free Software Foundation, "
            f"either version {version} of the License, or (at your option) any later version. This "
            f"{work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
            "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
            f"See the GNU {kind}General Public License for more details. You should have received a copy "
            f"of the GNU {kind}General Public License along with this {work}. If not, see "
            "https://www.gnu.org/licenses/.")


# Notices and texts of well-known licenses.
TEMPLATES = (
    ("AGPL-3.0", _gnu_notice("Affero ", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use '
     "this file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
     'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
     "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
     "specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without "
     "modification, are permitted provided that the following conditions are met: 1. "
     "Redistributions of source code must retain the above copyright notice, this list of "
     "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce "
     "the above copyright notice, this list of conditions and the following disclaimer in the "
     "documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International "
     "License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
     "International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
     "International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related "
     "or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _gnu_notice("", "2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the "
     "terms of the GNU General Public License as published by the Free Software Foundation, either "
     "version 3 of the License, or (at your option) any later version. This program is distributed "
     "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
     "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
     "License for more details. You should have received a copy of the GNU General Public License "
     "along with this program. If not, see https://www.gnu.org/licenses/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with "
     "or without fee is hereby granted, provided that the above copyright notice and this "
     "permission notice appear in all copies."),
    ("LGPL-2.1", _gnu_notice("Lesser ", "2.1", "library")),
    ("LGPL-3.0", _gnu_notice("Lesser ", "3")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
     'software and associated documentation files (the "Software"), to deal in the Software '
     "without restriction, including without limitation the rights to use, copy, modify, merge, "
     "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
     "to whom the Software is furnished to do so, subject to the following conditions: The above "
     "copyright notice and this permission notice shall be included in all copies or substantial "
     'portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
     "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS "
     "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
     "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
     "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
     "USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. "
     "2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
     "https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
MIN_DICE = 0.8

_BSD_2, = (t for name, t in TEMPLATES if name == "BSD-2-Clause")
_BSD_3 = (" 3. Neither the name of the copyright holder nor the names of its contributors may be used to "
          "endorse or promote products derived from this software without specific prior written "
          "permission.")
_BSD_END = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR '
    "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
    "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER "
    "IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
    "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ISC, = (t for name, t in TEMPLATES if name == "ISC")
_ISC_END = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS '
    "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
    "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE "
    "OF THIS SOFTWARE.")
#: Licenses whose full text lies beside this file.
FULL_FILES = ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")


def full_texts() -> tuple[tuple[str, str], ...]:
    """Full license texts, the templates of passages besides ``TEMPLATES``."""
    return (("BSD-2-Clause", _BSD_2 + _BSD_END), ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_END),
            ("ISC", _ISC + _ISC_END),
            *((n, pkgutil.get_data(__package__, f"licenses/{n}.txt").decode()) for n in FULL_FILES))


_KEPT = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEPT else 0x20 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def bigrams(words: list[bytes]) -> list:
    return list(zip(words, words[1:])) if len(words) > 1 else list(words)


class Templates:
    """Templates sorted by size, and the sizes a unit must have for each."""

    def __init__(self, templates, min_dice: float):
        bags = sorted(((len(b), name, Counter(b)) for name, t in templates
                       if (b := bigrams(words_of(t)))), key=lambda x: (x[0], x[1]))
        self.sizes = [n for n, _, _ in bags]
        self.names = [name for _, name, _ in bags]
        self.bags = [bag for _, _, bag in bags]
        self.min_dice = min_dice
        self.any = {g for bag in self.bags for g in bag}

    def candidates(self, n: int) -> range:
        """Templates whose size lets a unit of ``n`` bigrams reach the score."""
        t = self.min_dice
        low, high = n * t / (2 - t), n * (2 - t) / t
        return range(bisect_left(self.sizes, low - 1e-9), bisect_right(self.sizes, high + 1e-9))

    def best(self, words: list[bytes]) -> tuple[str, float] | None:
        n = max(len(words) - 1, min(len(words), 1))
        near = self.candidates(n) if n else ()
        if not near:
            return None
        mine = [g for g in bigrams(words) if g in self.any]
        if 2 * len(mine) < self.min_dice * (n + self.sizes[near[0]]):
            return None
        bag, found = Counter(mine), None
        for k in near:
            theirs = self.bags[k]
            both = sum(min(c, theirs[g]) for g, c in bag.items() if g in theirs)
            dice = 2 * both / (n + self.sizes[k])
            if dice >= self.min_dice and (found is None or (-dice, self.names[k]) < (
                    -found[1], found[0])):
                found = self.names[k], dice
        return found


def units(text: str) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first line, last line exclusive, words) of the lines, the paragraphs of
    several lines and the whole text."""
    lines = [words_of(x) for x in text.split("\n")]
    start, several = None, 0
    for i, w in enumerate([*lines, []]):
        if w:
            start = i if start is None else start
            yield i, i + 1, w
        elif start is not None:
            several += 1
            if i - start > 1:
                yield start, i, [x for y in lines[start:i] for x in y]
            start = None
    if several > 1:
        yield 0, len(lines), [x for y in lines for x in y]


class Passages:
    """Windows of a word sequence that reach the score with a template."""

    def __init__(self, templates, min_dice: float):
        self.min_dice = t = min_dice
        self.known, self.posts = [], defaultdict(list)
        for name, text in templates:
            if len(w := words_of(text)) > 1:
                bag = Counter(bigrams(w))
                m = len(w) - 1
                # a window's size, and the bigrams it must share, at this score
                need, longest = max(math.ceil(m * t / (2 - t) - 1e-9), 1), int(m * (2 - t) / t + 1e-9)
                for g, c in bag.items():
                    self.posts[g].append((len(self.known), c))
                self.known.append((name, m, bag, need, longest))
        self.fewest = min((k[3] for k in self.known), default=math.inf)

    def find(self, words: list[bytes]) -> list[tuple[int, int, str, float]]:
        """(first word, last word exclusive, license, dice), none overlapping."""
        posts = self.posts
        places = [p for p, g in enumerate(zip(words, words[1:])) if g in posts]
        if len(places) < self.fewest:
            return []
        at, shared = defaultdict(list), Counter()
        for p in places:
            at[words[p], words[p + 1]].append(p)
        for g, where in at.items():
            for k, c in posts[g]:
                shared[k] += min(c, len(where))
        found = []
        for k, n in shared.items():
            name, m, bag, need, _ = self.known[k]
            if n >= need:
                for start, end, both in self._windows(at, *self.known[k][1:]):
                    size = end - start - 1
                    dice = 2 * both / (size + m)
                    found.append((size + m - 3 * both, -dice, name, start, end))
        found.sort()
        taken: list[tuple[int, int]] = []
        out = []
        for _, less, name, start, end in found:
            if _free(taken, start, end):
                taken.insert(bisect_left(taken, (start, end)), (start, end))
                out.append((start, end, name, -less))
        return sorted(out)

    def _windows(self, at, m, bag, need, longest):
        """The best windows of one template: (first word, end, shared bigrams)."""
        rows = sorted((p, where[i - c] if i >= c else -1) for g, c in bag.items()
                      if (where := at.get(g)) for i, p in enumerate(where))
        # a place counts in a window unless the gram's count is used up within:
        # unless the place that many occurrences before lies in the window too
        place, used = np.array(rows, dtype=np.int64).T
        if len(rows) < need:
            return []

        def best(i: int, limit: int):
            """The best window from place ``i`` that ends before word ``limit``."""
            first = place[i]
            end = np.searchsorted(place, min(first + longest, limit - 1))
            if end - i < need:
                return None
            both = np.cumsum(used[i:end] < first)
            dice = 2 * both / (place[i:end] - first + 1 + m)
            j = int(dice.argmax())
            if dice[j] < self.min_dice:
                return None
            return -float(dice[j]), int(first), int(place[i + j]) + 2, int(both[j]), i

        dense = np.flatnonzero(place[need - 1:] - place[:len(place) - need + 1] < longest)
        heap = [w for i in dense.tolist() if (w := best(i, int(place[-1]) + 2))]
        heapq.heapify(heap)
        taken: list[tuple[int, int]] = []
        out = []
        while heap:
            _, start, end, both, i = heapq.heappop(heap)
            if _free(taken, start, end):
                taken.insert(bisect_left(taken, (start, end)), (start, end))
                out.append((start, end, both))
            elif _free(taken, start, start + 1):      # a shorter one may fit
                after = taken[bisect_left(taken, (start,))][0]
                if w := best(i, after):
                    heapq.heappush(heap, w)
        return out


def _free(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether no range of the sorted, disjoint ``taken`` meets [start, end)."""
    k = bisect_left(taken, (end,))
    return k == 0 or taken[k - 1][1] <= start


def passages(text: str, hits, known: Passages) -> Iterator[tuple[int, int, str, float]]:
    """(first line, last line exclusive, license, dice) of the windows that no
    unit of ``hits`` reports."""
    lines = [words_of(x) for x in text.split("\n")]
    found = known.find([x for y in lines for x in y])
    if not found:
        return
    offset = [0, *accumulate(map(len, lines))]
    for start, end, name, dice in found:
        if not any(name == h[2] and 2 * (min(end, offset[h[1]]) - max(start, offset[h[0]])) >= end - start
                   for h in hits):
            yield bisect_right(offset, start) - 1, bisect_left(offset, end), name, dice


_HIT = T.ArrayType(T.StructType([
    T.StructField("first_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()),
    T.StructField("license", T.StringType()), T.StructField("dice", T.DoubleType())]))
_HIT_ARROW = pa.list_(pa.struct([("first_line", pa.int32()), ("end_line", pa.int32()),
                                 ("license", pa.string()), ("dice", pa.float64())]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates=TEMPLATES, min_dice: float = MIN_DICE, full=None) -> DataFrame:
    """One row per document: id, and two arrays of (first_line, end_line,
    license, dice) in the order of their lines: ``hits``, the lines, paragraphs
    and whole texts, and ``passages``, the windows found besides (``full``:
    templates of these only, by default ``full_texts()``)."""
    src = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType),
                           T.StructField("hits", _HIT), T.StructField("passages", _HIT)])
    full = full_texts() if full is None else full

    def run(batches):
        known, wide = Templates(templates, min_dice), Passages((*templates, *full), min_dice)
        fields = "first_line", "end_line", "license", "dice"
        for b in batches:
            out, more = [], []
            for text in b.column(1).to_pylist():
                hits = [(s, e, *found) for s, e, w in units(text or "")
                        if (found := known.best(w))]
                hits.sort()
                out.append([dict(zip(fields, h)) for h in hits])
                more.append([dict(zip(fields, h)) for h in passages(text or "", hits, wide)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(out, _HIT_ARROW), pa.array(more, _HIT_ARROW)],
                ["id", "hits", "passages"])

    return src.mapInArrow(run, schema).select(F.col("id").alias(id_col), "hits", "passages")
