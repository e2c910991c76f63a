"""License notices found by their wording, with the bytes that each saves as a compression dictionary."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import buffer, mapped, slices, word_hashes, words

#: Names of licenses and wordings of their notices as published; several notices may name one license.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-2-Clause", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
]
#: The share of a notice's words that may differ.
MAY_DIFFER = 0.2
_WORD = regex.compile(r"[^\x20\x09-\x0D]+")
#: Stretches of words whose result a worker remembers.
REMEMBERED = 50_000
_MARKS = ".,;:!?()[]{}<>\"'*#/-"
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(_MARKS.encode())] = True
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def wording(text: str) -> list[str]:
    """Words, with A-Z in lower case, without punctuation at their ends."""
    return [w for w in (x.strip(_MARKS).translate(_ASCII_LOWER) for x in _WORD.findall(text)) if w]


def word_differences(a: list[str], b: list[str]) -> int:
    """Words to replace, remove or add to make one wording the other."""
    return sum(max(i2 - i1, j2 - j1) for tag, i1, i2, j1, j2 in SequenceMatcher(None, a, b, False).get_opcodes() if tag != "equal")


def nearest_spans(words: list[str], notice: list[str], may_differ: int) -> Iterator[tuple[int, int, int]]:
    """(differing words, start, end) of the spans of words that are within ``may_differ`` of a notice, the best for each end.

    A column of the table of edit distances holds (differences, -start) for each number of the notice's words.
    """
    m = len(notice)
    column = [(i, 0) for i in range(m + 1)]
    for end, word in enumerate(words, 1):
        before, column = column, [(0, -end)]
        for i in range(1, m + 1):
            d, start = before[i - 1]
            column.append(min((d + (notice[i - 1] != word), start), (before[i][0] + 1, before[i][1]), (column[i - 1][0] + 1, column[i - 1][1])))
        if column[m][0] <= may_differ:
            yield column[m][0], -column[m][1], end


class Scanner:
    def __init__(self, notices: list[tuple[str, str]]):
        self.notices = [(name, wording(text)) for name, text in notices]
        plain = [" ".join(w).encode() for _, w in self.notices]
        self.alone = zstandard.ZstdCompressor(level=19)
        self.given = []
        for text in plain:
            content = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given.append(zstandard.ZstdCompressor(level=19, dict_data=content))
        self.known: dict[str, tuple | None] = {}
        self.found: dict[tuple, list[tuple]] = {}
        vocabulary = sorted({w for _, notice in self.notices for w in notice})
        raw = [w.encode() for w in vocabulary]
        ends = np.cumsum([len(w) for w in raw])
        hashes = word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        #: For each notice, of which words of the vocabulary it is made (the last entry is for all other words).
        self.made_of = np.zeros((len(self.notices), len(vocabulary) + 1), np.uint8)
        for i, (_, notice) in enumerate(self.notices):
            self.made_of[i, :-1] = [vocabulary[k] in notice for k in order.tolist()]
        # of any t + 1 different words of a notice, a span within t differences has one: the longest ones are the rarest
        place = {vocabulary[k]: n for n, k in enumerate(order.tolist())}
        self.anchors = np.zeros(self.made_of.shape, bool)
        for i, (_, notice) in enumerate(self.notices):
            few = sorted(set(notice), key=lambda w: (-len(w), w))[: int(MAY_DIFFER * len(notice)) + 1]
            self.anchors[i, [place[w] for w in few]] = len(few) > int(MAY_DIFFER * len(notice))
            self.anchors[i, :-1] |= len(few) <= int(MAY_DIFFER * len(notice))

    def reductions(self, block: bytes) -> list[int]:
        """Bytes that each notice as dictionary takes off the compressed block."""
        size = len(self.alone.compress(block))
        return [size - len(g.compress(block)) for g in self.given]

    def judge(self, block: str) -> tuple | None:
        """(license, notice, bytes saved, differing words) of a block as a whole, or None if no notice's wording is near."""
        if block not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            words = wording(block)
            tried = [(i, MAY_DIFFER * len(notice)) for i, (_, notice) in enumerate(self.notices)]
            # no alignment has fewer differing words than the lengths and the words in common leave
            tried = [(i, most) for i, most in tried if abs(len(words) - len(self.notices[i][1])) <= most]
            bag = Counter(words) if tried else Counter()
            tried = [(i, most) for i, most in tried if max(len(words), len(self.notices[i][1])) - (bag & Counter(self.notices[i][1])).total() <= most]
            fits = [(d, i) for i, most in tried if (d := word_differences(words, self.notices[i][1])) <= most]
            saved = self.reductions(" ".join(words).encode()) if fits else []
            fits = [(d, -saved[i], i) for d, i in fits]
            best = min(fits, default=None)
            self.known[block] = best and (self.notices[best[2]][0], best[2], -best[1], best[0])
        return self.known[block]

    def near(self, col: pa.Array) -> dict[int, list[tuple[int, int, int]]]:
        """By row: (first word, end, notice) of the stretches that hold enough of a notice's words to have it within its tolerance.

        A span within t differences of a notice of m words has m + t words at most, of which m - t are the notice's, among them one
        of its anchors. No other spans can match, so nothing is lost. Words are those of ``wording``.
        """
        data, offsets = buffer(col)
        low = _LOWER[data]
        begin, end, first = words(low, offsets)
        if not len(begin):
            return {}
        letters = np.flatnonzero(~_IS_MARK[low])
        some = np.flatnonzero(_IS_MARK[low[begin]] | _IS_MARK[low[end - 1]])
        if len(some):
            lo, hi = (np.searchsorted(letters, x[some]) for x in (begin, end))
            full = lo < hi
            begin[some[full]], end[some[full]] = letters[lo[full]], letters[hi[full] - 1] + 1
            gone = some[~full]
            begin, end = np.delete(begin, gone), np.delete(end, gone)
            first = first - np.searchsorted(gone, first)
        if not len(begin):
            return {}
        hashes = word_hashes(low, begin, end)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        at[self.hashes[at] != hashes] = -1
        every = np.repeat(np.arange(len(first) - 1), np.diff(first))
        there = np.bincount(at + 1, minlength=len(self.hashes) + 1)[1:] > 0  # of the words, without those that no notice has
        out: dict[int, list[tuple[int, int, int]]] = {}
        for i in np.flatnonzero((self.anchors[:, :-1] & there).any(1)).tolist():
            notice, rows = self.notices[i][1], np.unique(every[self.anchors[i][at]])
            most, n = int(MAY_DIFFER * len(notice)), first[rows + 1] - first[rows]
            # the words of these rows alone, each row from its own beginning
            begin = np.cumsum(n) - n
            own = np.repeat(first[rows] - begin, n) + np.arange(n.sum())
            stop, row = np.repeat(begin + n, n), np.repeat(rows, n)
            seen = np.concatenate([[0], np.cumsum(self.made_of[i][at[own]], dtype=np.int64)])
            reach = np.minimum(np.arange(len(own)) + len(notice) + most, stop)
            starts = np.flatnonzero(seen[reach] - seen[:-1] >= len(notice) - most)
            if not len(starts):
                continue
            new = np.ones(len(starts), bool)
            new[1:] = (starts[1:] > reach[starts[:-1]]) | (row[starts[1:]] != row[starts[:-1]])
            heads = np.flatnonzero(new)
            shift = np.repeat(begin, n)
            for a, b in zip(starts[heads].tolist(), reach[starts[np.append(heads[1:], len(starts)) - 1]].tolist()):
                out.setdefault(int(row[a]), []).append((a - int(shift[a]), b - int(shift[a]), i))
        return out

    def scan(self, text: str) -> list[tuple]:
        """(first line, lines, license, notice, bytes saved, differing words) of each notice, in order."""
        return self.inside(text, self.near(pa.array([text], pa.string())).get(0, []))

    def inside(self, text: str, near: list[tuple[int, int, int]]) -> list[tuple]:
        """The notices of a text, of which ``near`` are the stretches to look at.

        Every notice with a stretch is compared with it word by word, whatever its rank, and confirmed by the words that differ. Of
        overlapping spans the one with most matching less differing words stays, then the one whose notice takes most off the
        compressed stretch, then the earlier notice.
        """
        if not near:
            return []
        words, line_of = [], []
        for k, line in enumerate(text.split("\n")):
            some = wording(line)
            words += some
            line_of += [k] * len(some)
        out, at = [], 0
        near = sorted(near)
        while at < len(near):
            low, high = near[at][:2]
            stop = at
            while stop < len(near) and near[stop][0] <= high:
                high, stop = max(high, near[stop][1]), stop + 1
            key = (tuple(words[low:high]), tuple((a - low, b - low, i) for a, b, i in near[at:stop]))
            if key not in self.found:
                if len(self.found) >= REMEMBERED:
                    self.found.clear()
                self.found[key] = self.settled(*key)
            for a, b, i, saved, d in self.found[key]:
                top, last = line_of[low + a], line_of[low + b - 1]
                out.append((top, last - top + 1, self.notices[i][0], i, saved, d))
            at = stop
        return out

    def settled(self, words: tuple[str, ...], near: tuple[tuple[int, int, int], ...]) -> list[tuple[int, int, int, int, int]]:
        """(start, end, notice, bytes saved, differing words) of the notices in a stretch of words, in order."""
        spans = []
        for low, high, i in near:
            notice = self.notices[i][1]
            spans += [(2 * d - len(notice), d, low + a, low + b, i) for d, a, b in nearest_spans(words[low:high], notice, int(MAY_DIFFER * len(notice)))]
        if not spans:
            return []
        rank = self.reductions(" ".join(words).encode())
        out: list[tuple[int, int, int, int, int]] = []
        for _, d, a, b, i in sorted(spans, key=lambda x: (x[0], x[1], -rank[x[4]], x[4], x[2])):
            if not any(a < y and x < b for x, y, *_ in out):
                out.append((a, b, i, self.reductions(" ".join(words[a:b]).encode())[i], d))
        return sorted(out)


@lru_cache(4)
def scanner(notices: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(list(notices))


FOUND = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("line", T.IntegerType()), ("n_lines", T.IntegerType()), ("license", T.StringType()), ("notice", T.IntegerType()), ("saved_bytes", T.IntegerType()), ("n_differences", T.IntegerType()))]))
_ARROW = pa.list_(pa.struct([("line", pa.int32()), ("n_lines", pa.int32()), ("license", pa.string()), ("notice", pa.int32()), ("saved_bytes", pa.int32()), ("n_differences", pa.int32())]))


def license_notices(docs: DataFrame, text_col: str = "text", notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """``docs`` with ``notices`` in place of the text: the license notices of each row, in order of their lines.

    A notice is a span of words, in one line or over several, that differs from a published wording in a fifth of its words at
    most (words replaced, removed or added; case and punctuation at words' ends do not count). Every span of the text is
    judged: those that cannot match are ruled out by counting each notice's words, which loses none; the stretches that are left
    are compressed with each notice as raw dictionary, and the notices are confirmed by their differing words. Of overlapping
    spans the one with the most matching less differing words stays; ties go to the larger saving, then to the earlier notice.

    Null and empty texts have no notices; repeated rows each have theirs; an empty table gives an empty result; texts of any length
    are read whole, in memory that grows with the longest text. Other columns stay; one named ``notices`` is replaced. Every
    row is on its own, without a shuffle.
    """
    known = tuple(notices or NOTICES)
    stay = [c for c in docs.columns if c not in (text_col, "notices")]
    docs = docs.select(*stay, text_col)
    schema = docs.select(*stay).schema.add("notices", FOUND)
    names = [f.name for f in FOUND.elementType]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(known)
        for part in slices(batches, text_col):
            texts = part.column(text_col)
            near = scan.near(texts)
            found = [[dict(zip(names, f)) for f in scan.inside(texts[k].as_py(), near[k])] if k in near else [] for k in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in stay), pa.array(found, _ARROW)], [*stay, "notices"])

    return docs.transform(mapped, work, schema)
