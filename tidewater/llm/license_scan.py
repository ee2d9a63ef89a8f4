"""License scans by patience alignment.

A text and a license template are aligned over their words (A-Z lower-cased, other ASCII than letters and digits left
out at a word's ends; "v2.0", "2.0" and "2" are one version). Words that occur once in both are anchors; the longest increasing subsequence of their positions
is kept, and the gaps between kept anchors, where other words may have become unique, are aligned in the same way.
Around each anchor and at the ends of a gap equal neighbours are matched as well. The coverage of a template is the
share of its words that are aligned. A license is found where that is at least `min_coverage` and none of the wordings that
tell licenses apart (name, version, BY/NC/SA, clauses: KEYS) is missing or contradicted: at least half of a wording's words
are aligned, and no other telling word stands between them or in the place of one that isn't. Templates of up to SHORT
words say little else, so that their wordings must be aligned word for word.

Before aligning, the number of a template's words that a text could give at most (its multiset intersection) is taken
from hashed counts; a text below `min_coverage` there can't reach it by an alignment, and only such pairs are left out.
Then the shortest runs of a text that still hold `min_coverage` of a template's words, wherever they start, are found by
two moving ends, and each is aligned alone and with more of the template's words to both sides (WIDER). The ends move on
by an eighth of the template's words from one alignment to the next, so that work is in proportion to the text. Words of
no use to the template are no obstacle, as long as the aligned words make up MIN_DENSITY of the words that they span.

Defined cases: a null or empty text has no license. Of several licenses the one with the most aligned words is named, then
that with more wordings aligned word for word, then the first by name. Repeated rows get a row each.
"""

from __future__ import annotations

import bisect
import math
import pkgutil
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.textkernel import Chunk, chunks

MIN_COVERAGE, MIN_DENSITY = 0.8, 0.2
#: Alignments of a run a template, and by what part of the template's words each is wider than the run on both sides.
WIDER = (0, 1 / 3, 1)
#: Templates of up to so many words without a key must be aligned in full.
SHORT = 15
MEMO_WORDS = 500_000
#: Wordings by which licenses are stated, by name.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
#: Name of a line, how the license is named in it (with its version, if any), and its SPDX identifiers.
_NAMED = {
    "mit": ("MIT License", ["MIT"]), "isc": ("ISC License", ["ISC"]), "bsd": ("BSD License", ["BSD-2-Clause", "BSD-3-Clause"]),
    "apache-1.1": ("Apache License, Version 1.1", ["Apache-1.1"]), "apache-2.0": ("Apache License, Version 2.0", ["Apache-2.0"]),
    "gpl-2.0": ("GNU General Public License, version 2", ["GPL-2.0-only", "GPL-2.0-or-later"]), "gpl-3.0": ("GNU General Public License, version 3", ["GPL-3.0-only", "GPL-3.0-or-later"]),
    "lgpl-2.1": ("GNU Lesser General Public License, version 2.1", ["LGPL-2.1-only", "LGPL-2.1-or-later"]), "lgpl-3.0": ("GNU Lesser General Public License, version 3", ["LGPL-3.0-only", "LGPL-3.0-or-later"]),
    "agpl-3.0": ("GNU Affero General Public License, version 3", ["AGPL-3.0-only", "AGPL-3.0-or-later"]), "mpl-2.0": ("Mozilla Public License, version 2.0", ["MPL-2.0"]),
}
KEYS = {
    "mit": ["this permission notice"], "apache-2.0": ["apache license version 2"], "gpl-3.0-or-later": ["gnu general public license", "version 3", "any later version"],
    "bsd-2-clause": ["redistributions in binary form"], "mpl-2.0": ["mozilla public license v 2"],
}
for _name, (_stated, _ids) in _NAMED.items():
    TEMPLATES.setdefault(f"{_name}-line", f"Licensed under the {_stated}.")
    KEYS[f"{_name}-line"] = [_stated]
    for _id in _ids:
        TEMPLATES[f"{_id.lower()}-spdx"] = f"SPDX-License-Identifier: {_id}"
#: Names of licenses as short statements have them.
_SHORT_NAMES = {
    "gpl-2.0": ["GPLv2", "GNU GPL v2"], "gpl-3.0": ["GPLv3", "GNU GPL v3"], "lgpl-2.1": ["LGPLv2.1"], "lgpl-3.0": ["LGPLv3"], "agpl-3.0": ["AGPLv3"],
    "boost-1.0": ["Boost Software License"], "epl-2.0": ["Eclipse Public License v2.0"], "unlicense": ["Unlicense"],
}
for _name, _shorts in _SHORT_NAMES.items():
    for _i, _short in enumerate(_shorts):
        for _verb in ("Licensed", "Released"):
            TEMPLATES[f"{_name}-{_verb.lower()}-{_i}"] = f"{_verb} under {_short}."
            KEYS[f"{_name}-{_verb.lower()}-{_i}"] = [_short]
for _kind, _long in {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}.items():
    for _version in ("3.0", "4.0"):
        TEMPLATES.setdefault(f"cc-{_kind}-{_version}-line", f"Licensed under CC {_kind.upper()} {_version}.")
        KEYS[f"cc-{_kind}-{_version}-line"] = [f"CC {_kind.upper()} {_version}"]
        TEMPLATES[f"cc-{_kind}-{_version}-notice"] = f"This work is licensed under a Creative Commons {_long} {_version} License."
        KEYS[f"cc-{_kind}-{_version}-notice"] = [f"Creative Commons {_long} {_version}"]
for _name, _title, _version, _prefix in (("gpl-2.0", "GNU General Public License", "2", ""), ("lgpl-2.1", "GNU Lesser General Public License", "2.1", ""), ("lgpl-3.0", "GNU Lesser General Public License", "3", ""), ("agpl-3.0", "GNU Affero General Public License", "3", "")):
    TEMPLATES[f"{_name}-or-later"] = TEMPLATES["gpl-3.0-or-later"].replace("GNU General Public License", _title).replace("version 3", f"version {_version}")
    KEYS[f"{_name}-or-later"] = [_title, f"version {_version}", "any later version"]
for _name in ("gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0"):
    TEMPLATES[f"{_name}-only"] = TEMPLATES[f"{_name}-or-later"].replace("either ", "", 1).replace(", or (at your option) any later version", "")
    KEYS[f"{_name}-only"] = [*KEYS[f"{_name}-or-later"][:2], "license this program is distributed"]
_DISCLAIMER = (" THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
TEMPLATES |= {
    "mit-text": TEMPLATES["mit"] + " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-clause-text": TEMPLATES["bsd-2-clause"] + _DISCLAIMER,
    "bsd-3-clause-text": TEMPLATES["bsd-2-clause"] + _THIRD + _DISCLAIMER,
    "bsd-3-clause": TEMPLATES["bsd-2-clause"] + _THIRD,
}
KEYS |= {"mit-text": ["this permission notice"], "isc-text": ["this permission notice appear"], "bsd-2-clause-text": ["the distribution this software"], "bsd-3-clause-text": ["endorse or promote"], "bsd-3-clause": ["endorse or promote"]}
#: Whole texts, from the files beside; a title is not needed, as excerpts often lack it.
for _file, _keys in {"Apache-2.0": [], "GPL-2": [], "GPL-3": ["The GNU General Public License is a free"], "LGPL-2.1": ["GNU Lesser General Public License"], "LGPL-3": [], "MPL-2.0": [], "CC0-1.0": []}.items():
    TEMPLATES[f"{_file.lower()}-text"] = pkgutil.get_data(__package__, f"licenses/{_file}.txt").decode()
    KEYS[f"{_file.lower()}-text"] = _keys
#: Words that tell licenses apart, besides numbers.
TELLING = frozenset(b"mit isc bsd apache lesser library affero mozilla cc nc sa nd noncommercial sharealike noderivatives noderivs endorse later gplv2 gplv3 lgplv2.1 lgplv3 agplv3 boost eclipse unlicense".split())
_EDGE = bytes(i for i in range(33, 128) if not chr(i).isalnum())
_VERSION = re.compile(rb"v?(\d+(?:\.\d+)*?)(?:\.0)*")


def core(word: bytes) -> bytes:
    word = word.lower().strip(_EDGE)
    version = _VERSION.fullmatch(word)
    return version[1] if version else b"license" if word == b"licence" else word


def telling(word: bytes) -> bool:
    return word in TELLING or word[:3] in (b"by-", b"cc-") or _VERSION.fullmatch(word) is not None


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence (patience sorting)."""
    tops: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        pile = bisect.bisect_left(tops, v)
        before.append(last[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            last.append(i)
        else:
            tops[pile], last[pile] = v, i
    out, at = [], last[-1] if last else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def patience_align(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of aligned positions of a and b, increasing in both."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in where]
        kept = [anchors[k] for k in longest_increasing([j for _, j in anchors])]
        if not kept:
            continue
        out += kept
        ends = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:], strict=False) if k > i + 1 and m > j + 1]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], min_coverage: float, keys: dict[str, list[str]] | None = None):
        self.names = list(templates)
        self.words = [[w for w in map(core, templates[n].encode().split()) if w] for n in self.names]
        self.min_coverage = min_coverage
        vocabulary = sorted({w for words in self.words for w in words})
        self.number = {w: i + 1 for i, w in enumerate(vocabulary)}  # 0: in no template
        self.other = len(vocabulary) + 1  # a telling word that is in no template
        self.telling = np.array([False, *map(telling, vocabulary), True])
        self.need = np.zeros((len(vocabulary) + 2, len(self.names)), np.int64)
        for t, words in enumerate(self.words):
            for w, n in Counter(words).items():
                self.need[self.number[w], t] = n
        self.sizes = np.array([len(w) for w in self.words])
        self.coded = [[self.number[w] for w in words] for words in self.words]
        self.counts = [Counter(words) for words in self.coded]
        # For each key of a template its places there; a key that the template does not hold is no key.
        keys = KEYS if keys is None else keys
        self.keys = []
        for name, words in zip(self.names, self.words, strict=True):
            sought = [[w for w in map(core, key.encode().split()) if w] for key in keys.get(name, [])]
            places = [[range(i, i + len(k)) for i in range(len(words) - len(k) + 1) if words[i : i + len(k)] == k] for k in sought]
            self.keys.append([p for p in places if p] if len(words) > SHORT or any(places) else [[range(len(words))]])
        self.memo: dict[int, int] = {}

    def scan(self, chunk: Chunk) -> list[list[tuple]]:
        """For each row the licenses found: (name, coverage, first word, last word, confirmed keys), best first."""
        start, end, row = chunk.words()
        out: list[list[tuple]] = [[] for _ in range(chunk.rows)]
        if not len(start):
            return out
        keys, at, which = np.unique(chunk.hash_spans(chunk.prefix_hash(lower=True), start, end), return_index=True, return_inverse=True)
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        raw, names = chunk.data.tobytes(), keys.tolist()
        for i, k in enumerate(names):
            if k not in self.memo:
                word = core(raw[start[at[i]] : end[at[i]]])
                self.memo[k] = self.number.get(word, self.other if telling(word) else 0)
        code = np.fromiter(map(self.memo.__getitem__, names), np.int64, len(names))[which]
        known = code > 0
        width = len(self.need)
        cells, counts = np.unique(row[known] * width + code[known], return_counts=True)
        most = np.zeros((chunk.rows, len(self.names)), np.int64)
        of_row, of_word = cells // width, cells % width
        for t in range(len(self.names)):
            most[:, t] = np.bincount(of_row, np.minimum(counts, self.need[of_word, t]), chunk.rows)
        first = np.searchsorted(row, np.arange(chunk.rows + 1))
        for r, t in zip(*np.nonzero(most >= self.min_coverage * self.sizes), strict=True):
            found = self._best(code[first[r] : first[r + 1]], int(t))
            if found:
                out[r].append((self.names[t], *found))
        for found in out:
            found.sort(key=lambda f: (-round(f[1] * len(self.words[self.names.index(f[0])])), -f[4], f[0]))
        return out

    def _runs(self, usable: list[int], t: int) -> Iterator[tuple[int, int]]:
        """(first, last) of the shortest runs of usable words that hold min_coverage of template t, by their ends."""
        need, have = self.counts[t], dict.fromkeys(self.counts[t], 0)
        goal, total, lo = math.ceil(self.min_coverage * len(self.coded[t])), 0, 0
        for hi, word in enumerate(usable):
            total += have[word] < need[word]
            have[word] += 1
            if total < goal:
                continue
            while total > goal or have[usable[lo]] > need[usable[lo]]:
                total -= have[usable[lo]] <= need[usable[lo]]
                have[usable[lo]] -= 1
                lo += 1
            yield lo, hi

    def _best(self, words: np.ndarray, t: int) -> tuple[float, int, int, int] | None:
        """(coverage, first word, last word, confirmed keys) of the best alignment of template t that reaches min_coverage."""
        size, best, sure = len(self.coded[t]), None, 0
        places = np.flatnonzero(self.need[words, t] > 0)
        usable, at = words[places].tolist(), places.tolist()
        step, done = max(1, size // 8), -1
        for lo, hi in self._runs(usable, t):
            last = hi == len(usable) - 1
            if at[hi] - at[lo] >= size / MIN_DENSITY or (hi < done + step and not last):
                continue
            done = hi
            for share in WIDER:
                more = math.ceil(share * size)
                a = max(lo - more, bisect.bisect_left(at, at[lo] - more / MIN_DENSITY))
                b = min(hi + more, bisect.bisect_right(at, at[hi] + more / MIN_DENSITY) - 1)
                pairs = [(at[a + i], j) for i, j in patience_align(usable[a : b + 1], self.coded[t])]
                coverage = len(pairs) / size
                if coverage < self.min_coverage or (best and coverage <= best[0]) or len(pairs) < MIN_DENSITY * (pairs[-1][0] - pairs[0][0] + 1):
                    continue
                confirmed = self._confirmed(words, pairs, t)
                if confirmed is not None:
                    best, sure = (coverage, pairs[0][0], pairs[-1][0]), confirmed
            if best and best[0] == 1:
                break
        return best and (*best, sure)

    def _confirmed(self, words: np.ndarray, pairs: list[tuple[int, int]], t: int) -> int | None:
        """How many keys of template t are aligned word for word; None where one is missing or contradicted, or, in a template
        of up to SHORT words, isn't aligned word for word.
        """
        place, count = {j: i for i, j in pairs}, 0
        for places in self.keys[t]:
            state = max(key_state(words, place, key, self.telling) for key in places)
            if state == 0 or (state == 1 and len(self.coded[t]) <= SHORT):
                return None
            count += state == 2
        return count


def key_state(words: np.ndarray, place: dict[int, int], key: range, telling_codes: np.ndarray) -> int:
    """2 where all words of a key are aligned close by; 1 where half of them are, and nothing speaks against it; else 0.

    What speaks against it is a telling word of the text between words of the key, or where a word at its end should be.
    """
    there = [place[j] for j in key if j in place]
    if 2 * len(there) < len(key) or there[-1] - there[0] >= len(key) / MIN_DENSITY:
        return 0
    seen = list(there)
    for edge, step in ((key[0], -1), (key[-1], 1)):
        if edge not in place:  # up to the next aligned word beyond
            beyond = next((place[j] for j in range(edge + step, edge + 4 * step, step) if j in place and j not in key), None)
            seen += [beyond] if beyond is not None and abs(beyond - there[0 if step < 0 else -1]) <= 2 * len(key) + 4 else []
    seen.sort()
    aligned = set(place.values())
    between = [i for i, k in zip(seen, seen[1:], strict=False) for i in range(i + 1, k) if i not in aligned]
    if telling_codes[words[between]].any():
        return 0
    return 2 if len(there) == len(key) else 1


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """For each document: doc_id, the best license, its coverage and word span, and how many licenses were found."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    wanted = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(wanted, min_coverage)
        for batch in batches:
            for c in chunks(batch.column(1)):
                found = scanner.scan(c)
                best = [f[0] if f else (None, 0.0, None, None) for f in found]
                columns = [pa.array([b[i] for b in best], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.rows), *columns, pa.array([len(f) for f in found], pa.int64())], ["doc_id", "license", "coverage", "first_word", "last_word", "n_licenses"])

    return plain.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, license string, coverage double, first_word long, last_word long, n_licenses long")
