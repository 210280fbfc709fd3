"""License scans by MinHash over overlapping text windows (operator 8).

A template's words give shingles of five words (of two, for notices of fewer
than nine words).  Documents are read in windows of two blocks, each block
starting where the last one ended, so windows overlap by half.  Level 0 has
blocks of 4 shingles, each further level twice that; a template belongs to the
first level where a block and one shingle more hold it, so wherever it stands,
some window holds it whole.

Each window's MinHash signature has ``HASHES`` values, each one a band: a
template is retrieved when any band agrees.  A window that holds it whole has a
similarity above 1/4 and is missed with probability 0.75**64 = 1e-8; one that
holds four fifths of it has more than 0.19, missed with 1e-6.  Retrieved pairs
are confirmed by exact containment of the template's shingles in the window; a phrase that
tells a license from its rivals must be there, in one shingle.  A wording inside
that of another license gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm import textvec as tv

U32 = np.uint32
HASHES = 64
BLOCK = 4
_rng = np.random.default_rng(8)
SLOPE = (_rng.integers(0, 1 << 31, HASHES) * 2 + 1).astype(U32)
SHIFT = _rng.integers(0, 1 << 32, HASHES).astype(U32)

#: Usual wordings of public licenses, by SPDX identifier.  Phrases in braces must be present as they are.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the {Apache License, Version 2.0} (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to {deal in the Software} without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby {granted, provided that} the above copyright notice and this permission notice appear in all copies"),
    ("GPL-3.0", "This work is licensed under the {GNU General Public} License, {version 3}"),
    ("GPL-3.0", "Licensed under the {GNU General Public} License, {version 3}"),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the {GNU General Public} License as published by the Free Software Foundation; either {version 2 of} the License, or (at your option) {any later version}"),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the {GNU General Public} License as published by the Free Software Foundation, either {version 3 of} the License, or (at your option) {any later version}"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the {GNU Lesser General Public} License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, {v. 2.0}"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative {Commons Attribution 4.0} International License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("All-rights-reserved", "All rights reserved"),
]

_BSD = TEMPLATES[6][1]
_MIT = TEMPLATES[5][1]
_KEEP = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"
_SHOW = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"
_NAMES = "{Neither the name of} the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_AUTHOR = "The name of the author {may not be used} to endorse or promote products derived from this software without specific prior written permission"
_ADVERTS = "{All advertising materials mentioning} features or use of this software must display the following acknowledgement"
for _n in (("", "", "", ""), ("1. ", "2. ", "3. ", "4. ")):
    TEMPLATES += [
        ("BSD-2-Clause", f"{_BSD}: {_n[0]}{_KEEP}. {_n[1]}{_SHOW}"),
        ("BSD-3-Clause", f"{_BSD}: {_n[0]}{_KEEP}. {_n[1]}{_SHOW}. {_n[2]}{_NAMES}"),
        ("BSD-3-Clause", f"{_BSD}: {_n[0]}{_KEEP}. {_n[1]}{_SHOW}. {_n[2]}{_AUTHOR}"),
        ("BSD-4-Clause", f"{_BSD}: {_n[0]}{_KEEP}. {_n[1]}{_SHOW}. {_n[2]}{_ADVERTS}: This product includes software developed by the organization. {_n[3]}{_NAMES}"),
    ]
for _id, _name, _versions in (("GPL", "{GNU General Public} License", ("1.0", "2.0", "3.0")), ("LGPL", "{GNU Lesser General Public} License", ("2.1", "3.0")),
                              ("LGPL", "{GNU Library General Public} License", ("2.0",)), ("AGPL", "{GNU Affero General Public} License", ("3.0",))):
    for _v in _versions:
        _short = _v.removesuffix(".0")
        _free = f"is free software; you can redistribute it and/or modify it under the terms of the {_name}"
        for _what in ("This program", "This library"):
            TEMPLATES += [
                (f"{_id}-{_v}-or-later", f"{_what} {_free} as published by the Free Software Foundation; either {{version {_short} of}} the License, or (at your option) {{any later version}}"),
                (f"{_id}-{_v}-only", f"{_what} {_free} as published by the Free Software {{Foundation; version {_short} of}} the License"),
                (f"{_id}-{_v}-only", f"{_what} {_free} {{version {_short} as}} published by the Free Software Foundation"),
            ]
        for _lead in ("Licensed under", "This work is licensed under"):
            TEMPLATES += [(f"{_id}-{_v}", f"{_lead} the {_name}, {{version {_short}}}"), (f"{_id}-{_v}-or-later", f"{_lead} the {_name}, {{version {_short} or later}}"),
                          (f"{_id}-{_v}-or-later", f"{_lead} the {_name}, {{version {_short} or any}} later version")]
for _kind, _long in (("BY", ""), ("BY-SA", "-ShareAlike"), ("BY-NC", "-NonCommercial"), ("BY-ND", "-NoDerivatives"), ("BY-NC-SA", "-NonCommercial-ShareAlike"), ("BY-NC-ND", "-NonCommercial-NoDerivatives")):
    TEMPLATES += [(f"CC-{_kind}-{_v}", f"Licensed under CC {_kind} {_v}") for _v in ("3.0", "4.0")]
    TEMPLATES += [(f"CC-{_kind}-{_v}", f"This work is licensed under a Creative Commons {{Attribution{_long} {_v}}} {_place} License") for _v, _place in (("3.0", "Unported"), ("4.0", "International"))]
TEMPLATES += [
    ("MIT-0", f"{_MIT}, and to permit persons to whom the Software is {{furnished to do so. THE}} SOFTWARE IS PROVIDED"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee {is hereby granted. THE SOFTWARE} IS PROVIDED"),
    ("ECL-2.0", 'Licensed under the {Educational Community License, Version 2.0} (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.osedu.org/licenses/ECL-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'.replace(", Version 2.0}", "}, Version 2.0")),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License {Version 1.1}"),
    ("MPL-1.1", "This Source Code Form is subject to the terms of the Mozilla Public License, {v. 1.1}"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License {v1.0}"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License {2.0}"),
    ("BSL-1.0", "Distributed under the {Boost Software License, Version} 1.0"),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
]
TEMPLATES = list(dict.fromkeys(TEMPLATES))  # first places stay; repeats give the same row

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_AUTHOR_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_HOLDERS_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Whole texts of short public licenses, by SPDX identifier; they follow the notices.
WHOLE_TEXTS = [
    ("MIT", f"{_MIT}, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this {{permission notice shall be included}} in all copies or substantial portions of the Software. {_AS_IS}"),
    ("MIT-0", f"{_MIT}, and to permit persons to whom the Software is {{furnished to do so. THE}} {_AS_IS.removeprefix('THE ')}"),
    ("ISC", f"{TEMPLATES[7][1]}. {_AUTHOR_AS_IS}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee {{is hereby granted. THE SOFTWARE}} {_AUTHOR_AS_IS.removeprefix('THE SOFTWARE ')}"),
    *[("BSD-2-Clause", f"{_BSD}: {a}{_KEEP}. {b}{_SHOW}. {_HOLDERS_AS_IS}") for a, b in (("", ""), ("1. ", "2. "))],
    *[("BSD-3-Clause", f"{_BSD}: {a}{_KEEP}. {b}{_SHOW}. {c}{_NAMES}. {_HOLDERS_AS_IS}") for a, b, c in (("", "", ""), ("1. ", "2. ", "3. "))],
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
]
#: SPDX identifiers, as an identifier line names them.
IDENTIFIERS = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0 Beerware BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent "
    "BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 "
    "CC-BY-SA-4.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CECILL-B CECILL-C CPAL-1.0 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FTL GFDL-1.2-or-later GFDL-1.3-or-later GPL-1.0-or-later "
    "GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND IJG IPL-1.0 ISC JSON LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only "
    "LGPL-3.0-or-later Libpng LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SISSL "
    "Sleepycat SSPL-1.0 TCL Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Xnet ZPL-2.1 Zlib").split()
NOTICES = len(TEMPLATES)
TEMPLATES += WHOLE_TEXTS
#: What begins an identifier line, three words.
MARKER = "SPDX-License-Identifier"
TEMPLATES += [(name, f"{MARKER}: {name}") for name in IDENTIFIERS]

def _hashes(part: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, of_row = tv.tokens(part, offsets, tv.ALNUM)
    return tv.word_hashes(part, starts, ends), of_row


NOT = _hashes(np.frombuffer(b"not", np.uint8), np.array([0, 3]))[0][0]


class Templates:
    """Templates by shingle size and level: shingle sets and a signature each; telling phrases; wider rivals."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [n for n, _ in templates]
        self.identifiers: dict[tuple[int, ...], int] = {}  # words after the marker -> template
        self.marker, self.marked = len(templates), np.zeros(0, np.uint64)
        self.groups: dict[tuple[int, int], list[tuple[int, np.ndarray, np.ndarray]]] = {}
        self.telling: dict[int, list[np.ndarray]] = {}
        self.wider: dict[int, list[int]] = {}
        lines = any(t.startswith(f"{MARKER}:") for _, t in templates)
        for i, (_, text) in enumerate([*templates, ("", MARKER)] if lines else templates):
            data, offsets = tv.utf8(pa.array([text]))
            words, of_row = _hashes(tv.LOWER[data], offsets)
            if i == self.marker:
                self.marked = words
            elif text.startswith(f"{MARKER}:"):  # found by the marker, told by the words after it
                self.identifiers[tuple(words[3:].tolist())] = i
                continue
            size = 5 if len(words) >= 9 else min(2, max(len(words), 1))
            own = np.unique(tv.shingles(words, of_row, size)[0])
            if not len(own):
                continue
            level, run = 0, len(words) - size + 1
            while run > (BLOCK << level) + 1:
                level += 1
            short = (own >> np.uint64(32)).astype(U32)
            with np.errstate(over="ignore"):
                mark = (short[:, None] * SLOPE + SHIFT).min(axis=0)
            self.groups.setdefault((size, level), []).append((i, own, mark))
            self.telling[i] = self._telling(text, words, of_row, size) if size == 5 else []
        self.bands = self._bands()
        sets = [(i, own) for (size, _), g in self.groups.items() if size == 5 for i, own, _ in g]
        for i, own in sets:
            self.wider[i] = [j for j, other in sets if len(other) > len(own) and self.names[i] != self.names[j] and np.isin(own, other).mean() >= 0.8]

    def _identified(self, words: np.ndarray) -> Iterator[tuple[int, int]]:
        """(template, first word) of each identifier line of a row that holds the marker: the longest identifier after it."""
        at = np.flatnonzero((words[:-3] == self.marked[0]) & (words[1:-2] == self.marked[1]) & (words[2:-1] == self.marked[2])) if len(words) > 3 else []
        longest = max(map(len, self.identifiers))
        for place in at:
            after = tuple(words[place + 3 : place + 3 + longest].tolist())
            found = next((self.identifiers[after[:n]] for n in range(len(after), 0, -1) if after[:n] in self.identifiers), None)
            if found is not None:
                yield found, int(place)

    @staticmethod
    def _telling(text: str, words: np.ndarray, of_row: np.ndarray, size: int) -> list[np.ndarray]:
        """For each phrase in braces, the shingles that hold all of it."""
        run, out, at = tv.shingles(words, of_row, size)[0], [], 0
        for n, part in enumerate(re.split("[{}]", text)):
            data, offsets = tv.utf8(pa.array([part]))
            count = len(_hashes(tv.LOWER[data], offsets)[0])
            if n % 2:
                if count > size:
                    raise ValueError(f"a phrase in braces has more than {size} words: {part}")
                out.append(run[max(at + count - size, 0) : at + 1])
            at += count
        return out

    def _bands(self) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """Per group and band: the templates' values in order, and whose they are."""
        out = {}
        for key, group in self.groups.items():
            marks = np.stack([m for _, _, m in group], axis=1)
            order = np.argsort(marks, axis=1, kind="stable")
            out[key] = np.take_along_axis(marks, order, axis=1), order
        return out

    def matches(self, words: np.ndarray, of_row: np.ndarray, least: float) -> dict[tuple[int, int], tuple[float, int]]:
        """(row, template) -> (best containment, first word of the window)."""
        spots: dict[tuple[int, int], list[tuple[float, int, int, int]]] = {}
        for size in sorted({s for s, _ in self.groups}):
            values, cut = tv.shingles(words, of_row, size)
            if len(values):
                self._scan(size, values, cut, least, spots)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for (r, i), found in spots.items():
            if i == self.marker:
                for j, place in self._identified(words[of_row[r] : of_row[r + 1]]):
                    best.setdefault((r, j), (1.0, place))
                continue
            found = [x for x in found if not (x[2] and words[of_row[r] + x[2] - 1] == NOT)]
            over = [(a, b) for j in self.wider.get(i, ()) for _, _, a, b in spots.get((r, j), ())]
            free = [(-share, place) for share, place, a, b in found if not any(c <= a and b <= d for c, d in over)]
            if free:
                share, place = min(free)
                best[r, i] = -share, place
        return best

    def _scan(self, size: int, values: np.ndarray, cut: np.ndarray, least: float, spots: dict) -> None:
        short = (values >> np.uint64(32)).astype(U32)
        levels = {lv: g for (s, lv), g in self.groups.items() if s == size}
        edges = []  # per level: block starts, row of each block
        rows = np.arange(len(cut) - 1)
        for lv in range(max(levels) + 1):
            width = BLOCK << lv
            n = -(-np.diff(cut) // width)
            row = np.repeat(rows, n)
            first = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            edges.append((cut[row] + first * width, row))
        hits: dict[int, list[np.ndarray]] = {lv: [] for lv in levels}  # window * templates + template
        for j in range(HASHES):
            with np.errstate(over="ignore"):
                value = short * SLOPE[j] + SHIFT[j]
            low = None
            for lv, (begin, row) in enumerate(edges):
                # A block of a level is two of the level below, so its least value is theirs.
                low = np.minimum.reduceat(value, begin) if low is None else np.minimum.reduceat(low, np.searchsorted(edges[lv - 1][0], begin))
                if lv in levels:
                    window = low.copy()
                    same = row[1:] == row[:-1]
                    window[:-1][same] = np.minimum(low[:-1], low[1:])[same]
                    marks, order = self.bands[size, lv][0][j], self.bands[size, lv][1][j]
                    known = np.zeros(1 << 16, bool)
                    known[marks >> U32(16)] = True
                    at = np.flatnonzero(known[window >> U32(16)])
                    first = np.searchsorted(marks, window[at])
                    n = np.searchsorted(marks, window[at], side="right") - first
                    take = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    hits[lv].append(np.repeat(at, n) * len(order) + order[take])
        for lv, group in levels.items():
            begin, row = edges[lv]
            pairs = np.unique(np.concatenate(hits[lv]))
            last = -1
            for w, g in zip((pairs // len(group)).tolist(), (pairs % len(group)).tolist()):
                r = int(row[w])
                if w != last:
                    part = values[begin[w] : min(int(begin[w]) + 2 * (BLOCK << lv), int(cut[r + 1]))]
                    window, last = np.unique(part), w
                i, own, _ = group[g]
                need = least if size > 2 else 1.0  # one word tells short notices apart
                found = float(np.isin(own, window, assume_unique=True).sum() / len(own))
                if found >= need and all(np.isin(t, window).any() for t in self.telling[i]):
                    place = int(begin[w] - cut[r])
                    held = np.flatnonzero(np.isin(part, own))
                    spots.setdefault((r, i), []).append((found, place, place + int(held[0]), place + int(held[-1])))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, least: float = 0.8) -> DataFrame:
    """``(doc_id, license, template, containment, window_word)`` per template that a document holds, its best window.

    A template has at least ``least`` of its shingles in the window, one of fewer than
    nine words all of them, and its phrases in braces; one of another license that holds
    its wording and more takes the passage.  A passage after the word "not" tells
    no license, an opening that several share only their family (BSD).  An
    identifier line is retrieved by its marker and told by the longest known
    identifier after it; its ``window_word`` is the line's first word.  ``template`` numbers the list; words are runs of letters and digits, A-Z
    lower-cased.  Null and empty texts match nothing; a text shorter than a
    shingle is one.  Repeated rows and null ids are read as any other; of equally
    good windows the first counts; a text of any length is read whole; only the two
    named columns are read, so others cannot clash.  An empty table gives an empty
    result.  Nothing is shuffled.
    """
    known = templates if templates is not None else TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Templates(known)
        for batch in batches:
            data, offsets = tv.utf8(batch.column("text"))
            for low, high in tv.slices(offsets):
                words, of_row = _hashes(tv.LOWER[data[offsets[low] : offsets[high]]], offsets[low : high + 1] - offsets[low])
                found = ready.matches(words, of_row, least)
                keys = sorted(found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array([low + r for r, _ in keys], pa.int64())), pa.array([ready.names[i] for _, i in keys], pa.string()),
                     pa.array([i for _, i in keys], pa.int32()), pa.array([found[k][0] for k in keys], pa.float64()), pa.array([found[k][1] for k in keys], pa.int64())],
                    ["doc_id", "license", "template", "containment", "window_word"])

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, license string, template int, containment double, window_word long")
