"""License scans by patience alignment.

Text and template are words (letters, digits, underscores; lower case). The
alignment takes what both begin and end with, then the words that are unique to
either side as anchors, keeps the longest run of them that ascends in both, and
goes on in the gaps between. Coverage is the share of the template's words that
are aligned.

A license is found where a stretch of a text covers at least least of a
template. Stretches lie where a word of the text would be in its place in the
template, just as long as that, or with a quarter or the whole of its length more on both
sides; a license that stands twice in a row has no unique words in the longer ones.
Only the template's words that are rarest in the
text place stretches: so many of them that one at least must be aligned if the
coverage is reached. A text that hasn't enough of the template's words isn't
aligned at all; it can't reach the coverage.

Siblings differ in one or two words, which no coverage can tell. Of a template's
numbers and words of TELLING each must be aligned, a number with no other number
between it and the aligned word before; a word of TELLING that stands unaligned in the
stretch (GNU *Lesser* General Public License) makes it another license.

Beside TEMPLATES, MORE has notices, file headers, identifier lines and texts (full, or
the opening where they are long) of common licenses: the name is the SPDX identifier
for a notice (MIT-notice, as MIT is the text), with -header, -spdx or -text behind it for
the others. Of several templates of one name the best covered gives the row.

Null and empty texts hold no license. Rows are independent: a null id, repeated
ids and repeated rows each give their own rows. Ties go to the earliest and shortest stretch.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm._common import chunks, session, text_or_empty

LEAST = 0.8
_WORD = re.compile(r"\w+")
_VERSION = re.compile(r"\w*v\d+")

#: Words that tell a license from its siblings, as all numbers do.
TELLING = frozenset(
    "0bsd academic affero afl agpl alike apache appear advertising artistic boost bsd bsl cc cc0 cddl commercial derivatives derivs eclipse endorse epl eupl european gnu gpl isc "
    "later lesser lgpl mit mozilla mpl nc nd noncommercial noderivatives noderivs only sa sharealike unlicense wtfpl zlib".split()
)
#: Names that other texts mention in passing: they must be aligned, but may also stand between.
_NAMES = frozenset("0bsd academic afl agpl apache artistic boost bsd bsl cc cc0 cddl eclipse epl eupl european gnu gpl isc later lgpl mit mozilla mpl only unlicense wtfpl zlib".split())

# fixed values: notices of public licenses
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "all-rights-reserved": "All rights reserved",
}

_PUBLIC = {
    "AFL-3.0": ["Academic Free License version 3.0"],
    "AGPL-3.0": ["GNU Affero General Public License version 3", "GNU AGPL v3", "AGPLv3", "AGPL 3.0"],
    "Apache-1.1": ["Apache Software License version 1.1"],
    "Apache-2.0": ["Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-clause BSD license", "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-clause BSD license", "New BSD License", "Modified BSD License", "BSD-3-Clause"],
    "BSD": ["BSD License", "BSD-style license"],
    "BSL-1.0": ["Boost Software License version 1.0"],
    "CDDL-1.0": ["Common Development and Distribution License version 1.0", "CDDL 1.0"],
    "EPL-1.0": ["Eclipse Public License version 1.0", "EPL 1.0"],
    "EPL-2.0": ["Eclipse Public License version 2.0", "EPL 2.0"],
    "EUPL-1.2": ["European Union Public Licence version 1.2", "EUPL 1.2"],
    "GPL-2.0": ["GNU General Public License version 2", "GNU GPL version 2", "GNU GPL v2", "GPL v2", "GPLv2", "GPL 2.0"],
    "GPL-3.0": ["GNU General Public License version 3", "GNU GPL version 3", "GNU GPL v3", "GPL v3", "GPLv3", "GPL 3.0"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License version 2.1", "GNU LGPL version 2.1", "LGPL v2.1", "LGPLv2.1", "LGPL 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License version 3", "GNU LGPL version 3", "LGPL v3", "LGPLv3", "LGPL 3.0"],
    "MIT": ["MIT License", "MIT"],
    "MPL-1.1": ["Mozilla Public License version 1.1", "MPL 1.1"],
    "MPL-2.0": ["Mozilla Public License version 2.0", "MPL 2.0"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["WTFPL"],
    "Zlib": ["zlib License", "zlib/libpng License"],
}
_CC = {"BY": "Attribution", "BY-SA": "Attribution ShareAlike", "BY-ND": "Attribution NoDerivatives", "BY-NC": "Attribution NonCommercial", "BY-NC-SA": "Attribution NonCommercial ShareAlike", "BY-NC-ND": "Attribution NonCommercial NoDerivatives"}
_SPDX = "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 Unlicense WTFPL Zlib".split()
_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES "
    "OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _gnu_header(name: str, version: str) -> str:
    return (
        f"is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, "
        f"either version {version} of the License, or (at your option) any later version."
    )


def _more() -> list[tuple[str, str]]:
    out = []

    def add(name: str, *texts: str) -> None:
        out.extend((name, t) for t in texts)

    for name, said in _PUBLIC.items():
        for x in said:
            # a short name needs the verb to be a notice; in a longer one a word may differ
            add("MIT-notice" if name == "MIT" else name, *([f"{v} under {x}" for v in ("Licensed", "Released", "Distributed", "Available")] if len(words(x)) < 4 else []), *([f"under the {x}"] if len(words(x)) > 1 else []))
    for code, name in _CC.items():
        for version in ("4.0", "3.0", "2.5", "2.0"):
            add(f"CC-{code}-{version}", f"Creative Commons {name} {version}", f"under CC {code} {version}", f"CC {code} {version} License")
            add(f"CC-{code}-{version}-spdx", f"SPDX-License-Identifier: CC-{code}-{version}")
    add("CC0-1.0", "under CC0 1.0", "Creative Commons CC0 1.0 Universal", "public domain under CC0")
    for name in _SPDX:
        add(f"{name}-spdx", f"SPDX-License-Identifier: {name}")
    for name, long, version in (
        ("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3"),
        ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"),
    ):
        add(f"{name}-header", _gnu_header(long, version))
    add("MPL-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.")
    for version in ("1.0", "2.0"):
        add(f"EPL-{version}-header", f"This program and the accompanying materials are made available under the terms of the Eclipse Public License v{version}", f"This program and the accompanying materials are made available under the terms of the Eclipse Public License {version}")
    add("BSL-1.0-header", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)")
    add("Apache-2.0-text", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections")
    add("GPL-2.0-text", f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 {_VERBATIM} Preamble The licenses for most software are designed to take away your freedom to share and change it.")
    add("GPL-3.0-text", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 {_VERBATIM} Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works.")
    add("AGPL-3.0-text", f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 {_VERBATIM} Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works")
    add("LGPL-2.1-text", f"GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 {_VERBATIM} This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License")
    add("LGPL-3.0-text", f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 {_VERBATIM} This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License")
    add("MPL-2.0-text", "Mozilla Public License Version 2.0 Definitions Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. Contributor Version means the combination of the Contributions of others")
    add("Artistic-1.0-text", "The Artistic License Preamble The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package")
    add("CC0-1.0-text", "Creative Commons CC0 1.0 Universal Statement of Purpose The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s)")
    add("BSD-2-Clause-text", _BSD_2 + _DISCLAIMER)
    add("BSD-3-Clause-text", _BSD_2 + _BSD_3 + _DISCLAIMER)
    add("BSD-4-Clause-text", _BSD_2 + "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. " + _BSD_3 + _DISCLAIMER)
    add("ISC-text", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}")
    add("0BSD-text", f"{_ISC}. {_ISC_END}")
    add("Unlicense-text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.")
    add("Zlib-text", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions")
    add("WTFPL-text", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION You just DO WHAT THE FUCK YOU WANT TO")
    return out


MORE = _more()


def ascending(places: list[int]) -> list[int]:
    """Indices of a longest ascending subsequence."""
    tails: list[int] = []
    tail_at: list[int] = []
    back: list[int] = []
    for i, p in enumerate(places):
        k = bisect.bisect_left(tails, p)
        back.append(tail_at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(p)
            tail_at.append(i)
        else:
            tails[k], tail_at[k] = p, i
    out, i = [], tail_at[-1] if tail_at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
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
        at_b = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        unique = [(i, at_b[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in at_b]
        if not unique:
            continue
        i, j = a0, b0
        for k in ascending([q for _, q in unique]):
            p, q = unique[k]
            out.append((p, q))
            todo.append((i, p, j, q))
            i, j = p + 1, q + 1
        todo.append((i, a1, j, b1))
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str, least: float):
        self.name, self.words = name, words(text)
        self.count = Counter(self.words)
        self.need = max(1, -int(-least * len(self.words) // 1))
        self.must = frozenset(w for w in self.words if w.isdecimal() or w in TELLING or _VERSION.fullmatch(w))

    def tells(self, got: list[tuple[int, int]], text: list[str]) -> bool:
        """Whether the words that tell this license from its siblings are aligned, and no sibling's word stands between."""
        seen = set()
        for k, (p, q) in enumerate(got):
            w = self.words[p]
            if w in self.must and not (w.isdecimal() and k and any(x.isdecimal() for x in text[got[k - 1][1] + 1 : q])):
                seen.add(w)
        if len(seen) < len(self.must):
            return False
        held = {q for _, q in got}
        return not any(
            q not in held and (text[q] in TELLING and text[q] not in _NAMES or text[q] == "library" and text[q - 1] == "gnu")
            for q in range(got[0][1] + 1, got[-1][1])
        )

    def find(self, text: list[str], count: Counter) -> tuple[int, int, int] | None:
        """Words aligned in the best stretch and its first and last word, if that is enough."""
        n = len(self.words)
        if sum(k for w, k in self.count.items() if w in count) < self.need:
            return None
        # if need words are aligned, at most n - need aren't, so one of the n - need + 1 rarest is
        rare: dict[str, list[int]] = {}
        for p in sorted(range(n), key=lambda p: (count[self.words[p]], p))[: n - self.need + 1]:
            rare.setdefault(self.words[p], []).append(p)
        shifts = sorted({q - p for q, w in enumerate(text) if w in rare for p in rare[w]})
        best = None
        for lo, hi in dict.fromkeys((max(0, d - room), min(len(text), d + n + room)) for d in shifts for room in (0, n // 4, n)):
            got = align(self.words, text[lo:hi])
            if len(got) >= self.need and (best is None or len(got) > best[0]) and self.tells(got, text[lo:hi]):
                best = (len(got), lo + got[0][1], lo + got[-1][1])
        return best


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, license, coverage, n_matched, first_word, last_word: a row for each license that a row's text holds."""
    session(docs)
    held = list(templates.items() if templates else [*TEMPLATES.items(), *MORE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Template(k, v, least) for k, v in sorted(held) if words(v)]
        for batch in batches:
            ids, at = batch.column(0).to_pylist(), 0
            out: list[tuple] = []
            for part in chunks(batch.column(1)):
                for t in part:
                    split = words(t)
                    some = set(split)
                    count = None
                    best: dict[str, tuple] = {}
                    for x in known:
                        if not x.must <= some or sum(k for w, k in x.count.items() if w in some) < x.need:
                            continue
                        count = count or Counter(split)
                        if found := x.find(split, count):
                            new = (found[0] / len(x.words), *found)
                            best[x.name] = max(best.get(x.name, new), new, key=lambda v: v[:2])
                    out.extend((ids[at], k, *v) for k, v in best.items())
                    at += 1
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "license", "coverage", "n_matched", "first_word", "last_word"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, "doc_id long, license string, coverage double, n_matched long, first_word long, last_word long")
