"""Licence scans: Dice coefficient over word bigrams against licence templates.

Texts and templates are cut into words (letters and digits, lower-cased). A template
is compared with every window of a text's words, so that a notice is found inside a
longer line or paragraph, over line ends and between comment marks. Since
dice = 2 * shared / (a + b) can reach t only if t / (2 - t) <= a / b <= (2 - t) / t,
a template meets only windows within its size bounds, and only where they hold enough
of its bigrams; texts without one of its rarest bigrams (as many as a match can't all
lack) don't meet it at all. The work is one pass in map tasks; texts are never
shuffled, and a long text is read piece by piece.

Defined results: null or empty texts and one-word texts match nothing; a template's
best window counts once a document (ties: the first, then the shortest); repeated ids
are one document; extra columns are ignored; an empty table gives an empty result.
Templates that differ in few words (versions of a licence) can match one window, the
right one with the greatest coefficient.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import ceil, floor
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..session import text_batches

THRESHOLD = 0.8

# Short forms, notices and complete texts of common licences.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License - see the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "BSD-2-Clause": [
        'Released under the BSD 2-Clause License.',
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "ISC": [
        'Released under the ISC License.',
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "0BSD": [
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "Unlicense": [
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.',
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "LGPL-2.1": [
        'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.',
    ],
    "LGPL-3.0": [
        'This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.',
    ],
    "AGPL-3.0": [
        'This work is licensed under the GNU Affero General Public License, version 3.',
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.',
    ],
    "EPL-2.0": [
        'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0',
    ],
}

WORD = re.compile(r"[^\W_]+")
GAP = re.compile(r"[\W_]")
#: Characters of a text that are cut into words at once.
PIECE = 1 << 20


def _words(text: str, start: int, end: int) -> list[str]:
    return " ".join(WORD.findall(text, start, end)).lower().split()


class Template(NamedTuple):
    """A template's bigrams with their counts and number, its size bounds and the bigrams of which a match has one."""

    license: str
    number: int
    bigrams: Counter
    size: int
    least: int
    most: int
    rare: set


def prepare(templates: dict[str, list[str]], threshold: float = THRESHOLD) -> list[Template]:
    """The templates of two words or more."""
    words = [(name, k, _words(text, 0, len(text))) for name, texts in templates.items() for k, text in enumerate(texts)]
    counted = [(name, k, Counter(zip(w, w[1:]))) for name, k, w in words if len(w) > 1]
    spread = Counter(pair for _, _, bigrams in counted for pair in bigrams)
    ratio = threshold / (2 - threshold)
    made = []
    for name, k, bigrams in counted:
        size = bigrams.total()
        least, most = max(ceil(size * ratio - 1e-9), 1), floor(size / ratio + 1e-9)
        # A match shares ``least`` bigrams at least, so it can't lack this many.
        rare, covered = set(), 0
        for pair in sorted(bigrams, key=lambda p: (spread[p], -len(p[0]) - len(p[1]), p)):
            if covered > size - least:
                break
            rare.add(pair)
            covered += bigrams[pair]
        made.append(Template(name, k, bigrams, size, least, most, rare))
    return made


def _hits(text: str, known: set) -> list[tuple[int, tuple[str, str]]]:
    """The bigrams of ``text`` that are ``known``, with their places."""
    hits, at, place, last = [], 0, 0, []
    while at < len(text):
        gap = GAP.search(text, min(at + PIECE, len(text)))
        end = gap.start() if gap else len(text)
        words = last + _words(text, at, end)
        hits += [(place + k, pair) for k, pair in enumerate(zip(words, words[1:])) if pair in known]
        place, last, at = place + max(len(words) - 1, 0), words[-1:], end
    return hits


def _best(hits: list[tuple[int, tuple[str, str]]], template: Template) -> tuple[float, int, int]:
    """dice, place and bigrams of the template's best window; it starts and ends with bigrams of the template, or a shorter one were better."""
    best = (0.0, 0, 0)
    for i in range(len(hits) - template.least + 1):
        first = hits[i][0]
        if hits[i + template.least - 1][0] - first >= template.most:
            continue
        left, shared = dict(template.bigrams), 0
        for j in range(i, len(hits)):
            place, pair = hits[j]
            n = place - first + 1
            if n > template.most:
                break
            if left[pair]:
                left[pair] -= 1
                shared += 1
                dice = 2 * shared / (n + template.size)
                if dice > best[0]:
                    best = (dice, first, n)
        if best[0] == 1:
            break
    return best


def matches(text: str, templates: list[Template], known: set, threshold: float = THRESHOLD) -> list[tuple[str, int, float, str]]:
    """license, template, dice and the matching part of ``text``."""
    hits = _hits(text, known)
    held = {pair for _, pair in hits}
    found = []
    for t in templates:
        if not held.isdisjoint(t.rare):
            dice, first, n = _best([h for h in hits if h[1] in t.bigrams], t)
            if dice >= threshold:
                found.append((t, dice, first, first + n))
    if not found:
        return []
    ends = {place for _, _, *window in found for place in window}
    last = max(ends)
    spans = {}
    for place, word in enumerate(WORD.finditer(text)):
        if place in ends:
            spans[place] = word.span()
        if place == last:
            break
    return [(t.license, t.number, dice, text[spans[a][0] : spans[b][1]]) for t, dice, a, b in found]


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """doc_id, license, template, dice, unit: matches of a document, the best window for each template."""
    text_batches(docs)
    known_templates = prepare(templates or TEMPLATES, threshold)
    known = {pair for t in known_templates for pair in t.bigrams}
    rows = docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    fields = [StructField("license", StringType()), StructField("template", IntegerType()), StructField("dice", DoubleType()), StructField("unit", StringType())]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i.as_py(), *m) for i, body in zip(*batch.columns, strict=True) for m in matches(body.as_py(), known_templates, known, threshold)]
            types = [batch.schema.field(0).type, pa.string(), pa.int32(), pa.float64(), pa.string()]
            columns = list(zip(*found, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", *(f.name for f in fields)])

    scored = rows.mapInArrow(scanned, StructType([rows.schema["doc_id"], *fields]))
    best = F.max(F.struct("dice", "unit"))
    return scored.groupBy("doc_id", "license", "template").agg(best.alias("best")).select("doc_id", "license", "template", "best.dice", "best.unit")
