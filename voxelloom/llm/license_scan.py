"""License scans: winnowed fingerprints pick candidates, banded alignment reports what matched.

Templates and texts are cut into lower-case word tokens. Every run of `gram` tokens is hashed, and
of each `window` consecutive hashes the smallest (the rightmost of equals) is a fingerprint, so
any shared run of gram + window - 1 tokens shares a fingerprint. An inverted index maps template
fingerprints to (template, place). A document's own winnowed fingerprints that are in the index
are seeds; seeds of one template that follow each other in text and template are chained, across
gaps of up to half the template. Each chain is aligned with its whole template (Smith-Waterman over
tokens) in a band that spans the chain's diagonals and a margin, which gives the template's
matched coverage and the span of the text.

What is found: matches of at least `least` coverage that share a run of gram + window - 1 tokens
with the template. The templates are a parameter, fixed in number, and go to the executors with
the function.

Defined cases: null, empty or short texts match nothing and give no rows; a text may match many
templates and one template many times; repeated rows each give their matches; of overlapping
matches of one template the better stays, of equal ones the first; a very long text costs time in
proportion to its tokens and seeds; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm.shared import small_batches

WORD = re.compile(r"[a-z0-9]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
FOUND = "doc_id long, license string, coverage double, matched long, span_start long, span_end long"

#: Public notices by which texts declare their licence, and the whole text of short licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-3-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash of each window, the rightmost of equals."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    w = min(window, len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes, w)
    return np.unique(np.arange(len(views)) + w - 1 - views[:, ::-1].argmin(axis=1))


class TemplateIndex:
    def __init__(self, templates: dict[str, str], gram: int = 3, window: int = 2):
        self.gram, self.window, self.names = gram, window, list(templates)
        tokens = [WORD.findall(t.lower()) for t in templates.values()]
        self.vocab = {w: i + 1 for i, w in enumerate(sorted({w for t in tokens for w in t}))}
        self.ids = [np.array([self.vocab[w] for w in t], np.int64) for t in tokens]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for k, ids in enumerate(self.ids):
            grams, places = self.grams(ids)
            for at in winnow(grams, window):
                self.index.setdefault(int(grams[at]), []).append((k, int(places[at])))
        self.known = np.array(sorted(self.index), dtype=np.uint64)

    def grams(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of `gram` tokens, with their places."""
        n = len(ids) - self.gram + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.gram):
                h = (h + ids[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        return h, np.arange(n)

    def seeds(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """(place in the text, place in the template) of the text's winnowed fingerprints, by template, in order."""
        grams, places = self.grams(ids)
        picked = winnow(grams, self.window)
        chosen = grams[picked]
        at = np.minimum(np.searchsorted(self.known, chosen), len(self.known) - 1)
        out: dict[int, list[tuple[int, int]]] = {}
        for i in picked[self.known[at] == chosen].tolist():
            for k, p in self.index[int(grams[i])]:
                out.setdefault(k, []).append((int(places[i]), p))
        return {k: sorted(own) for k, own in out.items()}

    def chains(self, k: int, seeds: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
        """Runs of seeds that follow each other in text and template, best first, each seed in one chain."""
        size = len(self.ids[k])
        gap, reach = max(1, size // 2), size + size // 2  # most change of diagonal, most distance in the text
        score, back = [1.0] * len(seeds), [-1] * len(seeds)
        low = 0
        for n, (i, p) in enumerate(seeds):
            while seeds[low][0] < i - reach:
                low += 1
            for m in range(low, n):
                j, q = seeds[m]
                shift = abs((i - p) - (j - q))
                if j < i and q < p and shift <= gap and score[m] + 1 - shift / size > score[n]:
                    score[n], back[n] = score[m] + 1 - shift / size, m
        taken, out = [False] * len(seeds), []
        for n in sorted(range(len(seeds)), key=lambda n: (-score[n], n)):
            chain = []
            while n >= 0 and not taken[n]:
                taken[n] = True
                chain.append(seeds[n])
                n = back[n]
            if chain:
                out.append(chain[::-1])
        return out

    def align(self, ids: np.ndarray, k: int, low: int, high: int) -> tuple[int, int, int]:
        """(matched tokens, first, last token of the text) of the best local alignment of a template.

        Diagonals (place in the text less place in the template) from low to high are open. A match
        gives 2, a mismatch and a left out token cost 1. Of equal ends the first counts.
        """
        template, width = self.ids[k], high - low + 1
        text = np.full(len(template) + width, -1, np.int64)  # the tokens from `low` on, -1 outside the text
        a, b = max(low, 0), min(len(ids), low + len(text))
        if b > a:
            text[a - low : b - low] = ids[a:b]
        cells = np.arange(width)
        score = np.zeros((len(template) + 1, width + 1), np.int64)  # a column of zeros on the right
        for i in range(1, len(template) + 1):
            there = text[i - 1 : i - 1 + width]
            step = score[i - 1, :width] + np.where(there == template[i - 1], 2, -1)  # both sides go on
            step = np.maximum(np.maximum(step, score[i - 1, 1:] - 1), 0)  # or the template alone
            step = np.maximum.accumulate(step + cells) - cells  # or the text alone
            score[i, :width] = np.where(there >= 0, step, 0)
        i, c = np.unravel_index(int(score.argmax()), score.shape)
        i, c = int(i), int(c)
        matched, first, last = 0, -1, i - 1 + low + c
        while i and score[i, c] > 0:
            same = text[i - 1 + c] == template[i - 1]
            if score[i, c] == score[i - 1, c] + (2 if same else -1):
                if same:
                    matched, first = matched + 1, i - 1 + low + c
                i -= 1
            elif score[i, c] == score[i - 1, c + 1] - 1:
                i, c = i - 1, c + 1
            else:
                c -= 1
        return matched, first, last

    def matches(self, text: str | None, least: float) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, matched tokens, start, end) of every match with enough coverage."""
        text = text or ""
        lower = text.lower()
        if len(lower) != len(text):  # a letter that lower-cases to two would shift the spans
            lower = text.translate(ASCII_LOWER)
        spans = [m.span() for m in WORD.finditer(lower)]
        get = self.vocab.get
        ids = np.fromiter((get(lower[a:b], 0) for a, b in spans), np.int64, len(spans))
        found = []
        for k, own in self.seeds(ids).items() if len(ids) >= self.gram else ():
            size = len(self.ids[k])
            margin = max(1, size // 8)
            for chain in self.chains(k, own):
                diagonals = [i - p for i, p in chain]
                low, high = min(diagonals) - margin, max(diagonals) + margin
                if (min(high + size, len(ids)) - max(low, 0)) < least * size:
                    continue
                matched, first, last = self.align(ids, k, low, high)
                if matched / size >= least:
                    found.append((self.names[k], matched / size, matched, spans[first][0], spans[last][1]))
        found.sort(key=lambda m: (m[0], -m[1], m[3]))
        kept: list[tuple] = []
        starts: dict[str, list[tuple[int, int]]] = {}  # spans of one licence, apart and in order
        for m in found:
            own = starts.setdefault(m[0], [])
            at = bisect.bisect_left(own, (m[3], m[4]))
            if (at == 0 or own[at - 1][1] <= m[3]) and (at == len(own) or own[at][0] >= m[4]):
                own.insert(at, (m[3], m[4]))
                kept.append(m)
        return kept


def scan_licenses(docs: DataFrame, *, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """One row per match of a template in docs(doc_id, text): coverage, matched tokens and span in code points."""
    index = TemplateIndex(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += [(doc_id, *m) for m in index.matches(text.as_py(), least)]
            types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["doc_id", "license", "coverage", "matched", "span_start", "span_end"])

    small_batches(docs)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FOUND)
