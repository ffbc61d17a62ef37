"""Licence scans: texts against licence templates by Dice coefficient over word bigrams.

A text is normalised to lower-case (A-Z) words of ASCII letters, digits and non-ASCII
characters; everything else separates words.  Compared units are the whole text, every
paragraph (lines up to a blank one) and every line.  With a and b distinct bigrams, the
Dice coefficient 2c / (a + b) can reach t only if t / (2 - t) <= a / b <= (2 - t) / t; templates
outside these bounds are pruned before their bigrams are compared, and units that share
no bigram with any template are pruned before that.  A unit of one word has that word as
its only gram.

Runs of words are compared too, wherever they begin and end, so a notice is found with anything
before or after it.  A best run begins and ends at a bigram that the template has; from each such
place the run grows until it has more distinct bigrams than a match can have, or only repeats
itself for twice as many.  Of runs that begin within a match the best counts.  Runs are reported
as unit ``words`` where no reported unit or run of the same licence overlaps them, nor one of another licence
with as high a coefficient.

Defined results: a null text reads as empty and matches nothing; of equal coefficients
the first licence by name wins, and the larger unit before the smaller; repeated rows
each give a row; a text may be of any length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakeweave.llm.kernels import LOWER, chunks, find_words, mix, span_hash, text_buffer

# Notices and texts of public licences, by SPDX name.
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License.",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero "
        "General Public License for more details.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. " + _BSD_DISCLAIMER,
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used "
        "to endorse or promote products derived from this software without specific prior written permission. " + _BSD_DISCLAIMER,
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this "
        "software to the public domain worldwide. This software is distributed without any warranty. You should have "
        "received a copy of the CC0 Public Domain Dedication along with this software.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser "
        "General Public License for more details.",
    ),
    "LGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser "
        "General Public License for more details.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means.",
    ),
}
THRESHOLD = 0.9
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bigram hashes, their rows, and first byte, last byte and number of words of each row."""
    low = LOWER[data]
    row, start, end = find_words(low, offsets, WORD)
    h = span_hash(low, start, end)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    inside = row[1:] == row[:-1]
    pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[inside]
    lone = np.flatnonzero(count[row] == 1)
    grams, rows = np.concatenate([pair, h[lone]]), np.concatenate([row[:-1][inside], row[lone]])
    return grams, rows, row, start, end


class Templates:
    """Bigram sets of all templates, and the size bounds that a threshold allows."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]], threshold: float):
        self.names, self.sets = [], []
        for name in sorted(templates):
            for text in templates[name]:
                raw = np.frombuffer(text.encode(), np.uint8)
                self.names.append(name)
                self.sets.append(frozenset(_grams(raw, np.array([0, len(raw)]))[0].tolist()))
        self.threshold = threshold
        least = threshold / (2 - threshold)
        self.bounds = [(least * len(s), len(s) / least) for s in self.sets]
        self.largest = max((high for _, high in self.bounds), default=0)
        self.all = np.array(sorted(frozenset().union(*self.sets)), np.uint64)
        #: For every template, which of all bigrams it has.
        self.has = np.array([np.isin(self.all, np.array(sorted(s), np.uint64)) for s in self.sets], bool).reshape(len(self.sets), len(self.all))

    def known(self, grams: np.ndarray) -> np.ndarray:
        return self.places(grams) >= 0

    def places(self, grams: np.ndarray) -> np.ndarray:
        """Where each bigram stands among those of all templates, or -1."""
        if not len(self.all):
            return np.full(len(grams), -1, np.int64)
        at = np.minimum(np.searchsorted(self.all, grams), len(self.all) - 1)
        return np.where(self.all[at] == grams, at, -1)

    def best(self, grams: frozenset) -> tuple[float, str] | None:
        found = None
        for name, own, (low, high) in zip(self.names, self.sets, self.bounds, strict=True):
            if low - 1e-9 <= len(grams) <= high + 1e-9:
                dice = 2 * len(grams & own) / (len(grams) + len(own))
                if dice >= self.threshold - 1e-12 and (found is None or dice > found[0]):
                    found = (dice, name)
        return found


def _shared(size: int, low: float, least: float) -> float:
    """Shared bigrams of the smallest match with a template of ``size``."""
    return least * (low + size) / 2 - 1e-9


def _best_end(first: int, hit: np.ndarray, marks: list[int], size: int, high: float) -> tuple[float, int, int]:
    """Greatest Dice with a template of ``size`` of runs that begin at ``first``, and the run's ends; ``hit`` tells its bigrams."""
    found = (0.0, first, first)
    own: set[int] = set()
    common: set[int] = set()
    news = first
    for at in range(first, len(marks)):
        own.add(marks[at])
        # A run that only repeats itself for longer than a template ends there.
        if len(own) > high + 1e-9 or at - news > 2 * high:
            break
        if hit[at]:
            if marks[at] not in common:
                common.add(marks[at])
                news = at
            if (dice := 2 * len(common) / (len(own) + size)) >= found[0]:
                found = (dice, first, at)
            if dice == 1 and at - first + 1 >= high:
                break
    return found


def _runs(listed: list[int], hit: np.ndarray, size: int, low: float, high: float, least: float) -> list[tuple[float, int, int]]:
    """Runs ``(dice, first bigram, last bigram)`` apart from each other that reach ``least``; ``hit`` are the template's bigrams.

    From left to right: of the runs that begin within the first match, the best.
    """
    places, found, k = np.flatnonzero(hit), [], 0
    need = _shared(size, low, least)
    # A match spans at least ``need`` shared bigrams, with at most ``high`` distinct ones in all.
    while k + need <= len(places):
        best = _best_end(int(places[k]), hit, listed, size, high)
        if best[0] < least - 1e-12:
            k += 1
            continue
        stop, n = best[2], k + 1
        while best[0] < 1 and n < len(places) and places[n] <= stop:
            best = max(best, _best_end(int(places[n]), hit, listed, size, high), key=lambda x: x[0])
            n += 1
        found.append(best)
        k = int(np.searchsorted(places, best[2], "right"))
    return found


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first byte and end of every line of the texts."""
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    start = np.unique(start[start < len(data)])
    return np.searchsorted(offsets, start, "right") - 1, start, np.append(start[1:], len(data))


def find_licences(data: np.ndarray, offsets: np.ndarray, templates: Templates) -> list[list[tuple[str, float, str, int, int]]]:
    """Matches ``(licence, dice, unit, first byte, end)`` of each text, units from large to small."""
    out: list[list] = [[] for _ in range(len(offsets) - 1)]
    for a, b in chunks(offsets):
        base = int(offsets[a])
        text, cut = data[base : offsets[b]], offsets[a : b + 1] - base
        owner, start, end = _units(text, cut)
        # Bigrams of whole texts, so that those across a line break count as well.
        whole, row, *_ = _grams(text, cut)
        if not len(start) or not (hit := np.unique(row[templates.known(whole)])).size:
            continue
        grams, line, word_line, _, _ = _grams(text, np.append(start, end[-1]))
        order = np.argsort(line, kind="stable")
        grams, line = grams[order], line[order]
        first = np.searchsorted(line, np.arange(len(start) + 1))
        words = np.bincount(word_line, minlength=len(start))
        line_of = np.searchsorted(owner, np.arange(b - a + 1))
        for d in hit.tolist():
            lo, hi = int(line_of[d]), int(line_of[d + 1])
            spans = [("text", lo, hi)]
            edge = [lo - 1, *(lo + np.flatnonzero(words[lo:hi] == 0)).tolist(), hi]
            spans += [("paragraph", x + 1, y) for x, y in zip(edge, edge[1:], strict=False) if y - x > 1 and len(edge) > 2]
            spans += [("line", x, x + 1) for x in range(lo, hi) if hi - lo > 1 and words[x]]
            for unit, x, y in spans:
                if words[x:y].sum() > 4 * templates.largest + 64 and first[y] - first[x] > 8 * templates.largest + 64:
                    # Distinct bigrams can be fewer than bigrams, so count them before giving up.
                    if len(np.unique(grams[first[x] : first[y]])) > templates.largest:
                        continue
                if y - x == 1:
                    own = frozenset(grams[first[x] : first[y]].tolist())
                else:
                    s, e = int(start[x]), int(end[y - 1])
                    own = frozenset(_grams(text[s:e], np.array([0, e - s]))[0].tolist())
                if own and (match := templates.best(own)):
                    out[a + d].append((match[1], match[0], unit, int(start[x] - cut[d]), int(end[y - 1] - cut[d])))
            out[a + d] += _word_runs(text[cut[d] : cut[d + 1]], templates, out[a + d])
    return out


def _word_runs(text: np.ndarray, templates: Templates, units: list) -> list[tuple[str, float, str, int, int]]:
    """Runs of words that match, but for those that a unit or a better run of the licence covers as well."""
    _, start, end = find_words(LOWER[text], np.array([0, len(text)]), WORD)
    if len(start) < 2:
        return []
    h = span_hash(LOWER[text], start, end)
    marks = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    at = templates.places(marks)
    known = np.flatnonzero(at >= 0)
    held = templates.has[:, at[known]]
    listed: list[int] = []
    found = []
    for t in np.flatnonzero(held.any(1)).tolist():
        size, (low, high) = len(templates.sets[t]), templates.bounds[t]
        if held[t].sum() < _shared(size, low, templates.threshold):
            continue
        hit = np.zeros(len(marks), bool)
        hit[known[held[t]]] = True
        listed = listed or marks.tolist()
        for dice, a, b in _runs(listed, hit, size, low, high, templates.threshold):
            found.append((templates.names[t], dice, "words", int(start[a]), int(end[b + 1])))
    kept: list[tuple[str, float, str, int, int]] = []
    for x in sorted(found, key=lambda x: (-x[1], x[3] - x[4], x[0])):
        # A unit or a likelier run there has reported the licence, or a licence that is worded alike.
        if not any((u[0] == x[0] or u[1] >= x[1]) and u[3] < x[4] and x[3] < u[4] for u in [*units, *kept]):
            kept.append(x)
    return sorted(kept, key=lambda x: x[3])


def scan_licences(
    docs: DataFrame, templates: Mapping[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``id, licence, dice, n_matches, matches`` of every row; byte spans refer to the text's UTF-8 form."""
    held = Templates(TEMPLATES if templates is None else templates, threshold)
    schema = "licence string, dice double, matches array<struct<licence:string,dice:double,unit:string,first:long,end:long>>"
    fields = [("licence", pa.string()), ("dice", pa.float64()), ("unit", pa.string()), ("first", pa.int64()), ("end", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find_licences(*text_buffer(batch.column(1)), held)
            # max() returns the first of equals: the larger unit.
            best = [max(m, key=lambda x: x[1]) if m else (None, None) for m in found]
            rows = [[dict(zip((n for n, _ in fields), x, strict=True)) for x in m] for m in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([x[0] for x in best], pa.string()), pa.array([x[1] for x in best], pa.float64()),
                    pa.array(rows, pa.list_(pa.struct(fields))),
                ],
                names=["id", "licence", "dice", "matches"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {schema}")
    return found.select(F.col("id").alias(id_col), "licence", "dice", F.size("matches").cast("long").alias("n_matches"), "matches")
