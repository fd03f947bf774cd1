"""License notices found by MinHash bands over text windows and verified by exact containment.

Words are lower-cased runs of letters and digits.  Templates of fewer words than a shingle have one
shingle of all their words and are found by it.  The others fall into classes by length; a class has
a window of as many words as its shortest template, and longer templates are cut into overlapping
windows.  A document's windows of each class start at every word, so that a verbatim notice always
has a window with the template's own shingles.  Of every window the minima of ``rows * bands``
permuted shingle hashes make the band keys; a window whose key is a template's is a candidate.  Two
windows of similarity j share a key with probability 1 - (1 - j**rows) ** bands: with 16 bands of 2
rows 0.99997 at j = 0.7 and 1 for equal windows.  Around each candidate the share of the template's
shingles that occur in a stretch of the template's length (and a quarter more) is counted exactly;
a match needs ``least`` of them.

Templates are a parameter of bounded size and travel with the tasks; documents are scanned in one
pass without a shuffle, whole, a window never crossing a text's edge.

Nulls and texts without a template's words have no match; a template without words is an error.
Repeated rows match alike.  An empty table gives an empty result.  Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytestext import LOWER, as_bytes, mixed, prefix_sums, slices, span_hashes, tokens

SHINGLE, ROWS, BANDS = 5, 2, 16
#: Window lengths in words.
WINDOWS = (5, 7, 12, 24, 48)
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

#: Fixed: notices by which works of public licenses commonly say under what they are released, and short licenses in full.
TEMPLATES = {
    "All-rights-reserved": "All rights reserved.",
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
        " to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
        " The above copyright notice and this permission notice shall be included in all copies or substantial portions of"
        " the Software."
        " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO"
        " THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE"
        " AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,"
        " TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE"
        " SOFTWARE."
    ),
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
        " to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
        " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed"
        " on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
        " See the License for the specific language governing permissions and limitations under the License."
    ),
    "Apache-2.0-notice": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed"
        " on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
        " later version."
        " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied"
        " warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more"
        " details."
        " You should have received a copy of the GNU General Public License along with this program. If not, see"
        " <https://www.gnu.org/licenses/>."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met:"
    ),
    "BSD-3-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met:"
        " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the"
        " following disclaimer."
        " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the"
        " following disclaimer in the documentation and/or other materials provided with the distribution."
        " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission."
        " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES,"
        " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
        " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
        " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
        " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
        " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE"
        " OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies."
        " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL"
        " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,"
        " INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN"
        " AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR"
        " PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held"
        " liable for any damages arising from the use of this software."
        " Permission is granted to anyone to use this software for any purpose, including commercial applications, and to"
        " alter it and redistribute it freely, subject to the following restrictions:"
    ),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain."
        " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code"
        " form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def runs(texts: pa.Array, size: int, words: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word's place in it of the runs of so many words, in order; no run crosses a text's edge."""
    hashes, row = words if words is not None else word_hashes(texts)
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = mixed(h * np.uint64(3) + hashes[k : k + n])
    begins = np.searchsorted(row, np.arange(len(texts)))
    whole = row[:n] == row[size - 1 :]
    return h[whole], row[:n][whole], (np.arange(n) - begins[row[:n]])[whole]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each word; words are runs of letters, digits and bytes over 127."""
    body, offsets = as_bytes(texts)
    starts, ends, row = tokens(_INSIDE[body], offsets)
    return span_hashes(prefix_sums(LOWER[body]), starts, ends), row


def window_keys(h: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each band, the keys of the windows of so many shingles that start at each shingle."""
    n = len(h) - width + 1
    if n <= 0:
        return
    for band in range(BANDS):
        key = np.full(n, band, np.uint64)
        for r in range(ROWS):
            seed = np.uint64(0xD1B54A32D192ED03 * (band * ROWS + r + 1) & (1 << 64) - 1)
            least, span = (h ^ seed) * np.uint64(0x9FB21C651E98DF25), 1
            while span < width:
                step = min(span, width - span)
                least = np.minimum(least[step:], least[:-step])
                span += step
            key = mixed(key * np.uint64(5) + least)
        yield key


class Library:
    """The templates' shingles and the band keys of their windows, by window length."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names, self.sets, self.sizes = [], [], []
        self.classes: dict[int, tuple[list[np.ndarray], list[list[int]]]] = {}
        self.short: dict[int, dict[int, list[str]]] = {}
        for name, text in sorted(templates.items()):
            n = len(word_hashes(pa.array([text]))[0])
            if not n:
                raise ValueError(f"the template {name} has no words")
            h, _, _ = runs(pa.array([text]), min(n, SHINGLE))
            if n < SHINGLE:
                self.short.setdefault(n, {}).setdefault(int(h[0]), []).append(name)
                continue
            t = len(self.names)
            self.names.append(name)
            self.sets.append(np.unique(h))
            self.sizes.append(len(h))
            width = max(w for w in WINDOWS if w <= len(h) + SHINGLE - 1) - SHINGLE + 1
            keys, owners = self.classes.setdefault(width, ([[] for _ in range(BANDS)], []))
            for band, key in enumerate(window_keys(h, width)):
                keys[band].extend((int(k), t) for k in key)
        self.tables = {}
        for width, (keys, _) in self.classes.items():
            bands = []
            for pairs in keys:
                filtered = np.zeros(1 << 16, bool)
                known = np.array(sorted({k for k, _ in pairs}), np.uint64)
                filtered[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
                owners: dict[int, set[int]] = {}
                for k, t in pairs:
                    owners.setdefault(k, set()).add(t)
                bands.append((filtered, known, owners))
            self.tables[width] = bands

    def candidates(self, h: np.ndarray) -> dict[int, np.ndarray]:
        """For each template the shingles, ascending, where a window with one of its keys starts."""
        found: dict[int, list[np.ndarray]] = {}
        for width, bands in self.tables.items():
            for (filtered, known, owners), key in zip(bands, window_keys(h, width)):
                at = np.flatnonzero(filtered[(key & np.uint64(0xFFFF)).astype(np.int64)])
                at = at[np.isin(key[at], known)]
                if not len(at):
                    continue
                at = at[np.argsort(key[at], kind="stable")]
                for part in np.split(at, np.flatnonzero(np.diff(key[at])) + 1):
                    for t in owners[int(key[part[0]])]:
                        found.setdefault(t, []).append(part)
        return {t: np.unique(np.concatenate(parts)) for t, parts in found.items()}

    def verify(self, h: np.ndarray, edges: tuple[int, int], t: int, starts: np.ndarray) -> tuple[float, int, int]:
        """Best share of the template's shingles in a stretch around some windows, and the first stretch that holds them.

        Windows whose surroundings meet are looked at together, and all stretches of these in one pass.
        """
        size, known = self.sizes[t], self.sets[t]
        low, high = np.maximum(edges[0], starts - size), np.minimum(edges[1], starts + 2 * size)
        apart = np.flatnonzero(low[1:] > high[:-1]) + 1
        best = (0.0, int(starts[0]), int(starts[0]))
        for a, b in zip(low[np.append(0, apart)].tolist(), high[np.append(apart - 1, len(high) - 1)].tolist()):
            place = np.minimum(np.searchsorted(known, h[a:b]), len(known) - 1)
            here = np.flatnonzero(known[place] == h[a:b])
            if len(here):
                counts, last = distinct_ahead(here, place[here], size + size // 4)
                i = int(counts.argmax())
                if counts[i] / len(known) > best[0]:
                    best = (counts[i] / len(known), a + int(here[i]), a + int(here[last[i]]))
        return best


def distinct_ahead(at: np.ndarray, ids: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the ascending places the number of different ids in the reach that begins there, and which place is its last.

    A place counts for the beginnings after the place before it with its id, up to itself, that reach it.
    """
    n = len(at)
    end = np.searchsorted(at, at + reach)
    order = np.argsort(ids, kind="stable")
    before = np.full(n, -1)
    again = ids[order[1:]] == ids[order[:-1]]
    before[order[1:][again]] = order[:-1][again]
    first = np.maximum(before + 1, np.searchsorted(end, np.arange(n), "right"))
    steps = np.bincount(first, minlength=n + 1) - np.bincount(np.arange(n) + 1, minlength=n + 1)
    return np.cumsum(steps)[:n], end - 1


def _scan(templates: dict[str, str], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Library(templates)
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1)
                words = word_hashes(texts)
                h, row, _ = runs(texts, SHINGLE, words)
                edges = np.searchsorted(row, np.arange(part.num_rows + 1))
                best: dict[tuple[int, str], tuple[float, int, int]] = {}
                for t, starts in library.candidates(h).items():
                    docs = row[starts]
                    for mine in np.split(starts, np.flatnonzero(np.diff(docs)) + 1):
                        doc = int(row[mine[0]])
                        a, b = int(edges[doc]), int(edges[doc + 1])
                        share, i, j = library.verify(h, (a, b), t, mine)
                        if share >= least:
                            best[doc, library.names[t]] = (float(share), a - i, a - j - SHINGLE)
                for size, known in library.short.items():
                    h, row, place = runs(texts, size, words)
                    for i in np.flatnonzero(np.isin(h, np.array(list(known), np.uint64))).tolist():
                        for name in known[int(h[i])]:
                            found = (1.0, -int(place[i]), -int(place[i]) - size)
                            best[int(row[i]), name] = max(found, best.get((int(row[i]), name), found))
                rows = sorted(best)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array([d for d, _ in rows], pa.int64())),
                        pa.array([name for _, name in rows], pa.string()),
                        pa.array([best[k][0] for k in rows], pa.float64()),
                        pa.array([-best[k][1] for k in rows], pa.int64()),
                        pa.array([-best[k][2] for k in rows], pa.int64()),
                    ],
                    ["key", "license", "containment", "first_word", "end_word"],
                )

    return run


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, license, containment, first_word and end_word: the best stretch of each template in each row."""
    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        _scan(templates, least), f"key {kind}, license string, containment double, first_word bigint, end_word bigint"
    )
    return found.withColumnRenamed("key", key)
