"""Licence scans: winnowed fingerprints of templates pick candidates, banded alignment measures and places them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shingles import WordHashes, mix

#: Words of a fingerprint, and fingerprints of a window of which the least is kept.
GRAM, WINDOW = 3, 4
#: Share of a template's words that an alignment must match, and words it may drift for each word of the template.
COVERAGE, DRIFT = 0.8, 0.2
#: Share of a template's fingerprints that a place must hold to be aligned (at least one).
EVIDENCE = 0.1
#: Characters of templates that a task holds at most.
TEMPLATE_CHARS = 4_000_000

# Notices as their licences word them.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
#: Names and versions by which templates differ from look-alikes, as patterns of `plain` text: each must stand in a place.
KEYS = {
    "apache-2.0-line": ("apache license (?:(?:version |v ?)?2[. ]0|(?:version |v ?)2)",),
    "mit-line": ("mit (?:x11 |expat )?license",),
    "gpl-3.0-line": ("gnu general public license (?:version |v ?)3(?:[. ]0)?",),
    "cc-by-nc-4.0-line": ("cc by nc (?:version |v ?)?4[. ]0",),
    "mit": ("shall be included",),
    "apache-2.0": ("apache license (?:(?:version |v ?)?2[. ]0|(?:version |v ?)2)",),
    "gpl-3.0": ("terms of the gnu general public license", "(?:version |v ?)3(?:[. ]0)?"),
    "mpl-2.0": ("mozilla public license (?:version |v ?)?2[. ]0",),
}
#: A template of fewer words has its whole wording as its key, if none is given, and holds no other licence's name.
SHORT = 20
#: Words that may stand inside a key, and words after a place in which a key may end.
FILLERS, TAIL = ("the", "is", "are", "hereby", "open", "source", "software"), 3
_WORD = re.compile(r"[^\W_]+")


def lowered(text: str) -> str:
    """Lower case, one spelling of licence; as long as text.lower()."""
    return text.lower().replace("licence", "license")


def plain(text: str, spans: list[tuple[int, int]]) -> str:
    """The words at spans with single spaces, but with the dot inside a version number."""
    out, end = [], None
    for a, b in spans:
        out += ["" if end is None else "." if text[end:a] == "." and text[a].isdigit() else " ", text[a:b]]
        end = b
    return "".join(out)


def key_pattern(key: str) -> re.Pattern:
    """A key as whole words, FILLERS between them, and not the beginning of a longer version number."""
    gap = f" (?:(?:{'|'.join(FILLERS)}) )*"
    return re.compile(rf"(?<![\w.]){re.sub('(?<!v) (?![?.\\]])', lambda _: gap, key)}(?!\w|\.\d)")


def grams(words: list[str], hashes: WordHashes) -> np.ndarray:
    """Hashes of the GRAM-word sequences (of all words, if there are fewer)."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter((hashes[w.encode("utf-8", "surrogatepass")] for w in words), np.uint64, len(words))
    size = min(GRAM, len(words))
    n = len(words) - size + 1
    acc = np.full(n, size, np.uint64)
    for k in range(size):
        acc = mix(acc + h[k : k + n])
    return acc


def winnow(h: np.ndarray) -> list[int]:
    """Places of the kept fingerprints: the rightmost least of each window of WINDOW."""
    if len(h) <= WINDOW:
        return list(range(len(h)))
    return sorted({at + WINDOW - 1 - int(np.argmin(h[at : at + WINDOW][::-1])) for at in range(len(h) - WINDOW + 1)})


def align(template: list[str], words: list[str], band: int) -> tuple[int, int, int]:
    """(matched words, first, last + 1 matched word) of the best alignment of the whole template along the diagonal of
    `words`, at most `band` words off it: most matches, then the shortest span."""
    # A cell holds (matches, -start, stop); gaps cost nothing, the band and the coverage bound them.
    none = (0, 0, 0)
    last: dict[int, tuple[int, int, int]] = {}
    for i, t in enumerate(template):
        now: dict[int, tuple[int, int, int]] = {}
        left = none
        for j in range(max(0, i), min(len(words), i + 2 * band + 1)):
            best = max(left, last.get(j, none))
            if words[j] == t:
                before = last.get(j - 1, none)
                best = max(best, (before[0] + 1, before[1] if before[0] else -j, j + 1))
            now[j] = left = best
        if not now:  # the words end before the template does
            break
        last = now
    m, start, stop = max(last.values(), default=none)
    return m, -start, stop


class Scanner:
    """All templates with their inverted index of fingerprints."""

    def __init__(self, templates: dict[str, str], coverage: float, keys: dict[str, tuple[str, ...]] | None = None):
        self.coverage, self.hashes = coverage, WordHashes()
        self.names = sorted(templates)
        lower = [lowered(templates[k]) for k in self.names]
        self.words = [_WORD.findall(x) for x in lower]
        keys = {k: v for k, v in KEYS.items() if templates.get(k) == TEMPLATES[k]} | (keys or {})
        whole = [(re.escape(plain(x, [m.span() for m in _WORD.finditer(x)])).replace("\\ ", " "),) if len(w) < SHORT else () for x, w in zip(lower, self.words, strict=True)]
        self.keys = [[key_pattern(x) for x in keys.get(k, w)] for k, w in zip(self.names, whole, strict=True)]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        self.kept = []
        for t, w in enumerate(self.words):
            h = grams(w, self.hashes)
            keep = winnow(h) if len(w) >= SHORT else range(len(h))
            self.kept.append(len(keep))
            for at in keep:
                self.postings.setdefault(int(h[at]), []).append((t, at))
        self.index = np.array(sorted(self.postings), np.uint64)

    def __call__(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, matched words, first, last + 1 character) of each place, in the text's order."""
        if not len(self.index):
            return []
        lower = lowered(text)
        words = _WORD.findall(lower)
        h = grams(words, self.hashes)
        if not len(h):
            return []
        near = np.minimum(np.searchsorted(self.index, h), len(self.index) - 1)
        hits = np.flatnonzero(self.index[near] == h)
        if not len(hits):
            return []
        places: dict[int, list[int]] = {}
        for at in hits.tolist():
            for t, k in self.postings[int(h[at])]:
                places.setdefault(t, []).append(at - k)
        low = [m.span() for m in _WORD.finditer(lower)]
        spans = low if len(lower) == len(text) else [m.span() for m in _WORD.finditer(text)]
        if len(spans) != len(words):  # lowering changed what is a word
            spans = low
        out = []
        for t, starts in places.items():
            w = self.words[t]
            band = max(2, int(len(w) * DRIFT))
            starts.sort()
            group = [starts[0]]
            for s in [*starts[1:], None]:
                if s is not None and s - group[-1] <= band:
                    group.append(s)
                    continue
                # Fingerprints of one diagonal, give or take the band, are one place; long runs are cut by the template's length.
                for lo in dict.fromkeys(group[0] + (g - group[0]) // max(1, len(w)) * len(w) for g in group):
                    here = [g for g in group if lo <= g < lo + max(1, len(w))]
                    if len(here) < max(1, int(self.kept[t] * EVIDENCE)):
                        continue
                    first = here[0] - band
                    wide = band + (here[-1] - here[0] + 1) // 2
                    before = [""] * -first  # the band reaches over the beginning of the text
                    m, a, b = align(w, before + words[max(0, first) : max(0, first + len(w) + 2 * wide)], wide)
                    if m >= self.coverage * len(w) and m and self.named(t, lower, low, first + a, first + b):
                        out.append((self.names[t], m / len(w), m, spans[first + a][0], spans[first + b - 1][1]))
                group = [s]
        return sorted(set(out), key=lambda x: (x[3], x[0], x[4]))

    def named(self, t: int, lower: str, spans: list[tuple[int, int]], a: int, b: int) -> bool:
        """Whether the words from a to b name the licence of template t: its keys begin there, no other licence is named."""
        w = self.words[t]
        if len(w) < SHORT and sum(lower[x:y] == "license" for x, y in spans[a:b]) > w.count("license"):
            return False
        held, inside = plain(lower, spans[a : b + TAIL]), len(plain(lower, spans[a:b]))
        return all((hit := key.search(held)) and hit.start() < inside for key in self.keys[t])


def scan_licenses(df: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE, keys: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(id, license, coverage, matched_words, start, stop) for every place of every whole text of df at which at least
    `coverage` of a template's words stand in order, near one another, and with them the template's keys (its name and
    version; KEYS for the templates of this module, `keys` adds others). A template of fewer than SHORT words without
    keys must stand whole, one of more words without keys only by its share; start and stop are characters of the text.

    Templates (name to text; TEMPLATE_CHARS characters at most) go to every task; the documents aren't shuffled. Case
    and punctuation don't count. Null and empty texts and templates without words match nothing; repeated rows are
    reported as often as they occur; a null id stays null; other columns are ignored."""
    templates = TEMPLATES if templates is None else templates
    if sum(map(len, templates.values())) > TEMPLATE_CHARS:
        raise ValueError(f"templates hold over {TEMPLATE_CHARS} characters: scan with parts of them")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(templates, coverage, keys)
        for batch in batches:
            ids, rows = [], []
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                if (x := text.as_py()) and (found := scan(x)):
                    ids += [i.as_py()] * len(found)
                    rows += found
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", "license", "coverage", "matched_words", "start", "stop"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(run, "id long, license string, coverage double, matched_words long, start long, stop long")
    return out.withColumnRenamed("id", id_col)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence notice in all whole documents."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
