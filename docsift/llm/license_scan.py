"""License scans: winnowed fingerprints pick templates, banded alignment measures them.

Template and text are words (A-Z lower-cased; letters, digits, anything outside ASCII). The k-word grams of a
template are hashed and winnowed (the least hash of each window of `WINNOW` grams), and filed in an inverted
index from fingerprint to (template, place). A text's grams are winnowed alike; those in the index propose a
template on a diagonal (place in the text less place in the template). Diagonals of one template within a band are one
candidate; the band is at most half the template, so that notices which follow each other stay apart. Each candidate is
aligned with its template in the band: matches score 2, a gap or a substitution -1, from whichever start and to
whichever end scores best. Alignments that go on in the template behind another, at most `MAX_GAP` words behind it in
the text, may be one notice with something inserted: a chain. Templates repeat phrases of their own, so an alignment
looks at all that it may follow, not at its neighbour, and the chain with most matched words is taken. Reported are the
share of the template's words that match, and the span.

Siblings differ by few words. A template is named only if, for every other template that would pass as it, at least half
of the words that set it apart from that one are among those matched; else their family is (the part before the first
hyphen that both names share), as for one half of a GPL notice, which may be of any version.

A shared stretch of at least GRAM + WINNOW - 1 words always shares a fingerprint; templates are no shorter than that.

Defined results: a null or empty text has no license; an empty table gives an empty one; repeated rows are scanned alike,
and texts are taken whole whatever their length. Of overlapping notices, of any templates, that with the most matched
words less those that its template has beyond them stays, then the first in the text, then by the template's place in
the list. Extra columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import ddl, passing, ship, slices

GRAM = 3
WINNOW = 2
BAND = 8
MIN_COVERAGE = 0.6
#: Words that may stand between two parts of one notice.
MAX_GAP = 48
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: Notices of public licenses, by SPDX name.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def winnowed(hashes: list[int], window: int = WINNOW) -> list[int]:
    """Places of the least hash of each window, the last of equals; all of them if there is less than one window."""
    if len(hashes) <= window:
        return [min(range(len(hashes)), key=lambda i: (hashes[i], -i))] if hashes else []
    places: list[int] = []
    for i in range(len(hashes) - window + 1):
        at = min(range(i, i + window), key=lambda j: (hashes[j], -j))
        if not places or places[-1] != at:
            places.append(at)
    return places


def gram_hashes(words: list[bytes]) -> list[int]:
    return [xxhash.xxh64_intdigest(b" ".join(words[i : i + GRAM])) for i in range(len(words) - GRAM + 1)]


@dataclass(frozen=True)
class Hit:
    license: str
    template: int
    coverage: float
    matched: int
    start_word: int
    end_word: int


@dataclass(frozen=True)
class Part:
    """An alignment: words that match and their places in the template (a bit each), ranges of words of the text and of
    the template."""

    matched: int
    places: int
    start: int
    end: int
    t_start: int
    t_end: int


def align(doc: list[int], template: list[int], diagonal: int, band: int = BAND) -> list[Part]:
    """Best local alignment in a band about a diagonal, and, if it changes diagonals, its pieces of one diagonal with
    GRAM matches or more: one that starts in a repeated phrase hides the piece that another alignment goes on with."""
    n = len(doc)
    best, best_score = (0, 0, 0, 0, 0), 0
    width = 2 * band + 1
    row = [(0, 0, -1, 0, 0)] * (width + 2)  # (score, matches, start, places in the template, places in the text), with a rim
    for j, want in enumerate(template):
        new = [(0, 0, -1, 0, 0)] * (width + 2)
        for d in range(width):
            i = j + diagonal + d - band
            if not 0 <= i < n:
                continue
            score, hits, start, places, own = row[d + 1]
            same = doc[i] == want
            if score <= 0:
                start, places, own = i, 0, 0
            options = [(score + 2, hits + 1, start, places | 1 << j, own | 1 << i) if same else (score - 1, hits, start, places, own)]
            for other in (row[d + 2], new[d]):  # a word of the template, or of the text, is skipped
                options.append((other[0] - 1, *other[1:]))
            top = max(options, key=lambda o: (o[0], o[1], -o[2]))
            new[d + 1] = top if top[0] > 0 else (0, 0, -1, 0, 0)
            if same and (top[0], top[1]) > (best_score, best[1]):
                best, best_score = top, top[0]
        row = new
    pairs = list(zip(_bits(best[4]), _bits(best[3])))
    pieces = [list(g) for _, g in groupby(pairs, key=lambda x: x[0] - x[1])]
    return [_part(x) for x in ([pairs] if pairs else []) + (([g for g in pieces if len(g) >= GRAM]) if len(pieces) > 1 else [])]


def _bits(mask: int) -> list[int]:
    return [i for i, c in enumerate(reversed(bin(mask))) if c == "1"]


def _part(pairs: list[tuple[int, int]]) -> Part:
    """Of matching places in text and template, in order."""
    return Part(len(pairs), sum(1 << j for _, j in pairs), pairs[0][0], pairs[-1][0] + 1, pairs[0][1], pairs[-1][1] + 1)


def chained(parts: list[Part], max_gap: int = MAX_GAP) -> list[Part]:
    """For each part of one template the best chain that ends with it: most matched words less a quarter of those
    between, then the nearest. A chain goes forward in text and template, with at most max_gap words between parts."""
    order = sorted({p for p in parts if p.matched}, key=lambda p: (p.end, p.start, p.t_start))
    ends = [p.end for p in order]
    best: list[tuple[float, Part]] = []
    for p in order:
        value, chain = float(p.matched), p
        before = None
        for k in range(bisect(ends, p.start - max_gap - 1), min(bisect(ends, p.start), len(best))):
            worth, q = best[k]
            if q.t_end <= p.t_start:
                worth -= (p.start - q.end) / 4
                if before is None or worth >= before[0]:
                    before = worth, q
        if before is not None:
            value, q = value + before[0], before[1]
            chain = Part(q.matched + p.matched, q.places | p.places, q.start, p.end, q.t_start, p.t_end)
        best.append((value, chain))
    return [chain for _, chain in best]


def best_apart(hits: list[Hit]) -> list[Hit]:
    """The best hits that don't overlap, by place. Those kept lie apart, so only neighbours can overlap another."""
    starts: list[int] = []
    kept: list[Hit] = []
    for h in sorted(hits, key=lambda h: (round(h.matched / h.coverage) - 2 * h.matched, h.start_word, h.end_word, h.template)):
        at = bisect(starts, h.start_word)
        if (at == 0 or kept[at - 1].end_word <= h.start_word) and (at == len(kept) or h.end_word <= kept[at].start_word):
            starts.insert(at, h.start_word)
            kept.insert(at, h)
    return kept


class Index:
    """The templates' fingerprints."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self.templates = [(name, words_of(text)) for name, text in templates]
        if any(len(w) < GRAM + WINNOW - 1 for _, w in self.templates):
            raise ValueError(f"a template needs {GRAM + WINNOW - 1} words")
        self.word: dict[bytes, int] = {}
        for _, w in self.templates:
            for x in w:
                self.word.setdefault(x, len(self.word))
        self.coded = [[self.word[x] for x in w] for _, w in self.templates]
        self.filed: dict[int, list[tuple[int, int]]] = {}
        for t, (_, w) in enumerate(self.templates):
            hashes = gram_hashes(w)
            for at in winnowed(hashes):
                self.filed.setdefault(hashes[at], []).append((t, at))
        self.marks = [self._marks(t) for t in range(len(self.templates))]

    def _marks(self, t: int) -> list[tuple[str, int]]:
        """For each other template of another name that would pass as this one: the words it lacks, a bit for each place."""
        name, own = self.templates[t]
        out = []
        for other, words in self.templates:
            if other == name:
                continue
            shared = sum((1 << b.size) - 1 << b.b for b in SequenceMatcher(None, words, own, autojunk=False).get_matching_blocks())
            lacks = (1 << len(own)) - 1 & ~shared
            if lacks and shared.bit_count() >= MIN_COVERAGE * len(own):
                out.append((other.partition("-")[0], lacks))
        return out

    def named(self, t: int, places: int) -> str:
        name = self.templates[t][0]
        like = [head for head, lacks in self.marks[t] if 2 * (lacks & places).bit_count() < lacks.bit_count()]
        own = name.partition("-")[0]
        return min([own, *(h for h in like if h in own)], key=len) if like else name

    def scan(self, words: list[bytes], min_coverage: float = MIN_COVERAGE) -> list[Hit]:
        """Licenses of a text, by place. Grams with a word that no template has can't be in the index, but take part
        in winnowing only through their neighbours, so just the stretches around known grams are hashed."""
        if len(words) < GRAM:
            return []
        get = self.word.get
        codes = [get(w, -1) for w in words]
        known = np.fromiter(codes, np.int64, len(codes)) >= 0
        full = known[:-2] & known[1:-1] & known[2:]
        places = np.flatnonzero(full)
        if not len(places):
            return []
        found: dict[int, list[int]] = {}
        last = len(words) - GRAM
        hashes: dict[int, int] = {}

        def hashed(i: int) -> int:
            if i not in hashes:
                hashes[i] = xxhash.xxh64_intdigest(b" ".join(words[i : i + GRAM]))
            return hashes[i]

        for at in places.tolist():
            h = hashed(at)
            if h not in self.filed:
                continue
            lowest = False
            for first in range(max(0, at - WINNOW + 1), min(at, max(0, last - WINNOW + 1)) + 1):
                window = range(first, min(first + WINNOW, last + 1))
                lowest = lowest or min(window, key=lambda j: (hashed(j), -j)) == at
            if lowest:
                for t, place in self.filed[h]:
                    found.setdefault(t, []).append(at - place)
        hits = []
        for t, diagonals in found.items():
            own = self.templates[t][1]
            band = min(BAND, len(own) // 2)
            diagonals = sorted(set(diagonals))
            groups: list[list[int]] = []
            for d in diagonals:
                if groups and d - groups[-1][0] <= band:
                    groups[-1].append(d)
                else:
                    groups.append([d])
            parts = []
            for g in groups:
                low = max(0, g[0] - band)
                part = codes[low : g[-1] + len(own) + 2 * band]
                found_here = align(part, self.coded[t], g[len(g) // 2] - low, band)
                parts += [Part(p.matched, p.places, low + p.start, low + p.end, p.t_start, p.t_end) for p in found_here]
            hits += [Hit(self.named(t, p.places), t, p.matched / len(own), p.matched, p.start, p.end) for p in chained(parts) if p.matched >= min_coverage * len(own)]
        return best_apart(hits)


@lru_cache(maxsize=4)
def index_of(templates: tuple[tuple[str, str], ...]) -> Index:
    """The index of these templates, built once in a worker."""
    return Index(templates)


_HIT = "array<struct<license:string,coverage:double,start:int,end:int>>"


def scan_licenses(docs: DataFrame, text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, keep_text: bool = True, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Add `licenses`: name, share of the template matched, and span (code points of the text) of each notice found."""
    ship(docs.sparkSession)
    fields = passing(docs, text, keep_text, "licenses")
    names = [f.name for f in fields]
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(templates)
        for batch in slices(batches):
            out = []
            for t in batch.column("_text").to_pylist():
                hits = index.scan(words_of(t), min_coverage)
                places = [m.span() for m in _WORD.finditer(t)] if hits else []
                out.append([{"license": h.license, "coverage": h.coverage, "start": places[h.start_word][0], "end": places[h.end_word - 1][1]} for h in hits])
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in names} | {"licenses": pa.array(out, kind)})

    schema = ddl(fields, f"licenses {_HIT}")
    return docs.withColumn("_text", F.col(text).cast("string")).mapInArrow(run, schema)


def op9_license(documents: DataFrame) -> DataFrame:
    """One row per document: how many notices it holds, their names, best coverage, and spans as license:start:end."""
    found = scan_licenses(documents.select("doc_id", "text"), keep_text=False)
    spans = F.transform("licenses", lambda h: F.concat_ws(":", h["license"], h["start"].cast("string"), h["end"].cast("string")))
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda h: h["license"]))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("licenses", lambda h: h["coverage"])), F.lit(0.0)).alias("coverage"),
        F.array_join(spans, ",").alias("spans"),
    )


def digest(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> str:
    """A version of the templates."""
    return hashlib.sha256(repr(templates).encode()).hexdigest()[:12]
