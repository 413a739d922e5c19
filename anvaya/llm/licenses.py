"""License scans by MinHash bands over overlapping windows.

Texts and license templates are sets of five-word shingles. A template of m
shingles belongs to the window size S with S / 4 < m <= S / 2; windows of S
shingles advance by S / 2, so some window holds the whole of any occurrence. Each of
``BANDS`` single-row bands keeps the least hash of a window; a template is
retrieved where any band agrees. At containment 0.8 a window and its template
have a resemblance of at least 0.8 m / (S + 0.2 m) > 0.19, so a band agrees
with that probability and all miss with less than 0.81**BANDS = 0.0012.

Retrieved templates are then verified exactly: positions whose shingle is one
of the template's form clusters with gaps of at most m, and a cluster is a
match if it holds at least ``CONTAINMENT`` of the template's distinct shingles.
A match inside another one of higher containment is left out.

Defined results: a null text, or one of fewer than five words, has no match;
texts are scanned whole; several matches of one template are reported each;
ties in start go by name; repeated rows repeat their result; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
BANDS = 32
CONTAINMENT = 0.8
LEAST_WINDOW = 8
CACHE_WORDS = 400_000
WORD = re.compile(r"[^\W_]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)

#: Public license notices, as they are usually written.
TEMPLATES = {
    "AGPL-3.0 notice": """This program is free software: you can redistribute it and/or modify it
        under the terms of the GNU Affero General Public License as published by the Free
        Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
        PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may
        not use this file except in compliance with the License. You may obtain a copy of the
        License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
        or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under
        the License.""",
    "BSD conditions": """Redistribution and use in source and binary forms, with or without
        modification, are permitted provided that the following conditions are met:
        Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce
        the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
    "BSD-3-Clause endorsement": """Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software
        without specific prior written permission.""",
    "BSL-1.0 grant": """Permission is hereby granted, free of charge, to any person or organization
        obtaining a copy of the software and accompanying documentation covered by this license
        (the "Software") to use, reproduce, display, distribute, execute, and transmit the
        Software, and to prepare derivative works of the Software, and to permit third-parties
        to whom the Software is furnished to do so""",
    "BSL-1.0 line": "Distributed under the Boost Software License, Version 1.0",
    "BSD disclaimer": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
        AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "CC BY line": "Licensed under CC BY 4.0",
    "CC BY-NC line": "Licensed under CC BY-NC 4.0",
    "CC BY-SA line": "Licensed under CC BY-SA 4.0",
    "CC BY statement": """This work is licensed under a Creative Commons Attribution 4.0
        International License""",
    "CC BY-SA statement": """This work is licensed under a Creative Commons
        Attribution-ShareAlike 4.0 International License""",
    "CC0 statement": """To the extent possible under law, the author has waived all copyright and
        related or neighboring rights to this work""",
    "EPL-2.0 notice": """This program and the accompanying materials are made available under the
        terms of the Eclipse Public License 2.0 which is available at
        https://www.eclipse.org/legal/epl-2.0""",
    "GPL-2.0 line": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3",
    "GPL notice": """This program is free software: you can redistribute it and/or modify it under
        the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version. This
        program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details.""",
    "ISC notice": """Permission to use, copy, modify, and/or distribute this software for any purpose
        with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies.""",
    "LGPL notice": """This library is free software; you can redistribute it and/or modify it under
        the terms of the GNU Lesser General Public License as published by the Free Software
        Foundation; either version 2.1 of the License, or (at your option) any later version.
        This library is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
        PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "MIT line": "Released under the MIT License",
    "MIT notice": """Permission is hereby granted, free of charge, to any person obtaining a copy of
        this software and associated documentation files (the "Software"), to deal in the
        Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in
        all copies or substantial portions of the Software.""",
    "MPL-2.0 notice": """This Source Code Form is subject to the terms of the Mozilla Public License,
        v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        https://mozilla.org/MPL/2.0/.""",
    "OFL-1.1 line": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "Unlicense notice": """This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
        software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""",
    "zlib notice": """This software is provided 'as-is', without any express or implied warranty. In
        no event will the authors be held liable for any damages arising from the use of this
        software. Permission is granted to anyone to use this software for any purpose,
        including commercial applications, and to alter it and redistribute it freely""",
}


class WordHashes:
    """64-bit hashes of words, with those of recent words at hand."""

    def __init__(self) -> None:
        self._known: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        known = self._known
        if len(known) > CACHE_WORDS:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total = total * _STEP + words[k : k + n]
    return mixed(total)


def window_size(m: int) -> int:
    """The window class of a template of m shingles: the least S with m <= S / 2."""
    size = LEAST_WINDOW
    while m > size // 2:
        size *= 2
    return size


def band_minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """[band, block] least hash per band of each block of shingles."""
    out = np.empty((BANDS, len(starts)), np.uint64)
    for band in range(BANDS):
        salt = mixed(np.array([band + 1], np.uint64) * _STEP)
        odd = salt | np.uint64(1)
        scrambled = (values ^ salt) * odd
        scrambled ^= scrambled >> np.uint64(32)
        out[band] = np.minimum.reduceat(scrambled * odd, starts)
    return out


@dataclass(frozen=True)
class Library:
    """Templates by window class, with the band values that retrieve them."""

    names: list[str]
    sets: list[np.ndarray]
    sizes: dict[int, tuple[np.ndarray, np.ndarray]]  # S -> templates, [band, template] values

    @staticmethod
    def build(templates: dict[str, str]) -> "Library":
        hashes = WordHashes()
        names = sorted(templates)
        sets = [np.unique(shingles(hashes.of(WORD.findall(lowered(templates[n]))))) for n in names]
        sizes: dict[int, list[int]] = {}
        for k, values in enumerate(sets):
            if len(values):
                sizes.setdefault(window_size(len(values)), []).append(k)
        zero = np.zeros(1, np.int64)
        return Library(names, sets, {
            size: (np.array(own), np.concatenate([band_minima(sets[k], zero) for k in own], axis=1))
            for size, own in sizes.items()
        })

    def retrieve(self, values: np.ndarray) -> set[int]:
        """Templates that share a band with some window of a text's shingles."""
        found: set[int] = set()
        if not len(values):
            return found
        half = LEAST_WINDOW // 2
        minima = band_minima(values, np.arange(0, len(values), half))
        size = LEAST_WINDOW
        for wanted in range(max(self.sizes).bit_length()):
            if size > max(self.sizes):
                break
            windows = np.minimum(minima[:, :-1], minima[:, 1:]) if minima.shape[1] > 1 else minima
            if size in self.sizes:
                own, bands = self.sizes[size]
                for k, template in enumerate(own.tolist()):
                    if template not in found and (windows == bands[:, k, None]).any():
                        found.add(template)
            # Blocks of the next class are pairs of this one's.
            if minima.shape[1] > 1:
                if minima.shape[1] % 2:
                    minima = np.concatenate([minima, minima[:, -1:]], axis=1)
                minima = np.minimum(minima[:, 0::2], minima[:, 1::2])
            size *= 2
        return found

    def verify(self, values: np.ndarray, template: int) -> list[tuple[int, int, float]]:
        """(first shingle, last shingle, containment) of every match in a text."""
        own = self.sets[template]
        at = np.flatnonzero(np.isin(values, own))
        if not len(at):
            return []
        found = []
        for cluster in np.split(at, np.flatnonzero(np.diff(at) > len(own)) + 1):
            share = len(np.unique(values[cluster])) / len(own)
            if share >= CONTAINMENT:
                found.append((int(cluster[0]), int(cluster[-1]), share))
        return found


def lowered(text: str) -> str:
    """The text in lower case, every letter still at its place."""
    return text.replace("İ", "i").lower()  # the one letter that would become two


def outermost(spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """The sorted spans that lie in no other one of higher share.

    From the highest share down, each is compared with the furthest end among the
    higher ones that start no later, kept in a binary indexed tree.
    """
    starts = sorted({x[0] for x in spans})
    ends = [0] * (len(starts) + 1)

    def reach(k: int) -> int:
        best = 0
        while k:
            best, k = max(best, ends[k]), k & (k - 1)
        return best

    kept = []
    for _, group in itertools.groupby(sorted(spans, key=lambda x: -x[3]), key=lambda x: x[3]):
        group = list(group)
        kept += [x for x in group if reach(bisect.bisect_right(starts, x[0])) < x[1]]
        for x in group:
            k = bisect.bisect_right(starts, x[0])
            while k < len(ends):
                ends[k] = max(ends[k], x[1])
                k += k & -k
    return sorted(kept)


def matches(text: str, library: Library, hashes: WordHashes) -> list[tuple[int, int, str, float]]:
    """(start, end, name, containment) in code points, end exclusive."""
    low = lowered(text)
    values = shingles(hashes.of(WORD.findall(low)))
    found = [
        (first, last, library.names[template], share)
        for template in library.retrieve(values)
        for first, last, share in library.verify(values, template)
    ]
    if not found:
        return []
    places = [m.span() for m in WORD.finditer(low)]
    return outermost([
        (places[first][0], places[last + SHINGLE - 1][1], name, share)
        for first, last, name, share in found
    ])


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_matches, licenses, spans) for every row of ``docs``.

    ``licenses`` lists the distinct names, ``spans`` name:start:end:containment
    by start; both are empty strings where nothing matches.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, hashes = Library.build(templates), WordHashes()
        for batch in batches:
            found = [matches(t.as_py() or "", library, hashes) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(m) for m in found], pa.int64()),
                    pa.array([",".join(sorted({x[2] for x in m})) for m in found], pa.string()),
                    pa.array([
                        ",".join(f"{name}:{a}:{b}:{share:.4f}" for a, b, name, share in m)
                        for m in found
                    ], pa.string()),
                ],
                names=["doc_id", "n_matches", "licenses", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_matches long, licenses string, spans string"
    )
