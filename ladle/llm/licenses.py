"""License scans (operator 6): templates by MinHash bands over overlapping text windows.

A text is read in overlapping windows of words. Word pairs are the shingles; each of several
permutations keeps its minimum in a window, and equal minima retrieve templates. The number of
permutations follows from the probability with which a template's window must meet it. Retrieved
templates are verified by exact containment of their word pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lower, map_batches, mix, quoted, slice_hashes, steps, table, text_bytes

#: Fixed values: (identifier, license text, or a notice or reference that documents carry in its place).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
    http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
MATCHES = "array<struct<license:string,containment:double,start_word:int,end_word:int>>"
#: Templates of more than size / 2 and at most size words (size: a power of 2) form a class. Its windows have 2 * size words and
#: start every size words, so that one of them holds any stretch as long as a template. Each band is one minimum; a class has so
#: many that they meet a passage which is just good enough with probability CERTAIN.
CERTAIN = 0.9999
_NONE = np.uint64((1 << 64) - 1)


def bands_of(size: int, sets: list[int], least: float) -> int:
    """Bands that a class needs: a passage has at least `least` of a template's pairs, its window 2 * size - 1 pairs at most."""
    worst = min(math.ceil(least * n) / (2 * size - 1 + n - math.ceil(least * n)) for n in sets)
    return math.ceil(math.log(1 - CERTAIN) / math.log(1 - min(worst, 0.9999)))


def _factors(bands: int) -> np.ndarray:
    return mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)


def _word_table() -> np.ndarray:
    """Which bytes belong to words: letters, digits and all beyond ASCII."""
    inside = np.zeros(256, bool)
    inside[128:] = True
    for b in range(128):
        inside[b] = chr(b).isalnum()
    return inside


_INSIDE = _word_table()


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of letters and digits, and each text's first word (one more entry)."""
    inside = _INSIDE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    some = offsets[:-1] < offsets[1:]
    first[offsets[:-1][some]] = inside[offsets[:-1][some]]
    last[offsets[1:][some] - 1] = inside[offsets[1:][some] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def _pairs(words: np.ndarray) -> np.ndarray:
    """A hash of each word and the next one."""
    return mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] + np.uint64(1))


@dataclass
class Index:
    """Templates: their names, distinct word pairs and words; bands[size]: a factor, sorted minima and the templates they belong to for each band."""

    ids: list[str]
    sets: list[np.ndarray]
    sizes: list[int]
    bands: dict[int, list[tuple[np.uint64, np.ndarray, np.ndarray]]]


def index(templates: list[tuple[str, str]], least: float) -> Index:
    """Templates must have two words at least and may be as long as they like; a name may have several."""
    sets, sizes = [], []
    for _, text in templates:
        data = np.frombuffer(text.encode(), np.uint8)
        start, end, _ = word_bounds(data, np.array([0, len(data)]))
        if len(start) < 2:
            raise ValueError(f"a template has {len(start)} words: {text[:40]}")
        sets.append(np.unique(_pairs(slice_hashes(lower(data), start, end))))
        sizes.append(len(start))
    bands: dict[int, list] = {}
    for size in sorted({1 << (n - 1).bit_length() for n in sizes}):
        own = np.array([k for k, n in enumerate(sizes) if size // 2 < n <= size])
        bands[size] = []
        for factor in _factors(bands_of(size, [len(sets[k]) for k in own], least)):
            minima = np.array([(sets[k] * factor).min() for k in own])
            order = np.argsort(minima)
            bands[size].append((factor, minima[order], own[order]))
    return Index([i for i, _ in templates], sets, sizes, bands)


def best_stretch(near: np.ndarray, template: np.ndarray, n: int) -> tuple[int, int]:
    """The most distinct pairs of a template in n - 1 neighbouring pairs of near, and where they begin (the first of equals)."""
    places = max(len(near) - n + 2, 1)
    hit = np.flatnonzero(np.isin(near, template))
    order = hit[np.argsort(near[hit], kind="stable")]
    before = np.full(len(order), -1)
    same = near[order[1:]] == near[order[:-1]]
    before[1:][same] = order[:-1][same]
    # A pair counts for the stretches that reach it but not the same pair before it.
    edges = np.zeros(places + 1, int)
    first, last = np.maximum(before + 1, order - (n - 2)), np.minimum(order, places - 1)
    some = first <= last
    np.add.at(edges, first[some], 1)
    np.add.at(edges, last[some] + 1, -1)
    counts = np.cumsum(edges)[:places]
    return int(counts.max()), int(counts.argmax())


def scan_batch(offsets: np.ndarray, data: np.ndarray, templates: Index, least: float) -> list[list[dict]]:
    """The licenses found in each text, with their best containment and place."""
    out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
    start, end, first = word_bounds(data, offsets)
    if len(start) < 2:
        return out
    pairs = np.append(_pairs(slice_hashes(lower(data), start, end)), np.uint64(0))
    lasts = first[1:][np.diff(first) > 0] - 1  # a text's last word has no next one
    candidates: set[tuple[int, int, int, int]] = set()
    blocks = {}
    for size in templates.bands:
        number = -(-np.diff(first) // size)
        owner = np.repeat(np.arange(len(number)), number)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
        blocks[size] = (first[owner] + inner * size, owner)
    for band in range(max(map(len, templates.bands.values()), default=0)):
        values = None
        for size, tables in templates.bands.items():
            if band >= len(tables):
                continue
            factor, minima, of = tables[band]
            if values is None:
                values = pairs * factor
                values[lasts] = _NONE
            begin, owner = blocks[size]
            low = np.minimum.reduceat(values, begin)
            window = low.copy()
            same = owner[1:] == owner[:-1]
            window[:-1][same] = np.minimum(low[:-1], low[1:])[same]
            at = np.minimum(np.searchsorted(minima, window), len(minima) - 1)
            for w in np.flatnonzero(minima[at] == window).tolist():
                for j in range(int(at[w]), len(minima)):
                    if minima[j] != window[w]:
                        break
                    candidates.add((int(owner[w]), int(of[j]), int(begin[w]), size))
    best: dict[tuple[int, str], tuple[float, int, int]] = {}
    for row, k, begin, size in sorted(candidates):
        stop = min(begin + 2 * size, int(first[row + 1]))
        n = templates.sizes[k]
        common, place = best_stretch(pairs[begin : stop - 1], templates.sets[k], n)
        share = common / len(templates.sets[k])
        key = (row, templates.ids[k])
        if share >= least and share > best.get(key, (0, 0, 0))[0]:
            place += begin - int(first[row])
            best[key] = (share, place, min(place + n, int(first[row + 1] - first[row])))
    for (row, name), (share, at, to) in sorted(best.items()):
        out[row].append({"license": name, "containment": share, "start_word": at, "end_word": to})
    return out


def with_licenses(docs: DataFrame, text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.8, out_col: str = "licenses") -> DataFrame:
    """docs with the licenses of which a template stands in the text: at least the share `least` of its word pairs in a stretch as long.

    Words are runs of letters and digits, A-Z as a-z. Of each license the best stretch is given
    (of equals the one of the first template and place). Null and empty texts hold none;
    repeated rows stay. A column of docs named like the new one is replaced, all others stay.
    The templates, a list of (license, text) of any length, are a parameter, so their index goes
    to every task.
    """
    keep = docs.drop(out_col)
    names = keep.columns
    kind = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()), ("start_word", pa.int32()), ("end_word", pa.int32())]))
    built = index(templates, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column(names.index(text_col)))
            for a, b in steps(offsets):
                found = scan_batch(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]], built, least)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(found, kind)], names=[*names, out_col])

    return map_batches(keep, run, names, f"{quoted(out_col)} {MATCHES}")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and each license in it."""
    found = with_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode("licenses").alias("m"))
    return found.select("doc_id", "m.license", "m.containment", "m.start_word", "m.end_word")
