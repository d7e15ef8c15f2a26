"""Operator 7: license scans by MinHash bands over overlapping text windows.

Words are runs of letters and digits, lower-cased; sets are of two-word shingles. Templates of like length form a
class, whose windows are as long as its longest template and start at every word. Windows and
templates are MinHashed; the number of bands is set so that a window which holds a template, and hence has a
similarity of SIMILARITY or more with it, shares a band with a probability of COLLIDE: a template of CLASS of the window's shingles, CONTAINED
of them in it, has CLASS * CONTAINED / (1 + CLASS - CLASS * CONTAINED). Long texts are searched in parts that overlap by a window. What
shares a band is compared exactly: the share of the template's shingles in the window decides."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import NOT_ALNUM, mix, table, text_slices, tidy, word_hashes

CONTAINED = 0.9
#: A class holds templates of at least this share of its window's shingles.
CLASS = 0.8
SIMILARITY = CLASS * CONTAINED / (1 + CLASS - CLASS * CONTAINED)
COLLIDE, ROWS = 0.999, 2
BANDS = math.ceil(math.log(1 - COLLIDE) / math.log(1 - SIMILARITY**ROWS))
#: Words that are searched at a time.
PART = 1 << 15
_MOST = np.uint64(2**64 - 1)
_KEYS = mix(np.arange(ROWS * BANDS, dtype=np.uint64) + np.uint64(101))
_ODD = mix(np.arange(ROWS * BANDS, dtype=np.uint64) + np.uint64(55)) | np.uint64(1)
_FILTER_BITS = 16

# Names of licenses and the notices by which they are usually given.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
]


def _shingles(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:] * np.uint64(0xA0761D6478BD642F))


def _bands(least: np.ndarray) -> np.ndarray:
    """Band values (BANDS x places) of sample minima (ROWS * BANDS x places)."""
    return np.stack([mix(sum((least[b * ROWS + r] * _ODD[r] for r in range(1, ROWS)), least[b * ROWS]) ^ _KEYS[b]) for b in range(BANDS)])


@dataclass
class LicenseIndex:
    """Templates by class: (window words, {band value: templates}, look-up bits)."""

    names: list[str]
    sets: list[np.ndarray]
    lengths: list[int]
    classes: list[tuple[int, dict[int, list[int]], np.ndarray]]

    @staticmethod
    def of(templates: list[tuple[str, str]]) -> LicenseIndex:
        hashes, bounds = word_hashes(pa.array([t for _, t in templates], pa.string()), NOT_ALNUM)
        words = [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        if any(len(w) < 2 for w in words):
            raise ValueError("a template needs two words or more")
        sets = [np.unique(_shingles(w)) for w in words]
        open_ = sorted(range(len(words)), key=lambda i: -len(words[i]))
        classes = []
        while open_:
            window = len(words[open_[0]])
            own = [i for i in open_ if len(words[i]) - 1 >= CLASS * (window - 1)]
            open_ = [i for i in open_ if i not in own]
            at: dict[int, list[int]] = {}
            for i in own:
                samples = np.stack([((sets[i] ^ k) * o).min(keepdims=True) for k, o in zip(_KEYS, _ODD, strict=True)])
                for value in _bands(samples)[:, 0].tolist():
                    at.setdefault(value, []).append(i)
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[[v >> (64 - _FILTER_BITS) for v in at]] = True
            classes.append((window, at, bits))
        return LicenseIndex([n for n, _ in templates], sets, [len(w) for w in words], classes)

    def search_parts(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, float]]:
        """`search` of rows of any length: what is longer than two parts is searched part by part, with room for a window from each place."""
        widest = max(w for w, _, _ in self.classes)
        long = np.flatnonzero(np.diff(bounds) > 2 * PART)
        if not len(long):
            return self.search(words, bounds)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        borders = sorted({0, len(bounds) - 1, *long.tolist(), *(long + 1).tolist()})
        for lo, hi in zip(borders[:-1], borders[1:], strict=True):
            first, last = int(bounds[lo]), int(bounds[hi])
            parts = range(first, last, PART) if hi - lo == 1 and last - first > 2 * PART else [first]
            for at in parts:
                end = min(last, at + PART + widest) if len(parts) > 1 else last
                inner = bounds[lo : hi + 1] - first if len(parts) == 1 else np.array([0, end - at])
                for row, i, word, share in self.search(words[at:end], inner):
                    found = (share, first - at - word)
                    best[lo + row, i] = max(best.get((lo + row, i), found), found)
        return [(row, i, -word, share) for (row, i), (share, word) in best.items()]

    def search(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(row, template, first word, containment) of the matches in the words of several rows."""
        widest = max(w for w, _, _ in self.classes)
        sizes = np.diff(bounds)
        starts = bounds[:-1] + np.arange(len(sizes)) * widest  # each row is followed by room for a window
        padded = np.zeros(int(bounds[-1]) + len(sizes) * widest + widest, np.uint64)
        real = np.zeros(len(padded), bool)
        place = np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], sizes)
        padded[place], real[place] = words, True
        both = _shingles(padded)
        void = ~(real[:-1] & real[1:])
        if void.all():
            return []
        window_least: dict[int, list[np.ndarray]] = {w: [] for w, _, _ in self.classes}
        for key, odd in zip(_KEYS, _ODD, strict=True):
            span, least = 1, (both ^ key) * odd
            least[void] = _MOST
            spans = {1: least}
            while 2 * span < widest:
                least = np.minimum(least[: len(least) - span], least[span:])
                span *= 2
                spans[span] = least
            for window in window_least:
                part = 1 << ((window - 1).bit_length() - 1)
                low = spans[part]
                step = window - 1 - part
                window_least[window].append(np.minimum(low[: len(low) - step], low[step:]) if step else low)
        found: dict[tuple[int, int], tuple[float, int]] = {}
        for window, at, bits in self.classes:
            for values in _bands_iter(window_least.pop(window)):
                # A window starts at a word of its row: behind a row's end it would reach into the next row.
                for spot in np.flatnonzero(bits[(values >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] & real[: len(values)]):
                    for i in at.get(int(values[spot]), ()):
                        row = int(np.searchsorted(starts, spot, "right")) - 1
                        own = both[spot : spot + window - 1]
                        share = float(np.isin(self.sets[i], own[~void[spot : spot + window - 1]]).mean())
                        first = int(spot - starts[row])
                        if share >= CONTAINED and (share, -first) > found.get((row, i), (0.0, 0)):
                            found[row, i] = (share, -first)
        return [(row, i, -first, share) for (row, i), (share, first) in found.items()]


def _bands_iter(least: list[np.ndarray]) -> Iterator[np.ndarray]:
    for b in range(BANDS):
        value = least[b * ROWS]
        for r in range(1, ROWS):
            value = value + least[b * ROWS + r] * _ODD[r]
        yield mix(value ^ _KEYS[b])


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, containment, word): one row for each document and license that it names.

    containment is the share of the best template's shingles in a window, CONTAINED or more; word is where that
    window starts (the first of equals). Null and empty texts name none; rows that repeat an id give their best; rows
    without an id are left out; other columns are not looked at. Texts are taken whole."""
    index = LicenseIndex.of(templates)
    sent = docs.sparkSession.sparkContext.broadcast(index)  # of the given templates

    def run(batches):
        index = sent.value
        for batch in batches:
            for lo, hi in text_slices(batch.column(1), 8 * PART):
                hits = index.search_parts(*word_hashes(batch.column(1).slice(lo, hi - lo), NOT_ALNUM))
                ids = batch.column(0).slice(lo, hi - lo).to_pylist()
                rows = [(ids[row], index.names[i], share, first) for row, i, first, share in hits]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.int64()), strict=True)], ["doc_id", "license", "containment", "word"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    hits = rows.mapInArrow(tidy(run), "doc_id long, license string, containment double, word long")
    best = F.max(F.struct("containment", (-F.col("word")).alias("word"))).alias("best")
    return hits.groupBy("doc_id", "license").agg(best).select("doc_id", "license", F.col("best.containment").alias("containment"), (-F.col("best.word")).alias("word"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
