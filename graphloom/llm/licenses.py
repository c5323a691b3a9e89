"""License scan by diagonal voting.

Every rolling word k-gram of every text is joined with the k-grams of the templates. A shared k-gram
votes for the diagonal (word position in the text less that in the template) of its template; votes are
summed by diagonal, neighbouring diagonals are merged into one candidate, and each candidate is verified by
the longest common subsequence of its span and the template. Of verified spans of a text that overlap, the one with
most words in common stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import small_or_shuffled, whole_id, written
from .textcore import row_slices, span_hashes, words

K = 3
MIN_COVERAGE = 0.8
#: Merged are diagonals at most this part of the template's words apart (one at least).
DRIFT = 0.15
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
#: (license, template). A license may have several templates.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT),
    ("MIT", _NO_WARRANTY),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD", _BSD),
    ("BSD", "Licensed under the BSD 3-Clause License."),
    ("BSD", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]


def word_hashes(text: str) -> np.ndarray:
    return words(pa.array([text])).hash


def _kgrams(hashes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    return span_hashes(hashes, starts, starts + k).view(np.int64)


def template_grams(spark: SparkSession, templates: list[tuple[str, str]], k: int) -> DataFrame:
    """(gram, template, at, size) of every k-gram of every template; shorter templates have none."""
    rows = []
    for number, (_, text) in enumerate(templates):
        hashes = word_hashes(text)
        starts = np.arange(len(hashes) - k + 1)
        rows += [(g, number, at, len(hashes)) for at, g in enumerate(_kgrams(hashes, starts, k).tolist())] if len(starts) else []
    return spark.createDataFrame(rows, "gram long, template int, at int, size int")


def text_grams(docs: DataFrame, k: int) -> DataFrame:
    """(row, pos, gram) of every k-gram of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                word = words(part.column("text"))
                n = np.maximum(np.diff(word.first) - k + 1, 0)
                pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                gram = _kgrams(word.hash, np.repeat(word.first[:-1], n) + pos, k)
                row = part.column("row").take(pa.array(np.repeat(np.arange(len(n)), n)))
                for start in range(0, len(gram), 1 << 16):
                    end = start + (1 << 16)
                    yield pa.RecordBatch.from_arrays([row[start:end], pa.array(pos[start:end].astype(np.int32)), pa.array(gram[start:end])], names=["row", "pos", "gram"])

    return docs.select(F.xxhash64("doc_id", "text").alias("row"), "text").mapInArrow(run, "row long, pos int, gram long")


def candidates(docs: DataFrame, grams: DataFrame, drift: float = DRIFT) -> DataFrame:
    """(row, template, low, high, votes): merged neighbouring diagonals that got votes."""
    known = written(grams, "templates")
    votes = text_grams(docs, K).join(small_or_shuffled(known), "gram")
    by_diagonal = votes.groupBy("row", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.countDistinct("pos").alias("votes"), F.first("size").alias("size"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.greatest(F.lit(1), F.floor(F.col("size") * drift))
    begins = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > gap).cast("int"), F.lit(1))
    merged = by_diagonal.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order))
    return merged.groupBy("row", "template", "run").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum("votes").alias("votes"))


def _subsequence(template: list[int], span: list[int]) -> tuple[int, int]:
    """Length of the longest common subsequence (bit-parallel), and the first index in span by which it is reached."""
    where: dict[int, int] = {}
    for i, h in enumerate(template):
        where[h] = where.get(h, 0) | 1 << i
    full = (1 << len(template)) - 1
    row, best, last = full, 0, -1
    for j, h in enumerate(span):
        match = where.get(h, 0)
        if match:
            u = row & match
            row = ((row + u) | (row - u)) & full
            now = len(template) - row.bit_count()
            if now > best:
                best, last = now, j
    return best, last


def common_words(template: np.ndarray, span: np.ndarray) -> tuple[int, int, int]:
    """Length of the longest common subsequence, and first and last index in span of a tight place of it."""
    t, s = template.tolist(), span.tolist()
    best, last = _subsequence(t, s)
    if not best:
        return 0, -1, -1
    return best, last - _subsequence(t[::-1], s[last::-1])[1], last


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, license, template, first_word, last_word, coverage) of every license span of docs (doc_id, text; others are ignored).

    coverage is the part of the template's words that the span has in order, at least min_coverage. Positions count
    words of the text from 0. Spans of one text that overlap: the one of most common words stays, then
    the higher coverage, then the first template. Null and empty texts have no spans; a null doc_id is kept; rows equal in doc_id and
    text give their spans once each. An empty table gives no rows.
    """
    templates = TEMPLATES if templates is None else templates
    names = [name for name, _ in templates]
    hashes = [word_hashes(text) for _, text in templates]
    found = written(candidates(docs, template_grams(docs.sparkSession, templates, K)), "candidates")
    lists = written(found.groupBy(F.col("row").alias("_row")).agg(F.sort_array(F.collect_list(F.struct("template", "low", "high"))).alias("_spans")), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                word = words(part.column("text"))
                out: list[tuple] = []
                for i, (doc_id, spans) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("_spans").to_pylist())):
                    own, good = word.hash[word.first[i] : word.first[i + 1]], []
                    for s in spans:
                        t, slack = s["template"], max(1, int(len(hashes[s["template"]]) * DRIFT))
                        start = max(0, s["low"] - slack)
                        n, first, last = common_words(hashes[t], own[start : s["high"] + len(hashes[t]) + slack])
                        if n >= min_coverage * len(hashes[t]):
                            good.append((-n, -n / len(hashes[t]), t, start + first, start + last))
                    taken: list[tuple] = []
                    for g in sorted(good):
                        if all(g[3] > x[4] or g[4] < x[3] for x in taken):
                            taken.append(g)
                    out += [(doc_id, names[t], t, a, b, round(-c, 6)) for _, c, t, a, b in sorted(taken, key=lambda x: x[3])]
                columns = list(zip(*out)) or [()] * 6
                types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["doc_id", "license", "template", "first_word", "last_word", "coverage"])

    keyed = docs.select(whole_id(), "text", F.xxhash64("doc_id", "text").alias("_row"))
    joined = keyed.join(small_or_shuffled(lists), "_row").select("doc_id", "text", "_spans")
    return joined.mapInArrow(run, "doc_id long, license string, template int, first_word int, last_word int, coverage double")
