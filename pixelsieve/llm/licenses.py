"""License scans by diagonal voting.

All rolling hashes of k words of all texts are joined with the positions at which license
templates hold them. A hit votes for the diagonal (position in the text less position in the
template); a copied template is one diagonal, and one with words added or left out is a few
neighbouring ones, which are merged. A merged diagonal becomes a label when the template
positions that it covers are a large enough share of the template and at least a few in number.

Besides, places of the base phrases are counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelsieve.llm.common import ALNUM_OR_HIGH, bounded_batches, list_array, shingle_hashes, tidy, utf8_chunks, words_of

#: Words of a rolling hash, offset by which neighbouring diagonals differ, share of a template, and hashes that a span
#: covers at least (all of a template that has fewer), so that a few common words in a row are no license.
WORDS, NEIGHBOUR, SHARE, LEAST_GRAMS = 4, 4, 0.5, 3

# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Texts of published licenses and of the notices they ask for.
TEMPLATES = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
        NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
        EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
        ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
        ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
        "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
        CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
        BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
        TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
        THE POSSIBILITY OF SUCH DAMAGE.""",
    "apache-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "mpl-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3.",
}


def _words(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words_of(raw, np.array([0, len(raw)]), ALNUM_OR_HIGH)[0]


def template_positions(templates: dict[str, str], k: int) -> list[tuple[int, str, int, int]]:
    """(hash, label, position, k-grams of the template)."""
    out = []
    for label, text in templates.items():
        grams = shingle_hashes(_words(text), k).view(np.int64).tolist()
        out += [(h, label, i, len(grams)) for i, h in enumerate(grams)]
    return out


def _scan(docs: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """doc_id, key, n_words, n_base, first_word, last_word, base_labels."""
    sought = [(_words(phrase), label) for phrase, label in phrases.items()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for _, raw, offsets in utf8_chunks(batch.column(2)):
                words, counts = words_of(raw, offsets, ALNUM_OR_HIGH)
                ends = np.cumsum(counts)
                starts = ends - counts
                places, labels = [], []
                for phrase, label in sought:
                    n = max(0, len(words) - len(phrase) + 1)
                    hit = np.ones(n, bool)
                    for i, h in enumerate(phrase):
                        hit &= words[i : i + n] == h
                    at = np.flatnonzero(hit)
                    row = np.searchsorted(ends, at, "right")
                    at, row = (x[at + len(phrase) <= ends[row]] for x in (at, row))  # within one text
                    places.append(np.stack([row, at - starts[row]]))
                    labels += [label] * len(at)
                found = np.concatenate(places, 1)
                by_row: dict[int, list[tuple[int, str]]] = {}
                for row, at, label in zip(*found.tolist(), labels, strict=True):
                    by_row.setdefault(row, []).append((at, label))
                for i, n in enumerate(counts.tolist()):
                    own = by_row.get(i, [])
                    at = [p for p, _ in own]
                    for column, value in zip(rows, (n, len(own), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in own}))), strict=True):
                        column.append(value)
            made = [pa.array(r, pa.string() if i == 4 else pa.int64()) for i, r in enumerate(rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "key", "n_words", "n_base", "first_word", "last_word", "base_labels"])

    return docs.mapInArrow(tidy(run), "doc_id long, key long, n_words long, n_base long, first_word long, last_word long, base_labels string")


def _grams(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, key, position, hash: all rolling hashes of k words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, offsets in utf8_chunks(batch.column(2)):
                words, counts = words_of(raw, offsets, ALNUM_OR_HIGH)
                grams = [shingle_hashes(w, k).view(np.int64) for w in np.split(words, np.cumsum(counts)[:-1])]
                ids = [batch.column(i).slice(first, len(counts)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, list_array(grams, pa.int64())], names=["doc_id", "key", "grams"])

    return docs.mapInArrow(tidy(run), "doc_id long, key long, grams array<long>").select("doc_id", "key", F.posexplode("grams").alias("position", "hash"))


def votes(docs: DataFrame, templates: dict[str, str], k: int, neighbour: int, share: float, least: int) -> DataFrame:
    """doc_id, key, label, first, last, share: verified spans of templates."""
    spark = docs.sparkSession
    positions = spark.createDataFrame(template_positions(templates, k), "hash long, label string, at int, size int")
    # the templates are a constant of the program, a few hundred rows
    hits = _grams(docs, k).join(F.broadcast(positions), "hash")
    hits = hits.select("doc_id", "key", "label", "size", "position", "at", (F.col("position") - F.col("at")).alias("diagonal"))
    diagonals = hits.groupBy("doc_id", "key", "label", "size", "diagonal").agg(F.collect_set("at").alias("covered"), F.min("position").alias("first"), F.max("position").alias("last"))
    # merge diagonals that lie close to the one before
    per = "PARTITION BY doc_id, key, label ORDER BY diagonal"
    merged = diagonals.withColumn("new", F.expr(f"CASE WHEN diagonal - lag(diagonal) OVER ({per}) <= {neighbour} THEN 0 ELSE 1 END"))
    merged = merged.withColumn("band", F.expr(f"sum(new) OVER ({per})"))
    spans = merged.groupBy("doc_id", "key", "label", "size", "band").agg(F.array_distinct(F.flatten(F.collect_list("covered"))).alias("covered"), F.min("first").alias("first"), (F.max("last") + k - 1).alias("last"))
    spans = spans.withColumn("share", F.size("covered") / F.col("size"))
    spans = spans.where((F.col("share") >= share) & (F.size("covered") >= F.least("size", F.lit(least))))
    return spans.select("doc_id", "key", "label", "first", "last", "share")


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, k: int = WORDS, neighbour: int = NEIGHBOUR, share: float = SHARE, least: int = LEAST_GRAMS) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. labels joins the
    base labels and those of the templates found; spans lists the templates' (label, first word,
    last word, share of the template); score is the largest share, at least 0.5 with a base
    phrase, 0 without any label. Null and empty texts have no words; rows that repeat a document
    get the same result each; an empty table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    found = votes(texts, templates, k, neighbour, share, least)
    found = found.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("label", "first", "last", "share"))).alias("spans"))
    base = _scan(texts, phrases)
    both = base.alias("b").join(found.alias("f"), F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("b.key") == F.col("f.key")), "left")
    labels = F.array_union(F.filter(F.split("base_labels", ","), lambda x: x != ""), F.coalesce(F.transform("spans", lambda s: s["label"]), F.array().cast("array<string>")))
    score = F.greatest(F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    return both.select(
        "b.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"), score.alias("score"), "spans",
    )
