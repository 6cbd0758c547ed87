"""License scan as an exact set-similarity join of text blocks with license templates.

A template is found in a text if some run of words that is a quarter longer than the template, beginning at any word (or the whole text, if it is shorter), holds at least
``THRESHOLD_PERCENT`` of the template's distinct words. Such a run lies within a block of a grid made for the template: blocks of twice the least power of two that the run fits in, one
at every half block. So templates of any length have blocks of their own size, and templates of like size share a grid.

Template words are ordered by the number of corpus texts that hold them, rarest first. A block that contains ceil(threshold * n) of n words must contain one of the
first n - ceil(threshold * n) + 1 (prefix filter); it must have that many template words in all (length filter); and if the rarest one that it holds stands at place p, it can
reach 1 + n - 1 - p (positional filter). In the blocks that pass, a window slides over the template's words and counts exactly, so every run that meets the threshold is found; of each block
the best run is given, the first of equal ones.

Only the templates' own words (a fixed, small set) are counted, broadcast and looked up; counts are summed within each task before the
shuffle. Beside the join stand the plain phrases: places where a phrase's words follow each other.

Edge cases: null text is empty; texts of any length are scanned whole, in pieces of bounded size of which one long text makes one; only the id and text columns are read; repeated rows are scanned one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import bounded_batches, lowered, pieces, text_buffer, word_hashes, word_spans, word_table

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Sentences of well-known licenses and notices, and whole license texts.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "mit-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-full": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice
appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR
BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-full": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain
the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}

THRESHOLD_PERCENT = 80
#: Words of a run, as a share of the template's words.
RUN_PERCENT = 125
#: Words: digits, letters and everything beyond ASCII.
LICENSE_WORDS = word_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def words_of(text: str) -> list[str]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def _hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), LICENSE_WORDS)
    return word_hashes(data, starts, ends)


def _scan(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch's texts, and each text's first word."""
    data, offsets = text_buffer(batch.column(1))
    data = lowered(data)
    starts, ends, firsts = word_spans(data, offsets, LICENSE_WORDS)
    return word_hashes(data, starts, ends), firsts


def template_vocabulary(templates: dict[str, str]) -> list[str]:
    return sorted({w for text in templates.values() for w in words_of(text)})


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many texts each word of the vocabulary occurs; each task sends at most one row per word."""
    hashes = _hashes(vocabulary)
    order = np.argsort(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for part in pieces(batch, batch.schema.names[1]):
                words, firsts = _scan(part)
                at = np.searchsorted(hashes[order], words)
                hit = np.flatnonzero(hashes[order][np.minimum(at, len(order) - 1)] == words)
                rows = np.searchsorted(firsts, hit, "right") - 1
                pairs = np.unique(rows * len(vocabulary) + at[hit])
                counts += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array([vocabulary[i] for i in order]), pa.array(counts)], ["word", "n"])

    found = docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row per template word
    return {r.word: r.n for r in found}


def ordered_templates(templates: dict[str, str], frequency: dict[str, int]) -> dict[str, list[str]]:
    """Each template's distinct words, rarest in the corpus first, equal ones by the word; templates without words are left out."""
    ordered = {name: sorted(set(words_of(text)), key=lambda w: (frequency.get(w, 0), w)) for name, text in templates.items()}
    return {name: words for name, words in ordered.items() if words}


def run_words(template: str) -> int:
    """Words of the runs that are compared with a template."""
    return -(-RUN_PERCENT * len(words_of(template)) // 100)


class Matcher:
    """Templates prepared for scanning word hashes."""

    def __init__(self, templates: dict[str, list[str]], runs: dict[str, int], percent: int):
        self.names = list(templates)
        self.words = [_hashes(words) for words in templates.values()]
        self.need = [max(1, -(-percent * len(w) // 100)) for w in self.words]
        self.runs = [runs[name] for name in templates]
        self.all = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.words]))
        # For each word of any template: its place in each template, or -1.
        self.place = np.full((len(self.words), len(self.all)), -1, np.int64)
        for t, words in enumerate(self.words):
            self.place[t, np.searchsorted(self.all, words)] = np.arange(len(words))
        # Templates by the half length of their blocks, each with the words of which a block must hold one.
        self.grids: dict[int, list[int]] = {}
        for t, run in enumerate(self.runs):
            self.grids.setdefault(1 << max(0, run - 1).bit_length(), []).append(t)
        self.prefix = {half: np.logical_or.reduce([(self.place[t] >= 0) & (self.place[t] <= len(self.words[t]) - self.need[t]) for t in group]) for half, group in self.grids.items()}

    def blocks(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """Template, first word, end and containment of the best matching run of every block of one text."""
        if not len(self.all):
            return
        at = np.minimum(np.searchsorted(self.all, hashes), len(self.all) - 1)
        where = np.flatnonzero(self.all[at] == hashes)
        ids = at[where]
        for half, group in self.grids.items():
            hit = where[self.prefix[half][ids]]
            last = max(0, -(-(len(hashes) - 2 * half) // half))
            found: dict[tuple[int, int], int] = {}  # neighbouring blocks share runs, of which one may see the first part only
            for start in (np.unique(np.clip(np.concatenate([hit // half, hit // half - 1]), 0, last)) * half).tolist():
                low, high = np.searchsorted(where, start), np.searchsorted(where, start + 2 * half)
                inside = np.unique(ids[low:high])
                for t in group:
                    n, need = len(self.words[t]), self.need[t]
                    if len(inside) < need:  # length filter
                        continue
                    places = self.place[t, inside]
                    places = places[places >= 0]
                    if len(places) < need or n - int(places.min()) < need:  # prefix and positional filter
                        continue
                    own = self.place[t, ids[low:high]] >= 0
                    count, first = self.best_run(where[low:high][own], ids[low:high][own], self.runs[t])
                    if count >= need:
                        found[t, first] = max(count, found.get((t, first), 0))
            for (t, first), count in found.items():
                yield t, first, min(first + self.runs[t], len(hashes)), count / len(self.words[t])

    @staticmethod
    def best_run(where: np.ndarray, ids: np.ndarray, run: int) -> tuple[int, int]:
        """The most distinct words in a run, and the first such run's start, which is a word of the template."""
        held: dict[int, int] = {}
        best, low = (0, 0), 0
        places, words = where.tolist(), ids.tolist()
        for place, word in zip(places, words):
            held[word] = held.get(word, 0) + 1
            while places[low] <= place - run:
                held[words[low]] -= 1
                if not held[words[low]]:
                    del held[words[low]]
                low += 1
            if len(held) > best[0]:
                best = (len(held), places[low])
        return best


def matches(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = THRESHOLD_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: word count, phrase places, and ``blocks``: the best runs of the matching blocks with template, word span and containment."""
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ranked = ordered_templates(templates, frequencies(texts, template_vocabulary(templates)))
    matcher = Matcher(ranked, {name: run_words(templates[name]) for name in ranked}, percent)
    phrases = [(label, _hashes(phrase.split(" "))) for phrase, label in PHRASES.items()]
    schema = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())),
                        ("blocks", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words, firsts = _scan(part)
                rows = len(part)
                n_base, least, most = np.zeros(rows, np.int64), np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
                labels: list[set[str]] = [set() for _ in range(rows)]
                for label, phrase in phrases:
                    count = len(words) - len(phrase) + 1
                    if count <= 0:
                        continue
                    hit = np.flatnonzero(np.logical_and.reduce([words[j : j + count] == h for j, h in enumerate(phrase)]))
                    row = np.searchsorted(firsts, hit, "right") - 1
                    whole = hit + len(phrase) <= firsts[row + 1]
                    hit, row = hit[whole], row[whole]
                    n_base += np.bincount(row, minlength=rows)
                    np.minimum.at(least, row, hit - firsts[row])
                    np.maximum.at(most, row, hit - firsts[row])
                    for r in np.unique(row).tolist():
                        labels[r].add(label)
                blocks = [
                    [{"label": matcher.names[t], "start": s, "end": e, "containment": c} for t, s, e, c in matcher.blocks(words[firsts[r] : firsts[r + 1]])]
                    for r in range(rows)
                ]
                columns = [np.diff(firsts), n_base, [x if n else None for x, n in zip(least.tolist(), n_base)], [x if n else None for x, n in zip(most.tolist(), n_base)], [sorted(x) for x in labels], blocks]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, t) for x, t in zip(columns, schema.types)]], ["doc_id", *schema.names])

    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, blocks array<struct<label:string,start:bigint,end:bigint,containment:double>>")


def op6_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and template matches of all documents; the score is 1 for a phrase, else the best containment found."""
    found = matches(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    template_labels = F.transform("blocks", lambda b: b["label"])
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", template_labels)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
        F.size("blocks").cast("long").alias("n_blocks"),
    )
