"""Licence scans: an exact set-similarity join of text blocks with templates.

A block starts at every word of a text. It has BLOCK words, or twice the words of
the template where these are more, and meets the template if it holds at least
THRESHOLD of the template's distinct words. All words of templates are ordered by
their frequency in the whole corpus, rarest first. If a block holds enough of a
template, it holds one of the template's first words in this order (prefix
filter). The words that such blocks reach over must have enough words of
templates at all (length filter), and enough must be able to follow the first
common one on both sides (positional filter); in what passes, blocks are compared
exactly, by counts that are carried from one start to the next. Blocks at
consecutive starts that meet a template are one match, named by the first of the
best. Phrases, whose words must stand consecutively, give labels of their own.

The templates are a parameter of bounded size (MAX_WORDS words in all), which is
checked before they are broadcast. Every text is searched whole.

Defined cases: a null or empty text has no words, places and labels, empty
strings and score 0; a document with a phrase has score 1; repeated rows and
null doc_ids pass through; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.tokens import ALPHANUMERIC, chunks, split_words

#: Phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Whole texts and headers of public licences, words only.
MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
    "or the use or other dealings in the software"
)
ISC = (
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence "
    "or other tortious action arising out of or in connection with the use or performance of this software"
)
BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
    "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
    "arising in any way out of the use of this software even if advised of the possibility of such damage"
)
APACHE = (
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
    "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
    "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"
)
GPL = (
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license "
    "or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
    "see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses"
)
#: Wordings of licence notices, and whole texts, with their labels.
TEMPLATES = (
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under a creative commons attribution license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("all rights reserved", "reserved"),
    (MIT, "mit"),
    (ISC, "isc"),
    (BSD, "bsd"),
    (APACHE, "apache"),
    (GPL, "gpl"),
)
#: Least words of a block.
BLOCK = 32
THRESHOLD = 0.8
MAX_WORDS = 100_000

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def words(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


def _hashes(tokens: Sequence[str]) -> np.ndarray:
    data = " ".join(tokens).encode()
    return split_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), ALPHANUMERIC).hashes()


class _Vocabulary:
    """The distinct words of templates and phrases; finds them among hashed words."""

    def __init__(self, tokens: Sequence[str]):
        self.tokens = sorted(set(tokens))
        self.hashes = _hashes(self.tokens)
        self.order = np.argsort(self.hashes)
        self.sorted = self.hashes[self.order]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word's token, or -1."""
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], -1)


def _frequencies(rows: DataFrame, vocabulary: _Vocabulary) -> np.ndarray:
    """How often each token of the vocabulary stands in the whole corpus."""
    n = len(vocabulary.tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for b in batches:
            for _, _, data, offsets in chunks(b.column(0)):
                found = vocabulary.numbers(split_words(data, offsets, ALPHANUMERIC, lower=True).hashes())
                total += np.bincount(found[found >= 0], minlength=n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), pa.array(total, pa.int64())], ["token", "n"])

    counted = rows.select("text").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))
    out = np.zeros(n, np.int64)
    for r in counted.collect():
        out[r.token] = r.n
    return out


class Index:
    """Templates with their words in global frequency order, and the inverted lists of their prefixes."""

    def __init__(self, templates, phrases, threshold: float, vocabulary: _Vocabulary, frequency: np.ndarray):
        self.vocabulary = vocabulary
        number = {t: i for i, t in enumerate(vocabulary.tokens)}
        rank = np.empty(len(frequency), np.int64)
        rank[np.lexsort((np.arange(len(frequency)), frequency))] = np.arange(len(frequency))
        self.rank = rank
        self.labels, self.sets, self.needs, self.lengths = [], [], [], []
        self.prefixes: dict[int, list[tuple[int, int]]] = {}
        for text, label in templates:
            own = words(text)
            ordered = sorted({int(rank[number[w]]) for w in own})
            need = max(1, int(np.ceil(threshold * len(ordered) - 1e-9)))
            for i in range(len(ordered) - need + 1):
                self.prefixes.setdefault(ordered[i], []).append((len(self.sets), i))
            self.labels.append(label), self.sets.append(np.array(ordered, np.int64)), self.needs.append(need)
            self.lengths.append(max(BLOCK, 2 * len(own)))
        self.is_prefix = np.zeros(len(frequency) + 1, bool)
        self.is_prefix[list(self.prefixes)] = True
        self.phrases = [([number[w] for w in words(text)], label) for text, label in phrases]

    def reaches(self, ranks: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(template, start, last start, end) of the words over which blocks with one of its prefix words reach."""
        hits: dict[int, list[int]] = {}
        for at in np.flatnonzero(self.is_prefix[ranks] & (ranks >= 0)).tolist():
            for t, _ in self.prefixes[int(ranks[at])]:
                hits.setdefault(t, []).append(at)
        for t, places in hits.items():
            length, first = self.lengths[t], 0
            for k in range(1, len(places) + 1):
                if k == len(places) or places[k] - places[k - 1] > length:
                    yield t, max(0, places[first] - length + 1), places[k - 1], min(places[k - 1] + length, len(ranks))
                    first = k

    def compare(self, t: int, reach: np.ndarray, n_starts: int) -> Iterator[tuple[int, float]]:
        """(start, containment) of each run of blocks that meet the template, for the first n_starts starts."""
        ordered, need, length = self.sets[t], self.needs[t], self.lengths[t]
        own = np.unique(reach[reach >= 0])
        if len(own) < need:
            return
        i = int(np.isin(ordered, own).argmax())
        j = int(np.searchsorted(own, ordered[i]))
        if 1 + min(len(ordered) - i - 1, len(own) - j - 1) < need:
            return
        at = np.flatnonzero(np.isin(reach, ordered))
        # A word counts for the starts after its previous place and up to its own, if they reach it.
        order = np.argsort(reach[at], kind="stable")
        sorted_at, token = at[order], reach[at][order]
        again = np.concatenate([[False], token[1:] == token[:-1]])
        previous = np.where(again, np.concatenate([[0], sorted_at[:-1]]), -1)
        steps = np.zeros(len(reach) + 1, np.int64)
        np.add.at(steps, np.maximum(previous, np.maximum(sorted_at - length, -1)) + 1, 1)
        np.add.at(steps, sorted_at + 1, -1)
        common = np.cumsum(steps)[:n_starts]
        meets = np.concatenate([[False], common >= need, [False]])
        edges = np.flatnonzero(meets[1:] != meets[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            best = a + int(common[a:b].argmax())
            yield best, int(common[best]) / len(ordered)


def _scan_chunk(index: Index, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
    w = split_words(data, offsets, ALPHANUMERIC, lower=True)
    number = index.vocabulary.numbers(w.hashes())
    ranks = np.where(number >= 0, index.rank[number], -1)
    text = np.repeat(np.arange(len(offsets) - 1), w.counts)
    places: dict[int, list[tuple[str, int]]] = {}
    for tokens, label in index.phrases:
        n = len(tokens)
        if len(number) < n:
            continue
        hit = number[: len(number) - n + 1] == tokens[0]
        for j in range(1, n):
            hit &= number[j : len(number) - n + 1 + j] == tokens[j]
        for at in np.flatnonzero(hit):
            if text[at] == text[at + n - 1]:
                places.setdefault(int(text[at]), []).append((label, int(at - w.first[text[at]])))
    matches: dict[int, list[tuple[str, int, int, float]]] = {}
    near = np.flatnonzero(index.is_prefix[ranks] & (ranks >= 0))
    for d in np.unique(text[near]).tolist():
        own = ranks[w.first[d] : w.first[d + 1]]
        for t, start, last, end in index.reaches(own):
            for at, share in index.compare(t, own[start:end], last - start + 1):
                matches.setdefault(d, []).append((index.labels[t], start + at, min(start + at + index.lengths[t], len(own)), share))
    for found in matches.values():
        found.sort(key=lambda m: m[1])
    for d, n in enumerate(w.counts.tolist()):
        yield n, places.get(d, []), matches.get(d, [])


SCANNED = "n_words long, places array<struct<label:string,start:bigint>>, matches array<struct<label:string,start:bigint,end:bigint,containment:double>>"


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, places, matches): phrases with their start words, and blocks that meet a template."""
    tokens = [w for text, _ in (*templates, *phrases) for w in words(text)]
    if len(tokens) > MAX_WORDS:
        raise ValueError(f"templates of {len(tokens)} words; they are broadcast, so at most {MAX_WORDS}")
    vocabulary = _Vocabulary(tokens)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates, phrases, threshold, vocabulary, _frequencies(rows, vocabulary)))
    place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    match = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in chunks(b.column(1)):
                found = list(_scan_chunk(shared.value, data, offsets))
                places = [[dict(zip(("label", "start"), p)) for p in f[1]] for f in found]
                matches = [[dict(zip(("label", "start", "end", "containment"), m)) for m in f[2]] for f in found]
                columns = [b.column(0).slice(first, end - first), pa.array([f[0] for f in found], pa.int64())]
                columns += [pa.array(places, place), pa.array(matches, match)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "places", "matches"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCANNED}")


def digest(scanned: DataFrame) -> DataFrame:
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    own = F.col("places.label")
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("matches.containment"), F.lit(0.0)))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        joined(own).alias("base_labels"),
        joined(F.concat(own, F.col("matches.label"))).alias("labels"),
        score.alias("score"),
    )
