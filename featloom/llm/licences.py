"""License scans with a positional index of rare words.

Texts are compared with `PASSAGES`, short pieces of known licences and of the notices that name them. A passage of m words
stands at an alignment o of a file if at least `percent` of its words equal the file's word at the same relative
position, and all its key phrases stand whole within `slack` words of the aligned stretch.

1. The document frequency of every licence word is counted over all documents: the rarer, the higher its IDF.
2. Each passage enters the index with the positions of its highest-IDF words only. Of its m words the rarest
   m - need + both are enough: whatever agrees in `need` words agrees in at least `both` of them at one alignment.
3. A file looks up the indexed words it holds; postings meet by relative position (file position less passage position),
   and an alignment with at least `both` votes is compared word by word.
4. Key phrases are verified in the stretch around.

Nothing is lost against comparing every alignment. `BASE` phrases are labelled wherever they stand whole.

Defined cases: null and empty texts have no words and no labels; repeated rows are handled each by itself; an empty
table gives an empty result; a stretch may reach over either end of a file, where its words count as different; of the
further columns only the key is kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.core import col
from featloom.llm.base import UPPER, encoded, query, table


class Passage(NamedTuple):
    label: str
    text: str
    keys: tuple[str, ...]


# Phrases and labels of the contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Wording of public licences and of the usual notices, with the phrases that none of them lacks.
PASSAGES = [
    Passage("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    Passage("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache org licenses",)),
    Passage("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms")),
    Passage("bsd", "Released under the BSD License", ("bsd license",)),
    Passage("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote", "prior written permission")),
    Passage("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software license",)),
    Passage("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Passage("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Passage("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("attribution noncommercial 4 0",)),
    Passage("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Passage("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("attribution sharealike 4 0",)),
    Passage("cc0-1.0", "has waived all copyright and related or neighboring rights to this work under the CC0 1.0 Universal Public Domain Dedication", ("cc0", "waived all copyright")),
    Passage("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license",)),
    Passage("gpl-2.0", "either version 2 of the License, or (at your option) any later version", ("version 2 of the license",)),
    Passage("gpl-3.0", "licensed under the GNU General Public License, version 3", ("general public license version 3",)),
    Passage("gpl-3.0", "either version 3 of the License, or (at your option) any later version", ("version 3 of the license",)),
    Passage("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee", "hereby granted")),
    Passage("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("lesser general public license",)),
    Passage("mit", "Released under the MIT License", ("mit license",)),
    Passage("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge", "associated documentation files")),
    Passage("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Passage("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    Passage("zlib", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software", ("plainly marked as such",)),
]
PERCENT, SLACK = 60, 3
#: Indexed positions that have to agree at one alignment.
BOTH = 2
#: Words that share a pass, and bytes of a text taken at once.
PASS_WORDS, SLICE = 400_000, 1 << 22
_LETTERS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return encoded(text).lower().translate(_LETTERS).split()


def _slices(body: bytes) -> Iterator[list[bytes]]:
    body = body.lower().translate(_LETTERS)
    at = 0
    while at < len(body):
        end = body.find(b" ", at + SLICE)
        stop = end if end >= 0 else len(body)
        yield body[at:stop].split()
        at = stop


class Index:
    """Numbered licence words, passages, key phrases and the postings of the rarest positions."""

    def __init__(self, passages: Sequence[Passage], base: Mapping[str, str], percent: int, slack: int, found_in: Mapping[str, int]):
        self.numbers: dict[bytes, int] = {}
        self.passages = [(p.label, self.ids(p.text), [self.ids(k) for k in p.keys]) for p in passages]
        self.base = [(label, self.ids(phrase)) for phrase, label in base.items()]
        self.slack, self.gap = slack, max([len(ids) for _, ids, _ in self.passages], default=1) + 2 * slack
        self.need = np.array([-(-percent * len(ids) // 100) for _, ids, _ in self.passages], np.int64)
        self.votes = np.minimum(self.need, BOTH)
        rarity = np.array([0] + [found_in.get(w.decode(), 0) for w in self.numbers], np.int64)
        rows = []
        for k, (_, ids, _) in enumerate(self.passages):
            rarest = np.lexsort((np.arange(len(ids)), ids, rarity[ids]))[: len(ids) - self.need[k] + self.votes[k]]
            rows += [(ids[j], k, j) for j in rarest]
        word, self.passage, self.place = (np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)) if rows else (np.empty(0, np.int64),) * 3
        self.first = np.searchsorted(word, np.arange(len(self.numbers) + 2))

    def ids(self, text: str) -> np.ndarray:
        return np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)], np.int64)

    def places(self, words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
        """Starts of a phrase whose words stand consecutively."""
        at = np.flatnonzero(words[: len(words) - len(phrase) + 1] == phrase[0])
        for j in range(1, len(phrase)):
            at = at[words[at + j] == phrase[j]]
        return at

    def alignments(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(passage, alignments, words that agree), for words with a gap before, between and behind the files."""
        at = np.flatnonzero(words)
        counts = self.first[words[at] + 1] - self.first[words[at]]
        ends = np.cumsum(counts)
        posting = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(self.first[words[at]], counts)
        keys = self.passage[posting] * len(words) + np.repeat(at, counts) - self.place[posting]
        keys, votes = np.unique(keys, return_counts=True)
        which, start = np.divmod(keys, max(len(words), 1))
        held = votes >= self.votes[which] if len(which) else np.empty(0, bool)
        which, start = which[held], start[held]
        for k in np.unique(which).tolist():
            ids, own = self.passages[k][1], start[which == k]
            agree = np.zeros(len(own), np.int64)
            for j, word in enumerate(ids):
                agree += words[own + j] == word
            enough = agree >= self.need[k]
            if enough.any():
                yield k, own[enough], agree[enough]

    def verified(self, words: np.ndarray, k: int, start: int) -> bool:
        low = max(start - self.slack, 0)
        around = words[low : start + len(self.passages[k][1]) + self.slack]
        return all(len(self.places(around, key)) for key in self.passages[k][2])


def licence_words(passages: Sequence[Passage] = PASSAGES) -> list[str]:
    return sorted({w.decode() for p in passages for w in words_of(p.text)})


def document_frequencies(docs: DataFrame, words: Sequence[str], text: str = "text") -> DataFrame:
    """word, n: documents that hold it, over all documents; a task sends one row per word."""
    wanted = frozenset(w.encode() for w in words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = dict.fromkeys(wanted, 0)
        for batch in batches:
            for body in batch.column(0).to_pylist():
                own: set[bytes] = set()
                for part in _slices(encoded(body)):
                    own |= wanted.intersection(part)
                for w in own:
                    found[w] += 1
        yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in found], "n": list(found.values())})

    return docs.select(col(text).alias("text")).where(F.length("text") > 0).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def licence_matches(
    docs: DataFrame, key: str = "doc_id", text: str = "text", passages: Sequence[Passage] = PASSAGES, base: Mapping[str, str] = BASE,
    percent: int = PERCENT, slack: int = SLACK,
) -> DataFrame:
    """Per row of `docs`: key, n_words, base (label and start of every phrase place) and found (label, alignment, share of agreeing words)."""
    # At most one row per licence word comes back.
    found_in = {r["word"]: r["n"] for r in document_frequencies(docs, licence_words(passages), text).collect()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(passages, base, percent, slack, found_in)
        number, gap = index.numbers.get, np.zeros(index.gap, np.int64)

        def flush(keys: list, texts: list[np.ndarray]) -> pa.RecordBatch:
            sizes = np.array([len(t) for t in texts], np.int64)
            starts = index.gap + np.cumsum(sizes + index.gap) - sizes - index.gap
            words = np.concatenate([gap, *(x for t in texts for x in (t, gap))])
            base_rows: list[list[dict]] = [[] for _ in texts]
            rows: list[list[dict]] = [[] for _ in texts]
            for label, phrase in index.base:
                at = index.places(words, phrase)
                for d, i in zip(np.searchsorted(starts, at, "right") - 1, at.tolist(), strict=True):
                    base_rows[d].append({"label": label, "start": i - int(starts[d])})
            for k, own, agree in index.alignments(words):
                label, ids, _ = index.passages[k]
                for start, n in zip(own.tolist(), agree.tolist(), strict=True):
                    if index.verified(words, k, start):
                        # The gap is longer than any passage, so only one file can lie below it.
                        d = int(np.searchsorted(starts, start + len(ids) - 1, "right")) - 1
                        rows[d].append({"label": label, "start": start - int(starts[d]), "share": n / len(ids)})
            for own in base_rows + rows:
                own.sort(key=lambda r: (r["start"], r["label"]))
            return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(sizes), pa.array(base_rows, kind_base), pa.array(rows, kind_found)], ["key", "n_words", "base", "found"])

        keys, texts, size = [], [], 0
        for batch in batches:
            for row, body in enumerate(batch.column(1).to_pylist()):
                parts = [np.fromiter(map(number, part, repeat(0)), np.int64, len(part)) for part in _slices(encoded(body))]
                texts.append(np.concatenate(parts) if parts else np.empty(0, np.int64))
                keys.append(batch.column(0).slice(row, 1))
                size += len(texts[-1])
                if size >= PASS_WORDS:
                    yield flush(keys, texts)
                    keys, texts, size = [], [], 0
        if texts:
            yield flush(keys, texts)

    kind_base = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    kind_found = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("share", pa.float64())]))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_words long, base array<struct<label:string,start:long>>, found array<struct<label:string,start:long,share:double>>"
    return docs.select(col(key).alias("key"), col(text).alias("text")).mapInArrow(scan, schema)


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def labelled(matches: DataFrame) -> DataFrame:
    """Counts, first and last base place, labels and score; the score is the best share of agreeing words, 1 for a base phrase."""
    starts, own, more = F.col("base.start"), F.col("base.label"), F.col("found.label")
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("found.share"), F.lit(0.0)))
    return matches.select(
        "key", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        _joined(own).alias("base_labels"), _joined(F.concat(own, more)).alias("labels"), score.alias("score"))


def _values(rows: Sequence[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(c) if isinstance(c, int) else f"'{c}'" for c in r) + ")" for r in rows)


def _sql() -> str:
    passages = [(k, p.label, len(words_of(p.text)), -(-PERCENT * len(words_of(p.text)) // 100)) for k, p in enumerate(PASSAGES)]
    words = [(k, j, w.decode()) for k, p in enumerate(PASSAGES) for j, w in enumerate(words_of(p.text))]
    keys = sorted({k for p in PASSAGES for k in p.keys} | set(BASE))
    parts = [(i, j, w.decode()) for i, k in enumerate(keys) for j, w in enumerate(words_of(k))]
    sizes = [(i, len(words_of(k))) for i, k in enumerate(keys)]
    wanted = [(k, keys.index(key)) for k, p in enumerate(PASSAGES) for key in p.keys]
    base = [(keys.index(phrase), label) for phrase, label in BASE.items()]
    return f"""
WITH passages(p, label, m, need) AS (VALUES {_values(passages)}),
passage_words(p, j, word) AS (VALUES {_values(words)}),
phrases(f, size) AS (VALUES {_values(sizes)}),
phrase_words(f, j, word) AS (VALUES {_values(parts)}),
wanted(p, f) AS (VALUES {_values(wanted)}),
base(f, label) AS (VALUES {_values(base)}),
split AS (
    SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM documents),
tokens AS (SELECT d, unnest(w) AS word, unnest(range(len(w))) AS i FROM split),
phrase_places AS (
    SELECT d, f, i - j AS s, any_value(size) AS size FROM tokens JOIN phrase_words USING (word) JOIN phrases USING (f)
    GROUP BY d, f, i - j HAVING count(*) = any_value(size)),
aligned AS (
    SELECT d, p, i - j AS o, count(*) AS agree, any_value(m) AS m, any_value(label) AS label FROM tokens JOIN passage_words USING (word) JOIN passages USING (p)
    GROUP BY d, p, i - j HAVING count(*) >= any_value(need)),
met AS (
    SELECT DISTINCT a.d, a.p, a.o, w.f FROM aligned a JOIN wanted w USING (p)
    JOIN phrase_places s ON s.d = a.d AND s.f = w.f AND s.s >= a.o - {SLACK} AND s.s + s.size <= a.o + a.m + {SLACK}),
found AS (
    SELECT a.d, a.label, a.agree / a.m AS share FROM aligned a
    WHERE (SELECT count(*) FROM met WHERE met.d = a.d AND met.p = a.p AND met.o = a.o) = (SELECT count(*) FROM wanted WHERE wanted.p = a.p)),
places AS (SELECT d, label, s FROM phrase_places JOIN base USING (f)),
own AS (SELECT d, count(*) AS n, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY d),
every AS (
    SELECT d, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
    FROM (SELECT d, label, CAST(1 AS DOUBLE) AS share FROM places UNION ALL SELECT d, label, CAST(share AS DOUBLE) FROM found) GROUP BY d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(own.n, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
    CAST(last_word AS BIGINT) AS last_word, coalesce(own.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, coalesce(every.score, 0.0)::DOUBLE AS score
FROM split LEFT JOIN own USING (d) LEFT JOIN every USING (d)
"""


@query("op13_licence_scan", _sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return labelled(licence_matches(table(spark, folder, "documents"))).withColumnRenamed("key", "doc_id")
