"""Benchmark decontamination with a generalised suffix automaton over test items.

The automaton holds every run of words of every item. A document streams through it word by word; the current state is
the longest suffix of the text read so far that some item contains, so a window of `window` item words ends at a word
exactly when the matched length reaches `window`. Items shorter than a window count as one window.

Defined cases: a null or empty text has no words and no hits; an item without words is ignored; items of equal text all
report; repeated document rows are each judged; further columns are carried or ignored; without items nothing is hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featloom.core import col, quoted
from featloom.llm.base import encoded, picked, query, stored, table

#: Words of the contract: ASCII letters and digits, and everything beyond ASCII.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
SPOKEN = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")

WINDOW = 13
#: Item words held by one automaton; a larger benchmark is dealt to several, one pass each.
SHARD_WORDS = 1_000_000

FOUND = "__n_words long, __spans array<struct<first:int,last:int,start:int,stop:int>>, __items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return WORDS.findall(encoded(text).lower())


class Automaton:
    """All runs of words of many items; states are suffix classes, shared between items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.longest: list[int] = [0]
        coded = []
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            if ids:
                coded.append((name, ids))
                last = 0
                for w in ids:
                    last = self._grow(last, w)
        self._mark(coded)

    def _state(self, like: int | None, longest: int) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(0 if like is None else self.link[like])
        self.longest.append(longest)
        return len(self.next) - 1

    def _split(self, source: int, w: int, target: int) -> int:
        """The class of the text at `source` plus `w`, cut off from a longer class if need be."""
        if self.longest[target] == self.longest[source] + 1:
            return target
        short = self._state(target, self.longest[source] + 1)
        self.link[target] = short
        while source >= 0 and self.next[source].get(w) == target:
            self.next[source][w] = short
            source = self.link[source]
        return short

    def _grow(self, last: int, w: int) -> int:
        known = self.next[last].get(w)
        if known is not None:
            return self._split(last, w, known)
        fresh = self._state(None, self.longest[last] + 1)
        while last >= 0 and w not in self.next[last]:
            self.next[last][w] = fresh
            last = self.link[last]
        if last >= 0:
            self.link[fresh] = self._split(last, w, self.next[last][w])
        return fresh

    def _mark(self, coded: list[tuple[str, list[int]]]) -> None:
        """Per state: the class of its last `window` words, the items holding it, and short items that end there."""
        window, order = self.window, sorted(range(len(self.next)), key=self.longest.__getitem__)
        self.anchor = [-1] * len(order)
        for s in order:
            if self.longest[s] >= window:
                up = self.link[s]
                self.anchor[s] = s if self.longest[up] < window else self.anchor[up]
        self.holders: dict[int, set[str]] = {}
        whole: dict[int, list[tuple[int, str]]] = {}
        for name, ids in coded:
            state = 0
            for i, w in enumerate(ids):
                state = self.next[state][w]
                if i + 1 >= window:
                    self.holders.setdefault(self.anchor[state], set()).add(name)
            if len(ids) < window:
                whole.setdefault(state, []).append((len(ids), name))
        self.short: list[tuple[tuple[int, str], ...]] = [()] * len(order)
        for s in order[1:]:
            self.short[s] = self.short[self.link[s]] + tuple(whole.get(s, ()))
        self.least = min([window, *(n for found in whole.values() for n, _ in found)])

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged word ranges that lie in windows, and the items they belong to."""
        step, link, longest, window, least = self.next, self.link, self.longest, self.window, self.least
        ranges: list[list[int]] = []
        found: set[str] = set()
        state = length = 0
        for i, w in enumerate(map(self.vocabulary.get, words)):
            if w is None:
                state = length = 0
                continue
            to = step[state].get(w)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = step[state].get(w)
                length = longest[state]
                if to is None:
                    length = 0
                    continue
            state, length = to, length + 1
            if length < least:
                continue
            reach = 0
            if length >= window:
                reach = window
                found |= self.holders[self.anchor[state]]
            for n, name in self.short[state]:
                if n <= length:
                    reach = max(reach, n)
                    found.add(name)
            if reach:
                first = i - reach + 1
                while ranges and first <= ranges[-1][0]:
                    ranges.pop()
                if ranges and first <= ranges[-1][1] + 1:
                    ranges[-1][1] = i
                else:
                    ranges.append([first, i])
        return ranges, found


def _searched(docs: DataFrame, text: str, automata, merge: bool) -> DataFrame:
    kept = [i for i, f in enumerate(docs.schema.fields) if f.name not in ("__n_words", "__spans", "__items")]
    at, names = docs.columns.index(text), [docs.columns[i] for i in kept]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(*automata.value)
        for batch in batches:
            counts, spans, items = [], [], []
            for i, body in enumerate(batch.column(at).to_pylist()):
                words = words_of(body)
                ranges, found = automaton.scan(words)
                if merge:
                    ranges = _joined(ranges + [[s["first"], s["last"]] for s in batch.column("__spans")[i].as_py()])
                    found |= set(batch.column("__items")[i].as_py())
                places = [m.span() for m in SPOKEN.finditer(body)] if ranges else []
                counts.append(len(words))
                spans.append([{"first": a, "last": b, "start": places[a][0], "stop": places[b][1]} for a, b in ranges])
                items.append(sorted(found))
            span = pa.list_(pa.struct([(n, pa.int32()) for n in ("first", "last", "start", "stop")]))
            found = [pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + found, [*names, "__n_words", "__spans", "__items"])

    schema = T.StructType([docs.schema.fields[i] for i in kept] + T._parse_datatype_string(FOUND).fields)
    return docs.mapInArrow(search, schema)


def _joined(ranges: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def matched_spans(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The columns of `docs` plus __n_words, __spans (matched word and character ranges) and __items.

    One automaton of at most about `shard_words` item words is broadcast at a time. A benchmark beyond that is dealt to
    several automata by a hash of the item; the documents then pass each in turn and their spans are merged.
    """
    named = items.select(col(item).cast("string").alias("name"), col(item_text).alias("words"))
    size = named.agg(F.sum(F.length("words"))).first()[0] or 0
    shards = max(1, -(-size // (6 * shard_words)))
    out = docs
    for k in range(shards):
        part = named.where(F.pmod(F.xxhash64("name", "words"), F.lit(shards)) == k) if shards > 1 else named
        rows = [(r["name"] or "", words_of(r["words"])) for r in part.toLocalIterator()]
        sent = docs.sparkSession.sparkContext.broadcast((rows, window))
        if k:
            out = stored(out, "spans")
        out = _searched(out, text, sent, merge=k > 0)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                   window: int = WINDOW, coverage: float = 0.05, least_words: int = WINDOW) -> DataFrame:
    """Documents without those covered to `coverage` or more; in the others spans of `least_words` or more are cut out."""
    own, body = [quoted(c) for c in docs.columns], col(text)
    found = matched_spans(docs, items, text, item, item_text, window)
    hit = F.aggregate("__spans", F.lit(0), lambda n, s: n + s["last"] - s["first"] + 1)
    kept = found.where((hit == 0) | (hit < F.col("__n_words") * coverage))
    long = F.filter("__spans", lambda s: s["last"] - s["first"] + 1 >= least_words)
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    cut = F.aggregate(
        long, start,
        lambda acc, s: F.struct(F.concat(acc["text"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"])).alias("text"), s["stop"].alias("at")),
        lambda acc: F.concat(acc["text"], F.substring(body, acc["at"] + 1, F.length(body))),
    )
    cleaned = F.when(F.size(long) > 0, cut).otherwise(body)
    return kept.withColumn(text, cleaned).select(*own)


WORD_SQL = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL = f"""
WITH item_words AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORD_SQL} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
    SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(list_slice(w, i, i + least(len(w), {WINDOW}) - 1), ' ') AS win
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS (SELECT doc_id, coalesce({WORD_SQL}, []) AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
    SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, p.n, item FROM places p JOIN windows v ON p.win = v.win AND p.n = v.n),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM doc_words d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query("op4_decontaminate", SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = picked(table(spark, folder, "documents"), "doc_id", "text")
    found = matched_spans(docs, table(spark, folder, "benchmark"))
    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select("doc_id", F.col("__n_words").alias("n_words"), hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256")) \
        .select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
