"""Phrase collocations from sorted count streams.

A phrase of up to `max_words` words is counted with its language in front, so that `(en)` is the number of words of the
language, `(en, a)` a word and `(en, a, b)` a pair. Steps:

1. length by length, each task sorts its n-grams as packed integers, counts the runs, and sends one row per distinct
   phrase; the counts are summed, and those below `least` go: neither a candidate nor any part of one can be among them.
   For the next length only places are counted whose two parts may be frequent, as told by a bit map of fixed size; a
   phrase whose parts share bits with others is counted in vain and changes no result;
2. prefix order: the count table is dealt to ranges and sorted. A phrase follows its prefixes and precedes its
   extensions, so one pass in lockstep meets the counts of all first parts and the best right extension;
3. suffix order: the same over reversed phrases gives the counts of all rests and the best left extension.

A pass keeps one row per phrase length and looks nothing up. What crosses the edge of a range, a few numbers per range,
is passed on from range to range afterwards; a first word that fills many ranges needs nothing else.

Only extensions by one word are compared: a longer phrase is at most as frequent as the extension inside it.

Defined cases: null and empty texts have no words; a null language is `und`; repeated rows count as often as they stand;
an empty table has no phrases; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featloom.core import col
from featloom.llm.base import UPPER, WordHashes, encoded, mixed, query, stored, table

MAX_WORDS, LEAST, SHARE, TOP = 3, 10, 50, 2_000
#: Words that a task counts at once, distinct ones among them, bytes of a text taken at once, rows of a batch sent.
BUFFER, DISTINCT, SLICE, ROWS = 2_000_000, 500_000, 1 << 22, 1 << 16
#: Bits of the map of frequent phrases, as a power of two: 8 MB.
FILTER_BITS = 26
#: Ends of pieces; blanks between words.
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(PIECE_ENDS.encode() + b"\t", b"." * len(PIECE_ENDS) + b" ")
_END = re.compile(rb"\.")


class Vocabulary(dict):
    """Word numbers from 1 in order of appearance; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def numbered(body: bytes, words: Vocabulary) -> Iterator[np.ndarray]:
    """Word numbers of a text in slices that end with a piece."""
    body = body.lower().translate(_TABLE)
    at = 0
    while at < len(body):
        end = _END.search(body, at + SLICE)
        stop = end.end() if end else len(body)
        part = body[at:stop].replace(b".", b" . ").split()
        yield np.fromiter(map(words.__getitem__, part), np.int64, len(part))
        at = stop


def _hashed(lang: str, columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of phrases given as one array of word hashes per position."""
    acc = np.full(len(columns[0]), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
    for own in columns:
        acc = mixed(acc * np.uint64(0x9E3779B97F4A7C15) + own)
    return acc >> np.uint64(64 - FILTER_BITS)


def _held(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> np.uint64(6)] >> (places & np.uint64(63)) & np.uint64(1)).astype(bool)


def possible(lang: str, ids: np.ndarray, hashes: np.ndarray, size: int, bits: np.ndarray | None) -> np.ndarray:
    """Starts of the phrases of `size` words, of which both parts of one word less may be frequent."""
    inside = ids > 0
    if bits is not None:
        own = hashes[ids]
        parts = len(ids) - size + 2
        inside = _held(bits, _hashed(lang, [own[j : j + parts] for j in range(size - 1)])) if parts > 1 else np.zeros(0, bool)
        for j in range(size - 1):
            inside &= ids[j : j + parts] > 0
        inside = inside[:-1] & inside[1:]
    return np.flatnonzero(inside)


def counted(ids: np.ndarray, starts: np.ndarray, names: pa.Array, size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(phrases, counts) in batches: the n-grams at `starts`, packed pairwise into integers and sorted."""
    keys, which, counts = np.unique(ids[starts], return_inverse=True, return_counts=True)
    parents = [(np.zeros(len(keys), np.int64), keys)]
    for j in range(1, size):
        keys, which, counts = np.unique(which << 32 | ids[starts + j], return_inverse=True, return_counts=True)
        parents.append((keys >> 32, keys & 0xFFFFFFFF))
    for i in range(0, len(keys), ROWS):
        row = np.arange(i, min(i + ROWS, len(keys)))
        words = []
        for up, own in reversed(parents):
            words.append(names.take(pa.array(own[row])))
            row = up[row]
        phrases = pc.binary_join_element_wise(*reversed(words), pa.scalar(b" ", pa.binary())) if size > 1 else words[0]
        yield phrases.cast(pa.string()), counts[i : i + ROWS]


def phrase_counts(docs: DataFrame, size: int, bits: np.ndarray | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase (joined by blanks) and n, its occurrences over all documents, for phrases of `size` words.

    Size 1 has a row with an empty phrase as well, which counts all words. `bits` leaves out what cannot be frequent.
    """
    shared = None if bits is None else docs.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, total = Vocabulary(), {}, 0
        filtered = None if shared is None else shared.value

        def flush() -> Iterator[pa.RecordBatch]:
            names = pa.array(list(words), pa.binary())
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) if filtered is not None else np.empty(0, np.uint64)
            for name in list(held):
                ids = np.concatenate(held.pop(name))
                starts = possible(name, ids, hashes, size, filtered)
                rows = [(pa.array([""]), np.array([len(starts)]))] if size == 1 else []
                for phrases, counts in chain(rows, counted(ids, starts, names, size)):
                    langs = pa.array([name], pa.string()).take(pa.array(np.zeros(len(counts), np.int64)))
                    yield pa.RecordBatch.from_arrays([langs, phrases, pa.array(counts, pa.int64())], ["lang", "phrase", "n"])

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for ids in numbered(encoded(body), words):
                    held.setdefault(name, []).extend((ids, np.zeros(1, np.int64)))
                    total += len(ids)
                    if total >= BUFFER or len(words) >= DISTINCT:
                        yield from flush()
                        words, held, total = Vocabulary(), {}, 0
        yield from flush()

    source = docs.select(F.coalesce(col(lang).cast("string"), F.lit("und")).alias("lang"), col(text).alias("text")).where(F.length("text") > 0)
    return source.mapInArrow(count, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _filter(level: DataFrame) -> np.ndarray:
    """Bits of the phrases of a level; other phrases may share a bit, which costs rows and no result."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = [(name, phrase.encode().split(b" ")) for name, phrase in zip(*(c.to_pylist() for c in batch.columns), strict=True) if phrase]
            by: dict[str, list] = {}
            for name, own in rows:
                by.setdefault(name, []).append(own)
            for name, phrases in by.items():
                at = _hashed(name, [hashes.array(list(own)) for own in zip(*phrases, strict=True)])
                bits = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bits)], ["cell", "bits"])

    cells = level.select("lang", "phrase").mapInArrow(place, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    # At most 2 ** (FILTER_BITS - 6) rows, whatever the corpus.
    found = cells.toArrow()
    bits = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    bits[found["cell"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, least: int = LEAST) -> DataFrame:
    """lang, phrase, n of all phrases that occur `least` times, and the number of words of each language."""
    levels, bits = [], None
    for size in range(1, max_words + 1):
        levels.append(stored(phrase_counts(docs, size, bits, text, lang).where(F.col("n") >= least), "level"))
        bits = _filter(levels[-1]) if size < max_words else None
    return reduce(DataFrame.union, levels)


def _pass(rows: DataFrame, depth: int) -> DataFrame:
    """One pass over sorted rows (key, n, body): adds `parts` and `best`, and rows that describe the edges of each range.

    `parts` are the counts of the beginnings of a key, shortest first; `best` is the largest count of an extension by one
    word. What lies in an earlier range is null in `parts`. `open` is the length of keys whose extensions may go on in the next range.
    Edge rows have a null key: for each length `open`, n is the last count seen and `best` the best extension before the first key of that length.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts = None, [None] * (depth + 2)
        waiting: list[list | None] = [None] * (depth + 2)
        heads = [0] * (depth + 2)
        out: list[list] = []

        def batch() -> pa.RecordBatch:
            done = pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
            out.clear()
            return done

        for rows in batches:
            columns = [rows.column(i).to_pylist() for i in range(4)]
            for part, key, n, body in zip(*columns, strict=True):
                size = len(key)
                for longer in range(size, depth + 2):
                    if waiting[longer] is not None:
                        out.append(waiting[longer])
                        waiting[longer] = None
                if size > 1:
                    if counts[size - 1] is None:
                        heads[size - 1] = max(heads[size - 1], n)
                    else:
                        above = waiting[size - 1]
                        above[5] = max(above[5], n)
                waiting[size] = [part, key, n, body, counts[1:size], 0, None]
                counts[size] = n
            if out:
                yield batch()
        for size in range(1, depth + 2):
            if waiting[size] is not None:
                out.append([*waiting[size][:6], size])
            if part is not None:
                out.append([part, None, counts[size], None, None, heads[size], size])
        if out:
            yield batch()

    schema = pa.schema([("part", pa.int32()), ("key", pa.list_(pa.string())), ("n", pa.int64()), ("body", pa.list_(pa.int64())), ("parts", pa.list_(pa.int64())), ("best", pa.int64()), ("open", pa.int32())])
    dealt = rows.repartitionByRange("key").sortWithinPartitions("key").select(F.spark_partition_id().alias("part"), "key", "n", "body")
    return dealt.mapInArrow(walk, "part int, key array<string>, n long, body array<long>, parts array<long>, best long, open int")


def in_lockstep(rows: DataFrame, depth: int, name: str) -> DataFrame:
    """key, n, body, parts and best of rows (key, n, body) whose beginnings are all among the keys."""
    passed = stored(_pass(rows, depth), name)
    # One row per range and length: the ranges are those of one shuffle, however many rows they hold.
    edges = sorted((r["part"], r["open"], r["n"], r["best"]) for r in passed.where("key IS NULL").select("part", "open", "n", "best").collect())
    parts = sorted({e[0] for e in edges})
    seen, heads = {(p, s): n for p, s, n, _ in edges}, {(p, s): b for p, s, _, b in edges}
    sizes = range(1, depth + 2)
    carried: dict[int, list[int]] = {}
    last = dict.fromkeys(sizes, 0)
    for p in parts:
        carried[p] = [last[s] for s in sizes]
        last.update({s: seen[p, s] for s in sizes if seen[p, s] is not None})
    later: dict[int, list[int]] = {}
    best = dict.fromkeys(sizes, 0)
    for p in reversed(parts):
        later[p] = [best[s] for s in sizes]
        best = {s: max(heads[p, s], best[s] if seen[p, s] is None else 0) for s in sizes}
    spark = rows.sparkSession
    known = spark.createDataFrame([(p, carried[p], later[p]) for p in parts], "part int, carried array<long>, later array<long>")
    joined = passed.where("key IS NOT NULL").join(F.broadcast(known), "part")
    before = F.transform("parts", lambda n, i: F.coalesce(n, F.get("carried", i)))
    after = F.greatest("best", F.when(F.col("open").isNotNull(), F.get("later", F.col("open") - 1)))
    return joined.select("key", "n", "body", before.alias("parts"), after.alias("best"))


def _scored(a: Column, left: Column, right: Column, size: Column) -> Column:
    """The lowest-scoring cut as (score, cut, l, r); whole-number division of decimals is exact."""
    a = a.cast("decimal(18,0)")

    def cut(k: Column) -> Column:
        l, r = F.get(left, k), F.get(right, size - k)
        score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (a * a), l.cast("decimal(18,0)") * r.cast("decimal(18,0)"))
        return F.struct(score.cast("long").alias("score"), k.cast("int").alias("cut"), l.alias("l"), r.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), size - 1), cut))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every candidate that no longer one makes redundant."""
    counts = frequent_phrases(docs, text, lang, max_words, least)
    key = F.concat(F.array("lang"), F.when(F.col("phrase") == "", F.array().cast("array<string>")).otherwise(F.split("phrase", " ")))
    counts = stored(counts.select(key.alias("key"), "n"), "counts")
    none = F.lit(None).cast("array<long>")
    ahead = in_lockstep(counts.select("key", "n", none.alias("body")), max_words, "prefixes")
    turned = F.concat(F.slice("key", 1, 1), F.reverse(F.slice("key", F.lit(2), F.size("key") - 1)))
    body = F.concat(F.array("best"), F.col("parts"))
    behind = in_lockstep(ahead.select(turned.alias("key"), "n", body.alias("body")), max_words, "suffixes")
    size = F.size("key") - 1
    left = F.slice("body", F.lit(2), F.size("body") - 1)
    found = behind.where(size >= 2).where(100 * F.greatest(F.get("body", F.lit(0)), "best") < share * F.col("n")).withColumnRenamed("n", "a")
    found = found.select(F.get("key", F.lit(0)).alias("lang"), F.concat_ws(" ", F.reverse(F.slice("key", F.lit(2), size))).alias("phrase"),
                         "a", F.get("body", F.lit(1)).alias("n"), _scored(F.col("a"), left, F.col("parts"), size).alias("cut"))
    return found.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def top_phrases(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` of each language; each task ranks its own rows first, so a hot language sends `top` rows a task."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


SQL = f"""
WITH pieces AS (
    SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang,
            unnest(regexp_split_to_array(translate(text, '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
          FROM documents WHERE length(text) > 0)),
sizes AS (SELECT unnest(range(1, {MAX_WORDS + 1})) AS k),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM pieces, sizes WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS c FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(c) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND c >= {LEAST}),
inside AS (SELECT lang, k, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS part, a FROM candidates WHERE k > 2),
dropped AS (
    SELECT DISTINCT c.lang, c.phrase FROM candidates c JOIN inside i ON i.lang = c.lang AND i.part = c.phrase WHERE 100 * i.a >= {SHARE} * c.a),
cuts AS (SELECT lang, phrase, a, w, unnest(range(1, k)) AS j FROM candidates ANTI JOIN dropped USING (lang, phrase)),
scored AS (
    SELECT c.lang, c.phrase, c.a, j, x.c AS l, y.c AS r, CAST(1000000::HUGEINT * c.a * c.a // (x.c::HUGEINT * y.c) AS BIGINT) AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.j], ' ')
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.j + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a,
    CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM lowest JOIN total USING (lang) QUALIFY rank <= {TOP}
"""


@query("op11_collocations", SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    found = top_phrases(collocations(table(spark, folder, "documents")))
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
