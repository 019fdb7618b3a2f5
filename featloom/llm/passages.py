"""Substring dedup by hashing the units of lines and paragraphs.

A unit is a sentence of at least `least_words` words together with the shorter ones that follow it in its line; a line
that starts with short sentences starts with a unit of their own. Lines of fewer words (verse, lists, tables) are joined to
blocks: a block ends before a line whose digest begins with two zero bits, so blocks are the same wherever the lines are. Units are normalised (A-Z lower-cased, white space
runs to one space, trimmed), digested, and grouped by digest over the whole corpus. The occurrence with the smallest
(document, offset) stays. Other occurrences are repeats: those that stand behind each other make a passage, across lines
as well, and a passage of at least `least_run` words is cut out. A lone short sentence or line that strangers share stays. The
original character offsets of each cut are kept.

Words are counted by white space; text without blanks counts one word per `LETTERS` characters, so that it is no single word.

Defined cases: null and empty texts have no units; units below `least_words` words are never removed; repeated rows of
one document are the same occurrence, so none of them loses a unit to another; a null document id ranks first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featloom.core import col, quoted
from featloom.llm.base import encoded, query, stored, table

#: A piece ends behind a sentence mark with blanks, behind a line break, or at the end of the text.
PIECES = r"[^\n]*?[.!?]+[ \t]+|[^\n]*\n|[^\n]+"
_PIECE = re.compile(PIECES)
#: Words of a unit, words of a passage that is cut out, and characters that count as a word where no blank does.
LEAST_WORDS, LEAST_RUN, LETTERS = 6, 15, 8


def _pieces(text: str) -> list[tuple[int, int, int, int, list[bytes]]]:
    """(start, stop, line, number of words, lower-cased words) of all pieces."""
    out, line = [], 0
    for piece in _PIECE.finditer(text):
        body = piece.group()
        own = encoded(body).lower().split()
        n = len(own)
        # Only with LETTERS characters for each word, and as many again, can there be more words than blanks tell.
        if len(body) >= LETTERS * (n + 1):
            n = max(n, len(b" ".join(own).decode("utf-8", "surrogatepass")) // LETTERS)
        out.append((piece.start(), piece.end(), line, n, own))
        line += body[-1] == "\n"
    return out


def units_of(text: str, least_words: int) -> list[tuple[int, int, int, bytes]]:
    """(start, stop, words, normalised text) of the units that are long enough to be removed."""
    pieces = _pieces(text)
    lines = [0] * (pieces[-1][2] + 1 if pieces else 0)
    for _, _, line, n, _ in pieces:
        lines[line] += n
    out = []
    start = stop = size = 0
    words: list[bytes] = []
    last = -1
    for begin, end, line, n, own in pieces:
        fresh = n >= least_words
        if line != last:
            # Short lines in a row form blocks whose ends depend on their own words, so that they are the same in every text.
            fresh = line == 0 or max(lines[line], lines[line - 1]) >= least_words or hashlib.md5(b" ".join(own), usedforsecurity=False).digest()[0] < 64
        if fresh:
            if size >= least_words:
                out.append((start, stop, size, b" ".join(words)))
            start, size, words = begin, n, own
        else:
            size, words = size + n, words + own
        stop, last = end, line
    if size >= least_words:
        out.append((start, stop, size, b" ".join(words)))
    return out


def text_units(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per unit: its document, a hash of the document's text, the offsets, the number of words and the digest."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            starts: list[int] = []
            stops: list[int] = []
            sizes: list[int] = []
            digests: list[bytes] = []
            for i, body in enumerate(batch.column(2).to_pylist()):
                for start, stop, size, unit in units_of(body, least_words):
                    rows.append(i)
                    starts.append(start)
                    stops.append(stop)
                    sizes.append(size)
                    digests.append(hashlib.md5(unit, usedforsecurity=False).digest())
            taken = [batch.column(k).take(pa.array(rows, pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary())], names)

    names = ["key", "mark", "start", "stop", "words", "digest"]
    kind = docs.schema[key].dataType.simpleString()
    source = docs.where(F.length(col(text)) > 0).select(col(key).alias("key"), F.xxhash64(col(text)).alias("mark"), col(text).alias("body"))
    return source.mapInArrow(split, f"key {kind}, mark long, start int, stop int, words int, digest binary")


def repeated_units(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, least_run: int = LEAST_RUN) -> DataFrame:
    """Every removed unit of a text once: key, mark, start, stop, and where the kept occurrence lies.

    Digests are counted with partial sums, so a very common unit travels as one row per task. The table of repeated
    digests is joined to the units; a hot digest is split between tasks by the adaptive join.
    """
    units = stored(text_units(docs, key, text, least_words), "units")
    at = F.struct("key", "start")
    first = units.groupBy("digest").agg(F.min(at).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = stored(first.select("digest", F.col("kept.key").alias("kept_key"), F.col("kept.start").alias("kept_start")), "first")
    same = F.col("key").eqNullSafe(F.col("kept_key")) & (F.col("start") == F.col("kept_start"))
    repeats = units.join(first, "digest").where(~same).select("key", "mark", "start", "stop", "words", "kept_key", "kept_start")
    return _passages(repeats).where(F.col("run") >= least_run).select("key", "mark", "start", "stop", "kept_key", "kept_start")


def _passages(repeats: DataFrame) -> DataFrame:
    """Repeats with the words of the passage they stand in; a window holds the units of one text."""
    whole = ["key", "mark"]
    order = Window.partitionBy(*whole).orderBy("start")
    once = repeats.withColumn("before", F.lag("start").over(order)).where(~F.col("before").eqNullSafe(F.col("start")))
    begins = F.when(~F.lag("stop").over(order).eqNullSafe(F.col("start")), F.col("start"))
    placed = once.withColumn("passage", F.last(begins, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.withColumn("run", F.sum("words").over(Window.partitionBy(*whole, "passage")))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, spans: str | None = None,
                    least_run: int = LEAST_RUN) -> DataFrame:
    """The documents with repeated units cut out; `spans` names a column for the cuts (start, stop in the original)."""
    cuts = repeated_units(docs, key, text, least_words, least_run).groupBy("key", "mark").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("__cuts"))
    cuts = cuts.select(F.col("key").alias("__key"), F.col("mark").alias("__mark"), "__cuts")
    body = col(text)
    joined = docs.join(cuts, col(key).eqNullSafe(F.col("__key")) & (F.xxhash64(body) == F.col("__mark")), "left")
    begin = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    left = F.aggregate(
        "__cuts", begin,
        lambda acc, s: F.struct(F.concat(acc["text"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"])).alias("text"), s["stop"].alias("at")),
        lambda acc: F.concat(acc["text"], F.substring(body, acc["at"] + 1, F.length(body))),
    )
    out = [F.when(F.col("__cuts").isNotNull(), left).otherwise(body).alias(c) if c == text else col(c) for c in docs.columns]
    if spans is not None:
        out.append(F.coalesce(F.col("__cuts"), F.array().cast("array<struct<start:int,stop:int>>")).alias(spans))
    return joined.select(*out)


NORMAL_SQL = "translate(trim(regexp_replace({0}, '[\\x20\\x09-\\x0D]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = f"""
WITH pieces AS (
    SELECT doc_id, unnest(p) AS piece, unnest(range(len(p))) AS i
    FROM (SELECT doc_id, regexp_extract_all(text, '{PIECES}') AS p FROM documents WHERE length(text) > 0)),
sized AS (
    SELECT doc_id, i, piece, greatest(len(regexp_extract_all(piece, '[^\\x20\\x09-\\x0D]+')), length({NORMAL_SQL.format("piece")}) // {LETTERS}) AS w,
        coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offs,
        coalesce(right(lag(piece) OVER (PARTITION BY doc_id ORDER BY i), 1) = chr(10), true) AS fresh
    FROM pieces),
lines AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS line FROM sized),
long AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, line) AS line_words FROM lines),
marked AS (
    SELECT *, CASE WHEN NOT fresh THEN w >= {LEAST_WORDS} ELSE line = 1 OR line_words >= {LEAST_WORDS} OR lag(line_words) OVER (PARTITION BY doc_id ORDER BY i) >= {LEAST_WORDS}
        OR substr(md5({NORMAL_SQL.format("piece")}), 1, 1) < '4' END AS starts
    FROM long),
numbered AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM marked),
units AS (
    SELECT doc_id, min(offs) AS start, max(offs + length(piece)) AS stop, sum(w) AS words, {NORMAL_SQL.format("string_agg(piece, '' ORDER BY i)")} AS body
    FROM numbered GROUP BY doc_id, u HAVING sum(w) >= {LEAST_WORDS}),
ranked AS (
    SELECT *, first_value(doc_id) OVER o AS kept_doc_id, first_value(start) OVER o AS kept_start, row_number() OVER o AS r
    FROM units WINDOW o AS (PARTITION BY body ORDER BY doc_id, start)),
joined AS (
    SELECT *, CASE WHEN lag(stop) OVER (PARTITION BY doc_id ORDER BY start) = start THEN 0 ELSE 1 END AS begins FROM ranked WHERE r > 1),
passages AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY start) AS passage FROM joined)
SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, kept_doc_id, CAST(kept_start AS BIGINT) AS kept_start
FROM passages QUALIFY sum(words) OVER (PARTITION BY doc_id, passage) >= {LEAST_RUN}
"""


@query("op5_substring_dedup", SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    removed = repeated_units(table(spark, folder, "documents"))
    return removed.select(F.col("key").alias("doc_id"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"),
                          F.col("kept_key").alias("kept_doc_id"), F.col("kept_start").cast("long").alias("kept_start"))
