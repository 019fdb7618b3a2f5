"""Periodic runs of words by longest common extensions over a difference cover.

A run is a stretch of words with smallest period q and at least max(`least_words`, `least_periods` * q) words that no
neighbouring word extends. Documents are numbered word by word and laid behind each other, a word of its own between
them, so that one pass of array operations serves thousands of short texts; a long text is simply a pass of its own.

1. Harmonic grid: a run of period q has (least_periods - 1) * q consecutive places i whose word equals the word at i + q,
   so every multiple of (least_periods - 1) * q is tried, for q up to n / least_periods: n log n places in all.
2. Each pair (i, i + q) whose words agree is extended both ways. A few words are compared until both places reach members
   of a difference cover modulo `MODULUS`; most pairs part before.
3. Only if some pair comes that far, the suffixes at covered places of these documents are sorted by doubling, common
   lengths of neighbours follow from the ranks of each round, and a sparse table answers range minima. Backward
   extensions use the same structure over the reversed words.
4. Stretches that are long enough are runs; of equal stretches the smallest period counts, as the others are multiples.

Memory is proportional to n log n of the largest pass, which is one text or `PASS_WORDS` words.

Defined cases: null, empty and blank texts have no words and no runs; repeated rows are handled each by itself; an empty
table gives an empty result; of the further columns only those named are kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.core import col
from featloom.llm.base import encoded, query, table

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Every difference modulo 7 is one of two members of the cover.
MODULUS, COVER = 7, (1, 2, 4)
#: Words of short texts that share a pass, and grid places tried at once.
PASS_WORDS, PLACES = 400_000, 1 << 20
_IN = np.isin(np.arange(MODULUS), COVER)
#: By residues of two places: words until both are covered.
_STEPS = np.array([[next(d for d in range(MODULUS) if _IN[(i + d) % MODULUS] and _IN[(j + d) % MODULUS]) for j in range(MODULUS)] for i in range(MODULUS)])


class CommonExtensions:
    """Longest common extension of two covered places of `words`, in constant time."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.places = np.flatnonzero(_IN[np.arange(n) % MODULUS])
        self.at = np.full(n + 1, -1, np.int64)
        self.at[self.places] = np.arange(len(self.places))
        padded = np.concatenate([words, np.full(MODULUS, -1, np.int64)])
        # Ranks by the first MODULUS words, then by doubled lengths: a place so many words on is covered as well.
        rank = self._ranks([padded[self.places + d] for d in range(MODULUS)])
        levels, reach = [(MODULUS, rank)], MODULUS
        while len(rank) and rank.max() < len(rank) - 1:
            rank = self._ranks([rank, self._later(rank, reach, n)])
            reach *= 2
            levels.append((reach, rank))
        self.rank = rank
        order = np.argsort(rank, kind="stable")
        self.table = [self._neighbours(padded, order, levels, n)]
        while len(self.table[-1]) > 1 << len(self.table) - 1:
            last, step = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(last[:-step], last[step:]))

    def _later(self, rank: np.ndarray, reach: int, n: int) -> np.ndarray:
        """Rank of the place `reach` words on; -1 behind the end."""
        on = self.places + reach
        out = np.full(len(on), -1, np.int64)
        inside = on < n
        out[inside] = rank[self.at[on[inside]]]
        return out

    @staticmethod
    def _ranks(keys: Sequence[np.ndarray]) -> np.ndarray:
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), bool)
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(new)
        return out

    def _neighbours(self, padded: np.ndarray, order: np.ndarray, levels: list, n: int) -> np.ndarray:
        """Common length of each sorted suffix and the next one."""
        a, b = self.places[order[:-1]], self.places[order[1:]]
        common = np.zeros(len(a), np.int64)
        for reach, rank in reversed(levels):
            x, y = a + common, b + common
            inside = np.maximum(x, y) < n
            same = inside.copy()
            same[inside] = rank[self.at[x[inside]]] == rank[self.at[y[inside]]]
            common += np.where(same, reach, 0)
        going = np.ones(len(a), bool)
        for _ in range(MODULUS):
            # Past the end a place has the padding of the other one's inner words, which never agree.
            x, y = np.minimum(a + common, n), np.minimum(b + common, n)
            going &= (padded[x] == padded[y]) & (x < n) & (y < n)
            common += going
        return common.astype(np.int32)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[self.at[i]], self.rank[self.at[j]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        width = high - low
        level = np.frexp(width.astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            held = level == k
            row = self.table[k]
            out[held] = np.minimum(row[low[held]], row[high[held] - (1 << int(k))])
        return out


class Extender:
    """Common extensions from any two places of words in which no two documents share a separator."""

    def __init__(self, words: np.ndarray):
        self.words, self.n = words, len(words)
        self.sorted: CommonExtensions | None = None

    def few(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words that agree before the places are covered, whether all did)."""
        steps = _STEPS[i % MODULUS, j % MODULUS]
        common = np.zeros(len(i), np.int64)
        going = np.ones(len(i), bool)
        for d in range(int(steps.max()) if len(steps) else 0):
            x, y = i + d, j + d
            inside = (d < steps) & (y < self.n) & (x < self.n) & going
            agree = inside.copy()
            agree[inside] = self.words[x[inside]] == self.words[y[inside]]
            common += agree
            going &= agree | (d >= steps)
        return common, going & (common == steps) & (np.maximum(i, j) + steps < self.n)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        common, covered = self.few(i, j)
        if covered.any():
            if self.sorted is None:
                self.sorted = CommonExtensions(self.words)
            at = np.flatnonzero(covered)
            common[at] += self.sorted(i[at] + common[at], j[at] + common[at])
        return common


def grid(sizes: np.ndarray, least_periods: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, place in it, period) of the whole grid in blocks of about `PLACES`."""
    order = np.argsort(-sizes, kind="stable")
    falling = sizes[order]
    held: list[tuple] = []
    size = 0
    for period in range(1, int(falling[0]) // least_periods + 1 if len(falling) else 1):
        own = order[: np.searchsorted(-falling, -least_periods * period, "right")]
        step = (least_periods - 1) * period
        counts = (sizes[own] - period - 1) // step + 1
        docs = np.repeat(own, counts)
        places = (np.arange(len(docs)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
        held.append((docs, places, np.full(len(docs), period, np.int64)))
        size += len(docs)
        if size >= PLACES:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _laid(texts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(words behind each other with separators of their own, start of each text)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    words = np.empty(int((sizes + 1).sum()), np.int64)
    inner = np.ones(len(words), bool)
    inner[starts + sizes] = False
    words[inner] = np.concatenate(texts) if texts else []
    words[~inner] = -2 - np.arange(len(texts))
    return words, starts


def runs_of(texts: Sequence[np.ndarray], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of numbered texts, ordered by text, start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    words, starts = _laid(texts)
    near = []
    for docs, places, periods in grid(sizes, least_periods):
        i = starts[docs] + places
        agree = words[i] == words[i + periods]
        near.append(np.stack([docs[agree], places[agree], periods[agree]]))
    docs, places, periods = np.concatenate(near, axis=1) if near else np.empty((3, 0), np.int64)
    # Pairs that part within a few words both ways go before anything is sorted.
    wanted = np.maximum(least_words, least_periods * periods) - periods
    ahead, back = Extender(words), Extender(words[::-1].copy())
    i = starts[docs] + places
    turned = len(words) - i
    front, on = ahead.few(i, i + periods)
    rear, off = back.few(turned, turned - periods)
    live = on | off | (front + rear >= wanted)
    docs, places, periods, wanted = docs[live], places[live], periods[live], wanted[live]
    if not len(docs):
        return np.empty((0, 4), np.int64)
    # Only texts with such pairs are laid out again and sorted.
    kept, docs = np.unique(docs, return_inverse=True)
    words, starts = _laid([texts[k] for k in kept])
    ahead, back = Extender(words), Extender(words[::-1].copy())
    i = starts[docs] + places
    turned = len(words) - i
    front, rear = ahead(i, i + periods), back(turned, turned - periods)
    held = front + rear >= wanted
    rows = np.stack([docs, places - rear, front + rear + periods, periods])[:, held]
    rows = rows[:, np.lexsort(rows[::-1])]
    first = np.ones(rows.shape[1], bool)
    first[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
    rows = rows[:, first]
    rows[0] = kept[rows[0]]
    return rows[:, np.lexsort((rows[3], rows[1], rows[0]))].T


def dropped_words(n: int, runs: np.ndarray) -> np.ndarray:
    """True for words behind the first period of any run; runs: (start, length, period)."""
    turns = np.zeros(n + 1, np.int64)
    np.add.at(turns, runs[:, 0] + runs[:, 2], 1)
    np.add.at(turns, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(turns[:n]) > 0


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """Per row of `docs`: key, n_words, runs (start, length, period; by start, then period), collapsed (kept words, joined by one space)."""
    if least_periods < 2:
        raise ValueError(f"a run holds two periods at least, not {least_periods}")

    def flush(keys: list, texts: list[np.ndarray], names: list[bytes]) -> pa.RecordBatch:
        runs = runs_of(texts, least_words, least_periods)
        ends = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
        bodies = []
        for k, ids in enumerate(texts):
            own = runs[ends[k] : ends[k + 1], 1:]
            kept = ids[~dropped_words(len(ids), own)] if len(own) else ids
            bodies.append(b" ".join(map(names.__getitem__, kept.tolist())))
        parts = pa.StructArray.from_arrays([pa.array(runs[:, c], pa.int64()) for c in (1, 2, 3)], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(keys), pa.array([len(t) for t in texts], pa.int64()), lists, pa.array(bodies, pa.binary()).cast(pa.string())],
            ["key", "n_words", "runs", "collapsed"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, numbers, size = [], [], {}, 0
        for batch in batches:
            for row, body in enumerate(batch.column(1).to_pylist()):
                words = encoded(body).split()
                for w in words:
                    numbers.setdefault(w, len(numbers))
                texts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                keys.append(batch.column(0).slice(row, 1))
                size += len(words)
                if size >= PASS_WORDS:
                    yield flush(keys, texts, list(numbers))
                    keys, texts, numbers, size = [], [], {}, 0
        if texts:
            yield flush(keys, texts, list(numbers))

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(col(key).alias("key"), col(text).alias("text")).mapInArrow(find, schema)


def planted(text: Column, key: Column) -> Column:
    """The contract's texts: for every tenth crc32 of the id the words from a on repeat with period p."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))
    n = F.size(words).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    # Parts are bound once by one-element arrays, so that a word costs one look-up.
    bound = F.transform(F.array(F.struct(words.alias("w"), n.alias("n"), a.alias("a"), p.alias("p"))), lambda s: F.array_join(F.transform(
        F.sequence(F.lit(0).cast("long"), s["n"] - 1),
        lambda i: F.get(s["w"], F.when(i >= s["a"], s["a"] + (i - s["a"]) % s["p"]).otherwise(i).cast("int"))), " "))
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.get(bound, F.lit(0))).otherwise(text)


@query("op12_periodic_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    runs = periodic_runs(docs)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return runs.select(
        F.col("key").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), longest.alias("top"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", (-F.col("top.s")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.p")).alias("period"),
        F.expr("1000 * top.length div -top.p").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
