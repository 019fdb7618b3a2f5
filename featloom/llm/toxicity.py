"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy on all partitions.

A word's embedding is the sum of three hashed rows: the word, its first four and its first five letters, so that inflected
forms share what they have in common. Filters of one, two and three words slide over the whole text; each keeps its
largest response, and a logistic unit reads these. Only the strongest window of each filter gets a gradient (Adagrad).
The first embedding coordinate starts at a cautious log-odds of its bucket, the rest at small random numbers.

Labels, languages, sources and ids are no inputs of a score. Decision thresholds are calibrated by language, on labelled
rows kept back from training; a language with too few of them takes the common threshold.

Learned from all labelled rows, in passes: partitions train side by side from one model, and their changes are averaged,
bucket by bucket over the partitions that met it. Only the model, of fixed size, passes the driver; first log-odds, curve and
thresholds come from sums over all rows. Every text is learned from and scored whole. Defined cases: null
and empty texts get the score of a text without words; without labels of both kinds every score is the share of
positives; repeated rows get the same score; further columns are ignored.
"""

from __future__ import annotations

import copy
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featloom.core import checked_broadcast, checkpointed, col, written
from featloom.functions.ordering import running_sums
from featloom.llm.base import encoded, in_fold, picked, query, table

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
BUCKETS, SIZE, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 8
#: Labelled rows of a partition that trains by itself between two merges; passes over all rows; one of so many rows only calibrates.
PART, ROUNDS, HELD = 4_000, 8, 5
#: Buckets of the table that are merged together.
CHUNK = 256
#: Words convolved at a time, so that a very long text needs no large arrays.
PIECE = 4096
#: Score from which on a text counts as toxic, whatever its language.
DECISION = 0.3
#: Calibration rows of a language below which it takes the common threshold.
LEAST_ROWS = 40


def words_of(text: str | None) -> list[bytes]:
    return WORDS.findall(encoded((text or "").lower()))


def buckets_of(word: bytes) -> tuple[int, int, int]:
    return tuple(xxhash.xxh64_intdigest(w, seed) & (BUCKETS - 1) for seed, w in enumerate((word, word[:4], word[:5])))


class Convolution:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.05, (BUCKETS, SIZE)).astype(np.float32)
        self.kernels = {k: rng.normal(0, 0.2, (k, SIZE, FILTERS)).astype(np.float32) for k in WIDTHS}
        for k in WIDTHS:
            self.kernels[k][:, 0, :] = np.abs(self.kernels[k][:, 0, :]) + 0.3 / k
        self.shift = {k: np.zeros(FILTERS, np.float32) for k in WIDTHS}
        self.out = np.full(len(WIDTHS) * FILTERS, 0.1, np.float32)
        self.bias = np.float32(-1.0)
        self.curve = (1.0, 0.0)

    def pooled(self, parts: np.ndarray) -> np.ndarray:
        """Largest response of each filter; parts: per word its products with every kernel row, widths side by side."""
        if len(parts) < max(WIDTHS):
            parts = np.vstack([parts, np.zeros((max(WIDTHS) - len(parts), parts.shape[1]), parts.dtype)])
        best = []
        at = 0
        for k in WIDTHS:
            own = [parts[j : len(parts) - k + 1 + j, at + j * FILTERS : at + (j + 1) * FILTERS] for j in range(k)]
            total = own[0] if k == 1 else sum(own[1:], own[0])
            best.append(total.max(axis=0) + self.shift[k])
            at += k * FILTERS
        return np.maximum(np.concatenate(best), 0)

    def products(self, buckets: np.ndarray) -> np.ndarray:
        return self.table[buckets].sum(axis=1) @ np.hstack([self.kernels[k][j] for k in WIDTHS for j in range(k)])

    def margin(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.out + self.bias

    def probability(self, margin):
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * margin + self.curve[1], -30, 30)))

    def fresh(self) -> dict:
        """Sums of squared gradients, by parameter."""
        seen = {"table": np.full((BUCKETS, 1), 0.1, np.float32), "out": np.full(self.out.shape, 0.1), "bias": np.full((), 0.1)}
        return seen | {("kernel", k): np.full(self.kernels[k].shape, 0.1) for k in WIDTHS} | {("shift", k): np.full(FILTERS, 0.1) for k in WIDTHS}

    def small(self, seen: dict) -> np.ndarray:
        """All parameters but the table, and their sums, side by side."""
        own = [self.out, self.bias, *self.kernels.values(), *self.shift.values()]
        sums = [seen["out"], seen["bias"], *[seen["kernel", k] for k in WIDTHS], *[seen["shift", k] for k in WIDTHS]]
        return np.concatenate([np.ravel(v).astype(float) for v in own + sums])

    def set_small(self, values: np.ndarray, seen: dict) -> None:
        shapes = [self.out.shape, (), *[self.kernels[k].shape for k in WIDTHS], *[self.shift[k].shape for k in WIDTHS]] * 2
        ends = np.cumsum([int(np.prod(shape)) for shape in shapes])
        parts = [v.reshape(shape) for v, shape in zip(np.split(values, ends[:-1]), shapes, strict=True)]
        own, sums = parts[: len(parts) // 2], parts[len(parts) // 2 :]
        self.out, self.bias = own[0].astype(np.float32), np.float32(own[1])
        seen["out"], seen["bias"] = sums[0], sums[1]
        for i, k in enumerate(WIDTHS):
            self.kernels[k], self.shift[k] = own[2 + i].astype(np.float32), own[2 + len(WIDTHS) + i].astype(np.float32)
            seen["kernel", k], seen["shift", k] = sums[2 + i], sums[2 + len(WIDTHS) + i]

    def train(self, docs: list[np.ndarray], y: np.ndarray, share: float, seen: dict, rng, rate: float = 0.05, batch: int = 16) -> None:
        """One pass over docs, the word buckets of each document (n words, 3); share: of positives in all of the training."""
        weight = np.where(y > 0, 1 / (2 * share), 1 / (2 * (1 - share)))
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            self._step([docs[i] for i in own], y[own], weight[own], rate, seen)

    def seed_log_odds(self, counts: np.ndarray, share: float) -> None:
        """counts: negative and positive documents by bucket."""
        # Ten documents of the usual mix are added to each bucket; what remains after 1.6 standard errors counts.
        high, low = counts[1] + 10 * share, counts[0] + 10 * (1 - share)
        odds, error = np.log(high / low) - np.log(share / (1 - share)), 1.6 * np.sqrt(1 / high + 1 / low)
        self.table[:, 0] = np.clip(np.sign(odds) * np.maximum(0, np.abs(odds) - error), -3, 3) / 3

    def _step(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rate: float, seen: dict) -> None:
        padded = [d if len(d) >= max(WIDTHS) else np.vstack([d, np.zeros((max(WIDTHS) - len(d), 3), d.dtype)]) for d in docs]
        flat = np.vstack(padded)
        starts = np.cumsum([0] + [len(d) for d in padded])
        embedded = self.table[flat].sum(axis=1)
        pooled = np.zeros((len(docs), len(self.out)), np.float32)
        where = np.zeros((len(docs), len(self.out)), np.int64)
        for w, k in enumerate(WIDTHS):
            response = sum(embedded[j : len(flat) - k + 1 + j] @ self.kernels[k][j] for j in range(k)) + self.shift[k]
            for d in range(len(docs)):
                part = response[starts[d] : starts[d + 1] - k + 1]
                top = part.argmax(axis=0)
                cols = slice(w * FILTERS, (w + 1) * FILTERS)
                pooled[d, cols], where[d, cols] = part[top, np.arange(FILTERS)], starts[d] + top
        active = pooled > 0
        pooled = np.maximum(pooled, 0)
        error = (1 / (1 + np.exp(-np.clip(self.margin(pooled), -30, 30))) - (y > 0)) * weight / len(docs)
        back = error[:, None] * self.out * active

        def move(name, value, gradient):
            seen[name] += gradient**2
            return value - rate * gradient / np.sqrt(seen[name])

        self.out = move("out", self.out, error @ pooled + 1e-4 * self.out).astype(np.float32)
        self.bias = np.float32(move("bias", self.bias, error.sum()))
        rows, grads = [], []
        for w, k in enumerate(WIDTHS):
            cols = slice(w * FILTERS, (w + 1) * FILTERS)
            g, at = back[:, cols], where[:, cols]
            kernel = np.zeros(self.kernels[k].shape)
            for j in range(k):
                e = embedded[at + j]
                kernel[j] = np.einsum("df,dfe->ef", g, e)
                rows.append(flat[at + j].reshape(-1, 3))
                grads.append((g[:, :, None] * self.kernels[k][j].T[None]).reshape(-1, SIZE))
            self.kernels[k] = move(("kernel", k), self.kernels[k], kernel + 1e-4 * self.kernels[k]).astype(np.float32)
            self.shift[k] = move(("shift", k), self.shift[k], g.sum(axis=0)).astype(np.float32)
        ids = np.vstack(rows)
        touched, inverse = np.unique(ids, return_inverse=True)
        total = np.zeros((len(touched), SIZE))
        np.add.at(total, inverse.reshape(ids.shape), np.vstack(grads)[:, None, :])
        seen["table"][touched] += (total**2).mean(axis=1, keepdims=True)
        self.table[touched] -= (rate * total / np.sqrt(seen["table"][touched])).astype(np.float32)


class WordRows(dict):
    """Row of a word in a matrix of kernel products; words met for the first time wait in `fresh`."""

    LIMIT = 200_000

    def __init__(self, model: Convolution):
        super().__init__()
        self.model, self.fresh = model, []
        self.rows = np.zeros((self.LIMIT + PIECE, sum(WIDTHS) * FILTERS), np.float32)

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        self.fresh.append(word)
        return at

    def products(self, words: list[bytes]) -> np.ndarray:
        if len(self) >= self.LIMIT:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            first = len(self) - len(self.fresh)
            self.rows[first : len(self)] = self.model.products(np.array([buckets_of(w) for w in self.fresh]))
            self.fresh = []
        return self.rows[at]


def _margin(model: Convolution, known: WordRows, words: list[bytes]) -> float:
    best = model.pooled(np.zeros((0, sum(WIDTHS) * FILTERS), np.float32)) if not words else None
    overlap = max(WIDTHS) - 1
    # A piece that would hold no more than the overlap is inside the one before.
    for at in range(0, max(min(len(words), 1), len(words) - overlap), PIECE - overlap):
        own = model.pooled(known.products(words[at : at + PIECE]))
        best = own if best is None else np.maximum(best, own)
    return float(model.margin(best))


def labelled_words(docs: DataFrame, labels: DataFrame, key: str, text: str, lang: str, label: str) -> DataFrame:
    """Every labelled document: held (it only calibrates), label, lang and its word buckets, in partitions of about `PART` rows.

    The partitions and the order in them depend on keys only, and stay as they are from pass to pass.
    """
    known = labels.where(col(label).isin(0, 1) & col(key).isNotNull()).groupBy(col(key).alias("__key")).agg(F.max(col(label).cast("int")).alias("label"))
    parts = max(1, -(-known.count() // PART))
    wanted = docs.select(col(key).alias("__key"), col(lang).cast("string").alias("lang"), col(text).alias("text"))
    rows = wanted.join(checked_broadcast(known), "__key").repartition(parts, "__key")
    rows = rows.sortWithinPartitions(F.xxhash64("__key", F.lit(23)), "__key", "lang", "text")
    held = F.pmod(F.xxhash64("__key", F.lit(4)), F.lit(HELD)) == 0

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, bytes] = {}
        for batch in batches:
            out = []
            for body in batch.column(3).to_pylist():
                ids = b"".join([memo.get(w) or memo.setdefault(w, np.array(buckets_of(w), np.uint16).tobytes()) for w in words_of(body)])
                out.append(zlib.compress(ids, 1))
                if len(memo) > 200_000:
                    memo.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], ["held", "label", "lang", "buckets"])

    return checkpointed(rows.select(held.alias("held"), "label", "lang", "text").mapInArrow(hashed, "held boolean, label int, lang string, buckets binary"))


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    docs = [np.frombuffer(zlib.decompress(b), np.uint16).reshape(-1, 3).astype(np.int64) for b in batch.column("buckets").to_pylist()]
    return batch.column("label").to_numpy(), docs


def _by_chunk(rows: DataFrame, merge) -> dict[int, np.ndarray]:
    """Values that tasks sent, merged chunk by chunk on executors: a model's size in all comes back."""

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1].to_numpy(), "value": [merge(pdf).astype(float).tobytes()]})

    got = rows.groupBy("chunk").applyInPandas(merged, "chunk int, value binary").collect()
    return {r["chunk"]: np.frombuffer(r["value"]) for r in got}


_SENT = "chunk int, at binary, value binary"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    chunk, at, value = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int32()), pa.array(at, pa.binary()), pa.array(value, pa.binary())], ["chunk", "at", "value"])


def _bucket_counts(used: DataFrame) -> np.ndarray:
    """Documents by label and bucket, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS))
        for batch in batches:
            for label, ids in zip(*_unpacked(batch), strict=True):
                counts[int(label > 0), np.unique(ids)] += 1
        own = counts.reshape(2, -1, CHUNK)
        yield _sent([(i, None, own[:, i].tobytes()) for i in range(own.shape[1])])

    got = _by_chunk(used.mapInArrow(count, _SENT), lambda pdf: sum(np.frombuffer(v) for v in pdf["value"]))
    return np.stack([got[i].reshape(2, CHUNK) for i in range(BUCKETS // CHUNK)], axis=1).reshape(2, BUCKETS)


def _pass(used: DataFrame, model: Convolution, seen: dict, share: float, number: int) -> None:
    """Every partition trains on all of its rows from the same model; a parameter moves by the mean of the partitions that touched it."""
    start = used.sparkSession.sparkContext.broadcast((model, seen))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = copy.deepcopy(start.value)
        table, before, small = own.table.copy(), sums["table"].copy(), own.small(sums)
        rows = 0
        for batch in batches:
            y, docs = _unpacked(batch)
            if len(docs):
                own.train(docs, y, share, sums, np.random.default_rng([2, number, rows]))
                rows += len(docs)
        if not rows:
            return
        moved = np.flatnonzero(sums["table"][:, 0] != before[:, 0])
        step = np.hstack([own.table - table, sums["table"] - before])
        sent = [(-1, None, (own.small(sums) - small).tobytes())]
        for chunk in np.unique(moved // CHUNK):
            at = moved[moved // CHUNK == chunk]
            sent.append((int(chunk), (at % CHUNK).astype(np.uint16).tobytes(), step[at].astype(np.float32).tobytes()))
        yield _sent(sent)

    def merge(pdf: pd.DataFrame) -> np.ndarray:
        # sums in one order, so that a run can be repeated
        pdf = pdf.sort_values("value")
        if pdf["chunk"].iat[0] < 0:
            return np.mean([np.frombuffer(v) for v in pdf["value"]], axis=0)
        total, touched = np.zeros((CHUNK, SIZE + 1)), np.zeros((CHUNK, 1))
        for at, value in zip(pdf["at"], pdf["value"], strict=True):
            rows = np.frombuffer(at, np.uint16)
            total[rows] += np.frombuffer(value, np.float32).reshape(-1, SIZE + 1)
            touched[rows] += 1
        return total / np.maximum(touched, 1)

    for chunk, value in _by_chunk(used.mapInArrow(train, _SENT), merge).items():
        if chunk < 0:
            model.set_small(model.small(seen) + value, seen)
        else:
            rows, value = slice(chunk * CHUNK, (chunk + 1) * CHUNK), value.reshape(CHUNK, SIZE + 1)
            model.table[rows] += value[:, :SIZE].astype(np.float32)
            seen["table"][rows] += value[:, SIZE:].astype(np.float32)
    start.destroy()


def _margins(rows: DataFrame, model: Convolution) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, docs = _unpacked(batch)
            found = [float(sent.value.margin(sent.value.pooled(sent.value.products(d)))) for d in docs]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("lang"), pa.array(found, pa.float64())], ["label", "lang", "margin"])

    return written(rows.mapInArrow(score, "label int, lang string, margin double"), "margins")


def _curve(margins: DataFrame, high: int, low: int) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margin to probability, by Newton steps whose sums are made over all rows."""
    m, target = F.col("margin"), F.when(F.col("label") > 0, (high + 1) / (high + 2)).otherwise(1 / (low + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _logistic(m, a, b)
        w = p * (1 - p)
        sums = margins.agg(*[F.sum(c) for c in ((p - target) * m, p - target, w * m * m, w * m, w)]).first()
        g = np.array([sums[0] + 1e-3 * a, sums[1] + 1e-3 * b])
        step = np.linalg.solve(np.array([[sums[2] + 1e-3, sums[3]], [sums[3], sums[4] + 1e-3]]), g)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 0.1)), float(b)


def _logistic(margin: Column, a: float, b: float) -> Column:
    at = F.greatest(F.least(margin * F.lit(float(a)) + F.lit(float(b)), F.lit(30.0)), F.lit(-30.0))
    return 1 / (1 + F.exp(-at))


def _thresholds(scores: DataFrame) -> dict[str, float]:
    """name: the threshold of the best F1 over all its rows (name, score, label), in the middle between the two scores it separates."""
    values = written(scores.groupBy("name", "score").agg(F.count("*").alias("n"), F.sum("label").alias("hits")), "scores")
    totals = values.groupBy("name").agg(F.sum("n").alias("all"), F.sum("hits").alias("positives"))
    usable = totals.where((F.col("name") == "") | ((F.col("all") >= LEAST_ROWS) & (F.col("positives") > 0) & (F.col("positives") < F.col("all"))))
    upto = running_sums(values, [F.desc("score")], {"_n": F.col("n"), "_hits": F.col("hits")}, by=["name"]).join(usable, "name")
    f1 = 2 * F.col("_hits") / (F.col("_n") + F.greatest(F.lit(1), F.col("positives")))
    best = upto.groupBy("name").agg(F.max(F.struct(f1.alias("f1"), F.col("score").alias("score")))["score"].alias("best"))
    below = values.join(best, "name").groupBy("name", "best").agg(F.max(F.when(F.col("score") < F.col("best"), F.col("score"))).alias("next"))
    return {r["name"]: r["best"] if r["next"] is None else (r["best"] + r["next"]) / 2 for r in below.collect()}


class Toxicity:
    """A fitted classifier: `model` scores words, `thresholds` decides by language. Learned from all `rows` of `labelled_words`."""

    def __init__(self, rows: DataFrame, rounds: int = ROUNDS):
        self.model, self.thresholds, self.common = Convolution(), {}, DECISION
        counts = {(r["held"], r["label"]): r["count"] for r in rows.groupBy("held", "label").count().collect()}
        high, low = counts.get((False, 1), 0), counts.get((False, 0), 0)
        if not high or not low:
            positives, total = high + counts.get((True, 1), 0), sum(counts.values())
            self.model.out[:] = 0
            share = (positives + 1) / (total + 2)
            self.model.bias = np.float32(np.log(share / (1 - share)))
            return
        used, share, seen = rows.where("NOT held"), high / (high + low), self.model.fresh()
        self.model.seed_log_odds(_bucket_counts(used), share)
        for number in range(rounds):
            _pass(used, self.model, seen, share, number)
        both = (True, 1) in counts and (True, 0) in counts
        margins = _margins(rows.where("held") if both else used, self.model)
        self.model.curve = _curve(margins, counts[both, 1], counts[both, 0])
        score = _logistic(F.col("margin"), *self.model.curve)
        names = F.array_distinct(F.array(F.lit(""), F.coalesce("lang", F.lit(""))))
        self.thresholds = _thresholds(margins.select(F.explode(names).alias("name"), score.alias("score"), "label"))
        self.common = self.thresholds.pop("")


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic") -> Toxicity:
    return Toxicity(labelled_words(docs, labels, key, text, lang, label))


def scored(docs: DataFrame, fitted: Toxicity, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, lang, score, threshold (of the row's language) and flagged (score at or above it)."""
    sent = docs.sparkSession.sparkContext.broadcast(fitted.model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        known = WordRows(model)
        for batch in batches:
            margins = np.array([_margin(model, known, words_of(body)) for body in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.probability(margins), pa.float64())], [key, "lang", "score"])

    own = docs.select(col(key).alias(key), col(lang).cast("string").alias("lang"), col(text).alias("text"))
    fields = [T.StructField(key, docs.schema[key].dataType), T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]
    threshold = F.lit(fitted.common)
    if fitted.thresholds:
        by = F.create_map(*[F.lit(v) for kv in sorted(fitted.thresholds.items()) for v in kv])
        threshold = F.coalesce(F.try_element_at(by, F.coalesce(F.col("lang"), F.lit(""))), threshold)
    found = own.mapInArrow(score, T.StructType(fields))
    return found.withColumn("threshold", threshold).withColumn("flagged", F.col("score") >= F.col("threshold"))


@query("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = picked(table(spark, folder, "documents"), "doc_id", "text", "lang")
    labels = picked(table(spark, folder, "labels"), "doc_id", "toxic").where(~in_fold(F.col("doc_id")))
    found = scored(docs, fit_toxicity(docs.where(~in_fold(F.col("doc_id"))), labels))
    return found.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= DECISION).cast("int").alias("predicted"), "threshold", "flagged")
