"""Language identification in two steps: the family first, then one-versus-one linear support vector machines within it.

Texts become square-root counts of hashed letter runs of one to three letters, scaled to length one. At each step every
pair of classes has its own linear support vector machine, fitted in the dual by coordinate ascent; the class with the
most votes wins, ties go to the larger sum of margins. Margins become probabilities by a logistic curve fitted on rows
kept back from training; the score of a prediction is its weakest pair at the family step times that within the family.

Only a bounded sample of the distinct labelled texts is learned from (`rows` in total, dealt evenly to the languages); every
text is read whole. Defined cases: a null text or one without a letter is `und` with score 0; with one learned language all
others get it with score 1; without labelled rows everything is `und`; repeated rows get the same prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featloom.core import col, quoted
from featloom.llm.base import in_fold, picked, query, table

# Family by language code. A code that is not listed is a family of its own.
FAMILIES = {
    "da": "germanic", "de": "germanic", "en": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "bg": "slavic", "cs": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "uk": "slavic",
}

BITS = 13
BUCKETS = 1 << BITS
#: Labelled texts learned from, all languages together; a quarter of them only fits the probability curves.
ROWS = 1_200
#: Code points turned into counts at a time, so that a very long text needs no large arrays.
PIECE = 1 << 18
UNKNOWN = "und"


class LetterRuns:
    """Hashed counts of runs of one to three letters; other characters are one blank."""

    def __init__(self) -> None:
        self.letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)

    def counts(self, text: str | None) -> np.ndarray | None:
        """None if the text has no letter."""
        if not text:
            return None
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        total = np.zeros(BUCKETS)
        any_letter = False
        for at in range(0, len(codes), PIECE):
            part = codes[max(0, at - 2) : at + PIECE]
            alpha = self.letters[part]
            if not alpha.any():
                continue
            any_letter = True
            keep = alpha.copy()
            keep[1:] |= alpha[:-1]
            c = np.where(alpha, part, np.uint32(32))[keep]
            c = np.concatenate([[np.uint32(32)], c]).astype(np.uint32)
            h = c * np.uint32(0x9E3779B1)
            total += self._bucket(h, 1)
            h2 = (h[:-1] ^ (h[:-1] >> np.uint32(13))) * np.uint32(0x85EBCA77) + c[1:]
            total += self._bucket(h2, 2)
            h3 = (h2[:-1] ^ (h2[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + c[2:]
            total += self._bucket(h3, 3)
        return total if any_letter else None

    @staticmethod
    def _bucket(h: np.ndarray, order: int) -> np.ndarray:
        h = (h + np.uint32(order)) * np.uint32(0x27D4EB2F)
        return np.bincount((h >> np.uint32(32 - BITS)).astype(np.int64), minlength=BUCKETS)

    def vector(self, text: str | None) -> np.ndarray | None:
        counts = self.counts(text)
        if counts is None:
            return None
        x = np.sqrt(counts)
        return (x / np.linalg.norm(x)).astype(np.float32)


def separator(gram: np.ndarray, y: np.ndarray, penalty: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weight of every row in the squared-hinge linear machine for labels -1 and 1.

    gram: inner products of the rows plus one, the one being the bias input. The
    machine is the weighted sum of the rows, its bias the sum of the weights.
    """
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    slack = 1 / (2 * penalty * weight)
    alpha, field = np.zeros(len(y)), np.zeros(len(y))
    order = np.random.default_rng(3)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            change = max(-alpha[i], (1 - y[i] * field[i] - slack[i] * alpha[i]) / (gram[i, i] + slack[i]))
            if change:
                alpha[i] += change
                field += change * y[i] * gram[i]
                moved = max(moved, abs(change))
        if moved < 1e-4:
            break
    return alpha * y


def curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margin to the probability of the positive class."""
    high, low = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (high + 1) / (high + 2), 1 / (low + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum() + 1e-3 * b])
        w = p * (1 - p)
        h = np.array([[(w * margins**2).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 0.1)), float(b)


class Pairwise:
    """One machine per pair of classes."""

    def __init__(self, classes: list[str], x: np.ndarray, gram: np.ndarray, y: np.ndarray, back: np.ndarray):
        """y: class by row of x, or another value for rows of other families; back: rows kept for the curves."""
        self.classes, self.pairs = classes, list(combinations(range(len(classes)), 2))
        self.weights = np.zeros((len(self.pairs), BUCKETS + 1), np.float32)
        self.curves = np.ones((len(self.pairs), 2))
        for k, (i, j) in enumerate(self.pairs):
            rows = (y == classes[i]) | (y == classes[j])
            sign = np.where(y == classes[i], 1.0, -1.0)
            fit = rows & ~back if len(set(sign[rows & ~back])) == 2 else rows
            held = rows & back if len(set(sign[rows & back])) == 2 else rows
            share = np.zeros(len(x))
            share[fit] = separator(gram[np.ix_(fit, fit)], sign[fit])
            self.weights[k, :-1], self.weights[k, -1] = share.astype(np.float32) @ x, share.sum()
            self.curves[k] = curve(gram[held] @ share, sign[held])

    def best(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winning class and the probability of its weakest pair, by row."""
        votes, strength, weakest = (np.zeros((len(x), len(self.classes))) for _ in range(3))
        weakest += 1
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        for k, (i, j) in enumerate(self.pairs):
            p = 1 / (1 + np.exp(-np.clip(margins[:, k] * self.curves[k, 0] + self.curves[k, 1], -30, 30)))
            for c, own in ((i, p), (j, 1 - p)):
                votes[:, c] += own >= 0.5
                strength[:, c] += own
                weakest[:, c] = np.minimum(weakest[:, c], own)
        won = np.lexsort((strength, votes), axis=1)[:, -1] if len(self.classes) > 1 else np.zeros(len(x), int)
        return won, weakest[np.arange(len(x)), won]


class Hierarchy:
    """A family step and, for each family, a step between its languages."""

    def __init__(self, x: np.ndarray, langs: np.ndarray, families: dict[str, str]):
        of = np.array([families.get(c, c) for c in langs], dtype=object)
        back = np.arange(len(x)) % 4 == 3
        self.families = sorted(set(of))
        # Rows against rows: the machines need no further copy of the inputs.
        gram = (x @ x.T).astype(np.float64) + 1
        self.root = Pairwise(self.families, x, gram, of, back)
        self.within = {f: Pairwise(sorted(set(langs[of == f])), x, gram, np.where(of == f, langs, None), back) for f in self.families}

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, score = self.root.best(x)
        out: list[str] = [UNKNOWN] * len(x)
        for k, name in enumerate(self.families):
            rows = np.flatnonzero(family == k)
            if len(rows):
                step = self.within[name]
                won, weakest = step.best(x[rows])
                score[rows] *= weakest
                for r, w in zip(rows, won, strict=True):
                    out[r] = step.classes[w]
        return out, score


def fit_languages(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = ROWS, families: dict[str, str] | None = None) -> Hierarchy | None:
    """Learn from at most `rows` of the labelled texts, or four of each language if that is more; None if there are none.

    Copies of a text in one language count once. Each language gives the same number of texts, the first by a hash, or
    all it has. What reaches the driver are hashed counts, at most `BUCKETS` numbers a row, not texts.
    """
    readable = col(lang).isNotNull() & col(text).rlike(r"\p{L}")
    known = labelled.where(readable).select(col(lang).cast("string").alias("lang"), col(text).alias("text"), F.xxhash64(col(text)).alias("mark"))
    sizes = {r["lang"]: r["count"] for r in known.select("lang", "mark").distinct().groupBy("lang").count().toLocalIterator()}
    if not sizes:
        return None
    each = max(4, rows // len(sizes))
    place = F.xxhash64("mark", F.lit(11))
    # Places are even over the distinct texts: below its limit a language has about 2 * each + 50 of them, or all.
    limits = {c: min((1 << 63) - 1, ((2 * each + 50 << 64) // n) - (1 << 63)) for c, n in sizes.items()}
    limit = F.create_map(*[F.lit(v).cast(t) for c, n in sorted(limits.items()) for v, t in ((c, "string"), (n, "long"))])
    sample = known.withColumn("place", place).where(F.col("place") <= limit[F.col("lang")]).select("lang", "mark", "place", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, seen = LetterRuns(), set()
        for batch in batches:
            out = []
            for name, mark, spot, body in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if (name, mark) in seen:
                    continue
                seen.add((name, mark))
                x = runs.vector(body)
                if x is not None:
                    at = np.flatnonzero(x)
                    out.append((name, mark, spot, at.astype(np.uint16).tobytes(), x[at].tobytes()))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["lang", "mark", "place", "at", "value"])

    # A text comes once from each task that has it.
    once = sample.mapInArrow(count, "lang string, mark long, place long, at binary, value binary").groupBy("lang", "mark", "place").agg(F.first("at").alias("at"), F.first("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "mark"))
    got = once.withColumn("rank", rank).where(F.col("rank") <= each).select("lang", "at", "value").toArrow().to_pylist()
    got.sort(key=lambda r: (r["lang"], r["at"], r["value"]))
    if not got:
        return None
    chosen = [got[i] for i in np.random.default_rng(5).permutation(len(got))]
    x = np.zeros((len(chosen), BUCKETS), np.float32)
    for k, r in enumerate(chosen):
        x[k, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["value"], np.float32)
    return Hierarchy(x, np.array([r["lang"] for r in chosen], dtype=object), FAMILIES if families is None else families)


def identified(docs: DataFrame, model: Hierarchy | None, text: str = "text", pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """The columns of `docs` (but for earlier ones of those names) plus the predicted language and its score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    kept = [i for i, c in enumerate(docs.columns) if c not in (pred, score)]
    names = [docs.columns[i] for i in kept]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, hierarchy = LetterRuns(), sent.value
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            for i in range(0, batch.num_rows, 256):
                bodies = batch.column(at).slice(i, 256).to_pylist()
                part = [UNKNOWN] * len(bodies)
                own = np.zeros(len(bodies))
                found = [(k, x) for k, x in enumerate(map(runs.vector, bodies)) if x is not None]
                if found and hierarchy is not None:
                    won, how = hierarchy.predict(np.stack([x for _, x in found]))
                    for (k, _), w, s in zip(found, won, how, strict=True):
                        part[k], own[k] = w, s
                langs += part
                scores += own.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, pred, score])

    fields = [docs.schema.fields[i] for i in kept] + [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())]
    return docs.mapInArrow(predict, T.StructType(fields))


def accepted(docs: DataFrame, train: Column | None = None, text: str = "text", lang: str = "lang", least_score: float = 0.3) -> DataFrame:
    """Documents with a recognised language; a null `lang` is filled with the prediction."""
    model = fit_languages(docs if train is None else docs.where(train), text, lang)
    found = identified(docs, model, text, "__pred", "__score").where((F.col("__pred") != UNKNOWN) & (F.col("__score") >= least_score))
    return found.withColumn(lang, F.coalesce(col(lang), F.col("__pred"))).select(*[quoted(c) for c in docs.columns])


@query("op3_language_id")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = picked(table(spark, folder, "documents"), "doc_id", "text", "lang")
    model = fit_languages(docs.where(~in_fold(F.col("doc_id"))))
    found = identified(docs.select("doc_id", "text"), model)
    return found.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
