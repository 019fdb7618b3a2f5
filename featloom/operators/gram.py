"""Pairwise sums of numeric columns, overall and per class."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.core import clean, col

# columns up to which all pairs are summed in one pass and sent to the driver (4 x 8 bytes each)
NARROW = 512
_HELD_BYTES = 64 << 20


@dataclass(frozen=True)
class Gram:
    """Pairwise-complete sums, taken around `shift` for numeric stability."""

    n: np.ndarray  # rows where both columns are present
    s: np.ndarray  # sum of column i over rows where j is present
    xy: np.ndarray  # sum of products
    xx: np.ndarray  # sum of squares of column i over rows where j is present

    def covariance(self) -> np.ndarray:
        with np.errstate(all="ignore"):
            out = (self.xy - self.s * self.s.T / self.n) / (self.n - 1)
        out[self.n < 2] = np.nan
        return out

    def correlation(self) -> np.ndarray:
        with np.errstate(all="ignore"):
            var = (self.xx - self.s**2 / self.n) / (self.n - 1)
            scale = np.abs(self.xx) / np.maximum(self.n, 1)
            var[var <= 1e-15 * scale] = 0.0
            r = self.covariance() / np.sqrt(var * var.T)
        r[(var <= 0) | (var.T <= 0) | (self.n < 2)] = np.nan
        return np.clip(r, -1.0, 1.0)


def _centres(df: DataFrame, columns: Sequence[str]) -> list[float]:
    got = df.agg(*[F.avg(clean(col(c))).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return [got[i] if got[i] is not None else 0.0 for i in range(len(columns))]


def gram(df: DataFrame, columns: Sequence[str]) -> Gram:
    """One pass: each task reduces its Arrow batches to d x d sums."""
    d = len(columns)
    if d == 0:
        return Gram(*[np.zeros((0, 0)) for _ in range(4)])
    shift = np.array(_centres(df, columns))
    plain = df.select([clean(col(c)).alias(f"c{i}") for i, c in enumerate(columns)])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((4, d, d))
        for batch in batches:
            x = batch.to_numpy(dtype=float) - shift
            present = ~np.isnan(x)
            x = np.where(present, x, 0.0)
            mask = present.astype(float)
            sums[0] += mask.T @ mask
            sums[1] += x.T @ mask
            sums[2] += x.T @ x
            sums[3] += (x * x).T @ mask
        yield pd.DataFrame({"cell": np.arange(4 * d * d), "v": sums.ravel()})

    rows = plain.mapInPandas(partial, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(4 * d * d)
    for r in rows:
        flat[r["cell"]] = r["v"]
    return Gram(*flat.reshape(4, d, d))


@dataclass(frozen=True)
class ClassGrams:
    """Row counts and sums per class, products over all classes, and the extreme variances of each class."""

    n: np.ndarray
    s: np.ndarray
    xy: np.ndarray
    spans: list[tuple[float, float]]  # smallest and largest positive eigenvalue of a class's covariance

    def discriminant_roots(self) -> list[float]:
        """Eigenvalues of inv(Sw) Sb; the pseudo-inverse covers a singular Sw."""
        if len(self.n) < 2:
            return []
        total = self.n.sum()
        mean = self.s.sum(0) / total
        within = self.xy - (self.s / self.n[:, None]).T @ self.s
        gaps = self.s / self.n[:, None] - mean
        between = (gaps * self.n[:, None]).T @ gaps
        values, vectors = np.linalg.eigh(within)
        keep = values > 1e-12 * max(values.max(), 1e-300)
        white = vectors[:, keep] / np.sqrt(values[keep])
        roots = np.linalg.eigvalsh(white.T @ between @ white)[::-1]
        count = min(len(self.n) - 1, self.s.shape[1])
        return [float(max(r, 0.0)) for r in roots[:count]]

    def spread_ratio(self) -> float:
        """Largest over smallest positive eigenvalue of the class covariances."""
        if len(self.n) < 2 or (self.n > 1).sum() < 2 or not self.spans:
            return 1.0
        return float(max(high for _, high in self.spans) / min(low for low, _ in self.spans))


def class_grams(df: DataFrame, columns: Sequence[str], target: str) -> ClassGrams:
    """Per-class sums with missing values as 0.

    Tasks reduce their rows to sums per class and pass these on when they exceed a fixed size; the products of a
    class are added up, and its eigenvalues taken, on executors. The driver gets the products over all classes,
    and per class its row count, its sums and two eigenvalues.
    """
    d = len(columns)
    filled = df.where(col(target).isNotNull()).select(
        col(target).cast("string").alias("_class"),
        *[F.coalesce(clean(col(c)), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(columns)],
    )
    shift = np.array(_centres(filled, [f"c{i}" for i in range(d)]))
    width = 1 + d + d * d
    most = max(1, _HELD_BYTES // (8 * width))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            x = batch.iloc[:, 1:].to_numpy(dtype=float) - shift
            names, codes = np.unique(batch["_class"].to_numpy(dtype=str), return_inverse=True)
            for i, name in enumerate(names):
                part = x[codes == i]
                flat = np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()])
                sums[name] = sums[name] + flat if name in sums else flat
                if len(sums) > most:
                    yield from _class_rows(sums)
                    sums = {}
        yield from _class_rows(sums)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # sorted by class: one class is held at a time
        products, name, sums = np.zeros((d, d)), None, None
        for batch in batches:
            for key, v in zip(batch["_class"], batch["v"], strict=True):
                if key == name:
                    sums = sums + v
                    continue
                if name is not None:
                    products += sums[1 + d :].reshape(d, d)
                    yield _class_summary(name, sums, d)
                name, sums = key, np.array(v, dtype=float)
        if name is not None:
            products += sums[1 + d :].reshape(d, d)
            yield _class_summary(name, sums, d)
        yield pd.DataFrame({"_class": pd.Series([None] * d, dtype=object), "place": np.arange(d), "v": list(products)})

    partials = filled.mapInPandas(partial, "_class string, v array<double>")
    reduced = partials.repartition("_class").sortWithinPartitions("_class").mapInPandas(reduce, "_class string, place int, v array<double>")
    n, s, spans, xy = [], [], [], np.zeros((d, d))
    for r in sorted(reduced.collect(), key=lambda r: (r["_class"] is None, r["_class"] or "", r["place"])):
        if r["_class"] is None:
            xy[r["place"]] += np.array(r["v"])
            continue
        n.append(r["v"][0])
        s.append(r["v"][3:])
        if r["v"][2] > 0:
            spans.append((r["v"][1], r["v"][2]))
    return ClassGrams(np.array(n), np.array(s).reshape(-1, d), xy, spans)


def _class_rows(sums: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
    for name, flat in sums.items():
        yield pd.DataFrame({"_class": [name], "v": [flat]})


def _class_summary(name: str, sums: np.ndarray, d: int) -> pd.DataFrame:
    n, s, low, high = sums[0], sums[1 : 1 + d], 0.0, 0.0
    if n > 1:
        values = np.linalg.eigvalsh((sums[1 + d :].reshape(d, d) - np.outer(s, s) / n) / (n - 1))
        positive = values[values > 0]
        if len(positive):
            low, high = positive.min(), positive.max()
    return pd.DataFrame({"_class": [name], "place": [0], "v": [np.concatenate([[n, low, high], s])]})
