"""Second moments of tables with thousands of numeric columns.

The columns travel as one array. Covariances are made a band of rows at a time and stay in a table; leading
components come from block Lanczos steps, each of which is one pass that sends a block of d x l sums to the driver.
No task holds more than `TASK_BYTES` of sums, whatever the number of columns, rows or classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.core import clean, col, rows_frame, scratch_path

TASK_BYTES = 128 << 20
_TASKS_PER_CORE = 4
_SEGMENT = 512


def packed(df: DataFrame, columns: Sequence[str], *others) -> DataFrame:
    """The columns as one array `x`; missing values are NaN. `others` are kept beside it."""
    numbers = [F.coalesce(clean(col(c)), F.lit(float("nan"))) for c in columns]
    return df.select(*others, F.array(*numbers).alias("x"))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _few_tasks(df: DataFrame) -> DataFrame:
    """Fewer, longer tasks where there are many, since each one ends with sums of fixed size."""
    return df.coalesce(_TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)


def _added(partials: DataFrame, key: str, parts: int) -> DataFrame:
    """Element-wise sums of arrays `v` by an integer key; groups are added while they stream past."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for name, v in zip(batch.column(key).to_pylist(), batch.column("v"), strict=True):
                values = v.values.to_numpy(zero_copy_only=False)
                if name in sums:
                    sums[name] += values
                else:
                    sums[name] = values.copy()
        for name, v in sums.items():
            yield _row(key, name, v)

    return partials.repartition(parts, key).mapInArrow(add, f"{key} int, v array<double>")


def _row(key: str, name: int, v: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array([name], pa.int32()), pa.array([v.ravel()], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(arrays, [key, "v"])


def _total(x: DataFrame, d: int, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of `part(rows)`, a d x width matrix; segments of rows are added by different tasks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((d, width))
        for batch in batches:
            sums += part(_matrix(batch, d))
        for at in range(0, d, _SEGMENT):
            yield _row("segment", at, sums[at : at + _SEGMENT])

    out = np.zeros((d, width))
    partials = _few_tasks(x).mapInArrow(partial, "segment int, v array<double>")
    for r in _added(partials, "segment", -(-d // _SEGMENT)).toLocalIterator():
        block = np.asarray(r["v"]).reshape(-1, width)
        out[r["segment"] : r["segment"] + len(block)] = block
    return out


@dataclass(frozen=True)
class Centre:
    """Counts, means and population deviations per column."""

    n: np.ndarray
    mean: np.ndarray
    sd: np.ndarray


def centre(x: DataFrame, d: int) -> Centre:
    """Two passes: means first, then squares around them."""

    def firsts(m: np.ndarray) -> np.ndarray:
        return np.stack([(~np.isnan(m)).sum(0), np.nansum(m, 0)], 1)

    n, s = _total(x, d, 2, firsts).T
    mean = s / np.maximum(n, 1)
    squares = _total(x, d, 1, lambda m: np.nansum((m - mean) ** 2, 0)[:, None])[:, 0]
    return Centre(n, mean, np.sqrt(squares / np.maximum(n, 1)))


def covariance_bands(df: DataFrame, columns: Sequence[str], task_bytes: int = TASK_BYTES) -> DataFrame:
    """Pairwise-complete sample covariances and correlations of all columns: (i, j, cov, r) with i <= j.

    Each pass makes as many rows of the matrix as fit into `task_bytes`, so d columns need about
    d * d * 24 / task_bytes passes over the table and no shuffle of it. Pairs with fewer than two common rows
    have a null covariance; a column without spread among them has a null correlation.
    """
    spark, d = df.sparkSession, len(columns)
    schema = "i int, j int, cov double, r double"
    if d == 0:
        return rows_frame(spark, [], schema)
    x = packed(df, columns)
    shift = centre(x, d).mean
    path = scratch_path(spark, "covariance")
    first = 0
    while first < d:
        band = max(1, min(d - first, task_bytes // (48 * (d - first))))
        _band(x, shift, first, band, d).write.mode("append").parquet(path)
        first += band
    return spark.read.schema(schema).parquet(path)


def _band(x: DataFrame, shift: np.ndarray, first: int, band: int, d: int) -> DataFrame:
    rest = d - first

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, band, rest))
        for batch in batches:
            right = _matrix(batch, d)[:, first:] - shift[first:]
            seen = (~np.isnan(right)).astype(float)
            right = np.where(seen > 0, right, 0.0)
            left, there = right[:, :band].T, seen[:, :band].T
            for at, (a, b) in enumerate(
                [(there, seen), (left, seen), (there, right), (left, right), (left * left, seen), (there, right * right)]
            ):
                sums[at] += a @ b
        for i in range(band):
            yield _row("i", first + i, sums[:, i, i:])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, v in zip(batch.column("i").to_pylist(), batch.column("v"), strict=True):
                n, s, t, xy, xx, yy = v.values.to_numpy(zero_copy_only=False).reshape(6, -1)
                with np.errstate(all="ignore"):
                    cov = (xy - s * t / n) / (n - 1)
                    left, right = (xx - s * s / n) / (n - 1), (yy - t * t / n) / (n - 1)
                    left[left <= 1e-15 * xx / n] = 0.0
                    right[right <= 1e-15 * yy / n] = 0.0
                    r = np.clip(cov / np.sqrt(left * right), -1.0, 1.0)
                cov[n < 2] = np.nan
                r[(n < 2) | (left <= 0) | (right <= 0)] = np.nan
                j = np.arange(i, d, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(j), i, dtype=np.int32)), pa.array(j), pa.array(cov, from_pandas=True), pa.array(r, from_pandas=True)],
                    ["i", "j", "cov", "r"],
                )

    partials = _few_tasks(x).mapInArrow(partial, "i int, v array<double>")
    return _added(partials, "i", min(band, 64)).mapInArrow(finish, "i int, j int, cov double, r double")


def named_pairs(bands: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bands with the names of both columns: (a, b, cov, r)."""
    # one row per column of the table
    names = F.broadcast(rows_frame(bands.sparkSession, list(enumerate(columns)), "k int, name string"))
    left = names.select(F.col("k").alias("i"), F.col("name").alias("a"))
    right = names.select(F.col("k").alias("j"), F.col("name").alias("b"))
    return bands.join(F.broadcast(left), "i").join(F.broadcast(right), "j").select("a", "b", "cov", "r")


@dataclass(frozen=True)
class Components:
    """Leading eigenvalues, unit vectors in columns, and the largest residual relative to the first eigenvalue."""

    values: np.ndarray
    vectors: np.ndarray
    residual: float
    passes: int


def leading_components(
    x: DataFrame, d: int, count: int, shift: np.ndarray, scale: np.ndarray, rows: int,
    tolerance: float = 1e-9, limit: int = 100, seed: int = 7,
) -> Components:
    """Largest eigenvalues and vectors of the covariance of (x - shift) / scale, missing values at the mean.

    Block Lanczos with full orthogonalisation, restarted from the best vectors when the basis is long. The driver
    holds d x 24 * (count + 4) numbers at most. Stops when all residuals are below `tolerance` or the basis is complete;
    raises RuntimeError after `limit` passes, with the residual that is left.
    """
    count = min(count, d)
    width = min(d, count + 4)
    if count == 0 or rows < 2:
        return Components(np.zeros(count), np.eye(d)[:, :count], 0.0, 0)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    basis = image = np.zeros((d, 0))
    for turn in range(1, limit + 1):
        made = _product(x, d, block, shift, scale) / (rows - 1)
        basis, image = np.hstack([basis, block]), np.hstack([image, made])
        inner = basis.T @ image
        theta, u = np.linalg.eigh((inner + inner.T) / 2)
        theta, u = theta[::-1], u[:, ::-1]
        ritz, moved = basis @ u, image @ u
        gaps = np.linalg.norm(moved[:, :count] - ritz[:, :count] * theta[:count], axis=0)
        residual = float(gaps.max() / max(abs(theta[0]), 1e-300))
        rest = made - basis @ (basis.T @ made)
        if basis.shape[1] + width > 24 * width:
            basis, image = ritz[:, : 2 * width], moved[:, : 2 * width]
            rest = image[:, :width] - basis[:, :width] * theta[:width]
        rest -= basis @ (basis.T @ rest)
        left, size, _ = np.linalg.svd(rest, full_matrices=False)
        block = left[:, size > 1e-12 * max(abs(theta[0]), 1e-300)]
        # the SVD's vectors of tiny sizes lean into the basis again
        block = block - basis @ (basis.T @ block)
        block = np.linalg.qr(block)[0][:, : d - basis.shape[1]]
        if residual <= tolerance or block.shape[1] == 0:
            return Components(np.maximum(theta[:count], 0.0), ritz[:, :count], residual, turn)
    raise RuntimeError(f"{count} components not found in {limit} passes: residual {residual:.1e}, tolerance {tolerance:.1e}")


def _product(x: DataFrame, d: int, block: np.ndarray, shift: np.ndarray, scale: np.ndarray) -> np.ndarray:
    def part(m: np.ndarray) -> np.ndarray:
        z = np.nan_to_num((m - shift) / scale)
        return z.T @ (z @ block)

    return _total(x, d, block.shape[1], part)
