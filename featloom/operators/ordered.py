"""Operators that follow a row order: fills and the cosine transform."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featloom.core import checkpointed, clean, col
from featloom.functions.ordering import SMALL_ROWS, range_tagged


def forward_fill(
    df: DataFrame, column: str, order_by: Sequence[str], partition_by: Sequence[str] = (), limit: int = SMALL_ROWS
) -> DataFrame:
    """Last valid value in order, within each group."""
    return _fill(df, column, order_by, partition_by, False, limit)


def backward_fill(
    df: DataFrame, column: str, order_by: Sequence[str], partition_by: Sequence[str] = (), limit: int = SMALL_ROWS
) -> DataFrame:
    """Next valid value in order, within each group."""
    return _fill(df, column, order_by, partition_by, True, limit)


def _fill(
    df: DataFrame, column: str, order_by: Sequence[str], groups: Sequence[str], backward: bool, limit: int
) -> DataFrame:
    """A group larger than a range partition is filled range by range.

    Ranges of (group, order) are contiguous, so each needs only the last valid
    value before it: one row per group and range is carried over.
    """
    value = col(column)
    groups = list(groups)
    ahead, behind = [col(o).asc() for o in order_by], [col(o).desc() for o in order_by]
    order, flipped = (behind, ahead) if backward else (ahead, behind)
    tagged, parts = range_tagged(df, [*[col(g) for g in groups], *order], limit=limit)
    names = [c if c != column else None for c in df.columns]
    upto = (Window.unboundedPreceding, 0)
    if parts == 1:
        w = Window.partitionBy(*[col(g) for g in groups]).orderBy(*order).rowsBetween(*upto)
        filled = F.last(value, ignorenulls=True).over(w)
        return df.select(*[col(c) if c else filled.alias(column) for c in names])
    w = Window.partitionBy(*[col(g) for g in groups], "_part").orderBy(*order)
    last = F.last(value, ignorenulls=True).over(w.rowsBetween(*upto))
    end = F.row_number().over(Window.partitionBy(*[col(g) for g in groups], "_part").orderBy(*flipped))
    local = tagged.withColumn("_last", last)
    # last valid value of each (group, range)
    ends = local.withColumn("_end", end).where("_end = 1").select(*[col(g) for g in groups], "_part", "_last")
    before = Window.partitionBy(*[col(g) for g in groups]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *[col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col("_part").alias("_p"),
        F.last("_last", ignorenulls=True).over(before).alias("_carry"),
    )
    match = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        match = match & col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = local.join(carried, match, "left")
    filled = F.coalesce("_last", "_carry").alias(column)
    return joined.select(*[col(c) if c else filled for c in names])


# ------------------------------------------------------ cosine transform
def discrete_cosine(
    df: DataFrame, column: str, order_by: Sequence[str], partition_by: Sequence[str] = (), series_limit: int = 1_000_000
) -> DataFrame:
    """Unnormalised DCT-II of each ordered series: 2 * sum x_n cos(pi k (2n+1) / 2N).

    Row k of a series receives coefficient k. Series up to `series_limit` rows
    are transformed within a task; a longer one is spread over tasks by
    splitting its Fourier transform into short row and column transforms.
    """
    groups = list(partition_by)
    keys = [f"_g{i}" for i in range(len(groups))]
    base = df.select("*", *[col(g).cast("string").alias(k) for g, k in zip(groups, keys, strict=True)])
    sizes = base.groupBy(*keys).agg(F.count("*").alias("_size"))
    longest = sizes.agg(F.max("_size").alias("m")).first()["m"] or 0
    if longest <= series_limit:
        return _short_series(df, column, order_by, groups)
    # at most rows / series_limit series are long
    long_keys = sizes.where(F.col("_size") > series_limit).select(*keys, "_size").collect()
    out = None
    in_long = F.lit(False)
    for r in long_keys:
        here = F.lit(True)
        for g, k in zip(groups, keys, strict=True):
            here = here & col(g).cast("string").eqNullSafe(F.lit(r[k]))
        in_long = in_long | here
        part = _long_series(df.where(here), column, order_by, r["_size"])
        out = part if out is None else out.unionByName(part)
    rest = df.where(~in_long)
    return _short_series(rest, column, order_by, groups).unionByName(out)


def _dct(x: np.ndarray) -> np.ndarray:
    """DCT-II by one FFT of the even-odd reordered series."""
    n = len(x)
    v = np.concatenate([x[::2], x[1::2][::-1]])
    return 2 * np.real(np.fft.fft(v) * np.exp(-1j * np.pi * np.arange(n) / (2 * n)))


def _short_series(df: DataFrame, column: str, order_by: Sequence[str], groups: list[str]) -> DataFrame:
    order = list(order_by)
    schema = ", ".join(
        f"`{f.name}` {'double' if f.name == column else f.dataType.simpleString()}" for f in df.schema.fields
    )

    def transform(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="mergesort")
        pdf[column] = _dct(pdf[column].to_numpy(dtype=float))
        return pdf

    return df.groupBy(*groups).applyInPandas(transform, schema)


def _long_series(df: DataFrame, column: str, order_by: Sequence[str], n: int) -> DataFrame:
    """Distributed DCT of one long series.

    The chirp form turns a Fourier transform of any length into a circular
    convolution of length m = rows * cols >= 2n - 1; each of its transforms is
    two groups-of-sqrt(m) steps, so no task sees more than sqrt(m) values.
    """
    from featloom.functions.ordering import global_row_number

    bits = math.ceil(math.log2(2 * n - 1))
    rows, cols = 1 << (bits // 2), 1 << (bits - bits // 2)
    m = rows * cols
    numbered = checkpointed(global_row_number(df, [col(o) for o in order_by], "_n").withColumn("_n", F.col("_n") - 1))
    x = numbered.select(F.col("_n").alias("t"), clean(col(column)).alias("re"))
    # even positions first, odd positions reversed at the end
    place = F.when(F.col("t") % 2 == 0, F.col("t") / 2).otherwise(F.lit(n) - 1 - F.floor(F.col("t") / 2)).cast("long")
    signal = _chirped(x.select(place.alias("t"), "re", F.lit(0.0).alias("im")), n, -1.0)
    spark = df.sparkSession
    lags = spark.range(0, m).select(
        F.col("id").alias("t"),
        F.when(F.col("id") < n, F.col("id")).when(F.col("id") > m - n, F.lit(m) - F.col("id")).alias("lag"),
    ).where("lag is not null")
    angle = _chirp_angle(F.col("lag"), n)
    kernel = lags.select("t", F.cos(angle).alias("re"), F.sin(angle).alias("im"))
    a, b = _fft(signal, rows, cols, False), _fft(kernel, rows, cols, False)
    product = a.join(b.select("t", F.col("re").alias("br"), F.col("im").alias("bi")), "t").select(
        "t", (F.col("re") * F.col("br") - F.col("im") * F.col("bi")).alias("re"), (F.col("re") * F.col("bi") + F.col("im") * F.col("br")).alias("im")
    )
    back = _fft(product, rows, cols, True).where(F.col("t") < n)
    spectrum = _chirped(back, n, -1.0)
    turn = -F.lit(math.pi) * F.col("t") / F.lit(2.0 * n)
    coefficient = 2 * (F.col("re") * F.cos(turn) - F.col("im") * F.sin(turn))
    result = spectrum.select(F.col("t").alias("_n"), coefficient.alias("_dct"))
    joined = numbered.join(result, "_n", "left")
    return joined.select(*[F.col("_dct").alias(c) if c == column else col(c) for c in df.columns])


def _chirp_angle(t: Column, n: int) -> Column:
    # t*t is reduced modulo 2n before it is scaled, to keep the angle exact
    return F.lit(math.pi) * ((t.cast("decimal(19,0)") * t.cast("decimal(19,0)")) % F.lit(2 * n)).cast("double") / F.lit(float(n))


def _chirped(df: DataFrame, n: int, sign: float) -> DataFrame:
    angle = F.lit(sign) * _chirp_angle(F.col("t"), n)
    re, im = F.col("re"), F.col("im")
    return df.select("t", (re * F.cos(angle) - im * F.sin(angle)).alias("re"), (re * F.sin(angle) + im * F.cos(angle)).alias("im"))


def _fft(df: DataFrame, rows: int, cols: int, inverse: bool) -> DataFrame:
    """Fourier transform of length rows * cols as short transforms by column, then by row."""
    m = rows * cols
    step = "a long, b long, re double, im double"

    def column_pass(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["b"].iloc[0])
        v = np.zeros(rows, dtype=complex)
        v[pdf["a"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        v = np.fft.ifft(v) * rows if inverse else np.fft.fft(v)
        k = np.arange(rows)
        v = v * np.exp((2j if inverse else -2j) * np.pi * ((k * b) % m) / m)
        return pd.DataFrame({"a": k, "b": b, "re": v.real, "im": v.imag})

    def row_pass(pdf: pd.DataFrame) -> pd.DataFrame:
        a = int(pdf["a"].iloc[0])
        v = np.zeros(cols, dtype=complex)
        v[pdf["b"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        v = np.fft.ifft(v) * cols / m if inverse else np.fft.fft(v)
        return pd.DataFrame({"a": a, "b": np.arange(cols), "re": v.real, "im": v.imag})

    placed = df.select(F.floor(F.col("t") / cols).cast("long").alias("a"), (F.col("t") % cols).alias("b"), "re", "im")
    turned = placed.groupBy("b").applyInPandas(column_pass, step)
    done = turned.groupBy("a").applyInPandas(row_pass, step)
    return done.select((F.col("b") * rows + F.col("a")).alias("t"), "re", "im")


