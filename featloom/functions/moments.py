"""Moments of a column that can be merged from group to group.

A moment column is a struct: n (values), total, lo, hi, and where they are asked for m2 and m3, the sums of squares and
cubes around the mean. Groups are merged around the mean of the merged group, never through sums of raw powers, so the
result is as stable as that of one pass over the rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featloom.core import checkpointed, clean, col

_SQUARES = {"std", "skew"}


def moments(c: Column, primitives: Iterable[str]) -> Column:
    """Aggregate of a numeric or boolean column with what the primitives need."""
    wanted = set(primitives)
    x = clean(c.cast("int") if wanted == {"percent_true"} else c)
    parts = [F.count(x).alias("n"), F.sum(x).alias("total"), F.min(x).alias("lo"), F.max(x).alias("hi")]
    if wanted & _SQUARES:
        squares = F.var_pop(x) * F.count(x)
        parts.append(squares.alias("m2"))
        if "skew" in wanted:
            # Undefined without spread, where the sum of cubes is zero.
            parts.append(F.when(squares > 0, F.skewness(x) * squares * F.sqrt(squares) / F.sqrt(F.count(x))).otherwise(0.0).alias("m3"))
    return F.struct(*parts)


def _moment_columns(df: DataFrame) -> dict[str, set[str]]:
    return {f.name: set(f.dataType.names) for f in df.schema.fields if isinstance(f.dataType, T.StructType) and {"n", "total", "lo", "hi"} <= set(f.dataType.names)}


def merged(groups: DataFrame, key: str) -> DataFrame:
    """Groups with the same key as one: moment columns are merged, `_rows` is summed.

    Sums, counts and extremes need one grouping. Squares and cubes need the mean of the merged group first; the groups,
    not the rows they came from, are joined with it on the key they are grouped by.
    """
    found = _moment_columns(groups)
    squares = {c: names for c, names in found.items() if "m2" in names}
    if squares:
        # Read twice below: the rows behind the groups are not grouped again.
        groups = checkpointed(groups)
    base = [F.sum("_rows").alias("_rows")]
    for c in found:
        m = col(c)
        base.append(F.struct(F.sum(m["n"]).alias("n"), F.sum(m["total"]).alias("total"), F.min(m["lo"]).alias("lo"), F.max(m["hi"]).alias("hi")).alias(c))
    whole = groups.groupBy(col(key)).agg(*base)
    if not squares:
        return whole
    means = whole.select(col(key), *[F.try_divide(col(c)["total"], col(c)["n"]).alias(f"_mean_{c}") for c in squares])
    parts = []
    for c, names in squares.items():
        m = col(c)
        n, m2, gap = m["n"], F.coalesce(m["m2"], F.lit(0.0)), F.try_divide(m["total"], m["n"]) - col(f"_mean_{c}")
        around = [F.sum(m2 + n * gap * gap).alias("m2")]
        if "m3" in names:
            around.append(F.sum(F.coalesce(m["m3"], F.lit(0.0)) + 3 * gap * m2 + n * gap * gap * gap).alias("m3"))
        parts.append(F.struct(*around).alias(f"_around_{c}"))
    spread = groups.join(means, key).groupBy(col(key)).agg(*parts)
    joined = whole.join(spread, key)
    out = []
    for c, names in found.items():
        m = col(c)
        fields = [m[x].alias(x) for x in ("n", "total", "lo", "hi")] + [col(f"_around_{c}")[x].alias(x) for x in ("m2", "m3") if x in names]
        out.append(F.struct(*fields).alias(c))
    return joined.select(col(key), "_rows", *out)


def finished(primitive: str, m: Column) -> Column:
    """The value of a primitive from merged moments; null where a group holds too few values."""
    n = m["n"]
    match primitive:
        case "sum":
            return F.coalesce(m["total"], F.lit(0.0))
        case "mean":
            return F.try_divide(m["total"], n)
        case "min":
            return m["lo"]
        case "max":
            return m["hi"]
        case "percent_true":
            return F.coalesce(F.try_divide(m["total"], n), F.lit(0.0))
        case "std":
            return F.when(n >= 2, F.sqrt(m["m2"] / (n - 1)))
        case "skew":
            biased = F.when((m["lo"] < m["hi"]) & (m["m2"] > 0), F.sqrt(n) * m["m3"] / (m["m2"] * F.sqrt(m["m2"]))).otherwise(0.0)
            return F.when(n >= 3, biased * F.sqrt(n * (n - 1.0)) / (n - 2))
    raise ValueError(f"not a primitive of moments: {primitive}")
