"""Column typing, column statistics and table measures in few Spark jobs.

`TableProfile` runs each job lazily and once: one wide aggregate, one pass for
quartile-based facts, one `unpivot -> groupBy` for all value counts and one
Gram job. Only per-column scalars reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featloom.core import (
    CATEGORICAL,
    DATETIME,
    NUMERIC,
    clean,
    col,
    is_datetime,
    is_numeric,
    nan_to_null,
    numeric_columns,
    rows_frame,
)
from featloom.functions.columns import entropy_term
from featloom.functions.ordering import SMALL_ROWS, order_statistics, quantiles
from featloom.operators.gram import NARROW, class_grams, gram
from featloom.operators.wide import covariance_bands, named_pairs
from featloom.sources.registry import type_label

# fixed values: the datetime formats tried on text columns, in order
DATETIME_FORMATS = [
    "yyyy-M-d",
    "d/M/yyyy",
    "M/d/yyyy",
    "yyyy/M/d",
    "yyyy-M-d H:m:s",
    "yyyy-M-d'T'H:m:s",
    "d-M-yyyy",
    "M-d-yyyy",
    "yyyyMMdd",
    "ddMMyyyy",
    "MMddyyyy",
    "H:m:s",
    "H:m",
    "yyyy-M-d H:m:s.SSSSSS",
]
_DATE_SHAPE = r"^[0-9]{1,4}[-/:]?[0-9]{1,2}[-/:T0-9 .]*$"


# --------------------------------------------------------------- typing
def _parsed(c: Column, fmt: str) -> Column:
    return F.try_to_timestamp(c, F.lit(fmt))


def column_types(
    df: DataFrame,
    overrides: dict[str, str] | None = None,
    formats: Sequence[str] = tuple(DATETIME_FORMATS),
    threshold: float = 0.80,
) -> dict[str, str]:
    """Family of every column from its type and one aggregate over all rows.

    Text is DATETIME when at most 20% is missing and more than `threshold` of
    the values parse, as ISO text or by one single format. Numeric columns
    whose values are exactly {0, 1} are CATEGORICAL.
    """
    overrides = overrides or {}
    families: dict[str, str] = {}
    aggs = [F.count("*").alias("rows")]
    texts, numbers = [], []
    for i, f in enumerate(df.schema.fields):
        c = col(f.name)
        if f.name in overrides:
            families[f.name] = overrides[f.name]
        elif is_datetime(f.dataType):
            families[f.name] = DATETIME
        elif is_numeric(f.dataType):
            families[f.name] = NUMERIC
        elif isinstance(f.dataType, T.StringType):
            families[f.name] = CATEGORICAL
            texts.append((i, f.name))
            # the shape test keeps the format attempts away from ordinary text
            shaped = F.when(c.rlike(_DATE_SHAPE), c)
            aggs.append(F.count(c).alias(f"n{i}"))
            aggs.append(F.count(shaped.try_cast("timestamp")).alias(f"iso{i}"))
            aggs += [F.count(_parsed(shaped, fmt)).alias(f"f{i}_{j}") for j, fmt in enumerate(formats)]
        else:
            families[f.name] = CATEGORICAL
        if families[f.name] == NUMERIC and is_numeric(f.dataType):
            numbers.append((i, f.name))
            v = clean(c)
            aggs += [
                F.coalesce(F.bool_and((v == 0) | (v == 1)), F.lit(False)).alias(f"bin{i}"),
                (F.coalesce(F.bool_or(v == 0), F.lit(False)) & F.coalesce(F.bool_or(v == 1), F.lit(False))).alias(f"both{i}"),
            ]
    if texts or numbers:
        got = df.agg(*aggs).first()
        for i, name in texts:
            n, rows = got[f"n{i}"], got["rows"]
            if not n or 1 - n / rows > 1 - threshold:
                continue
            best = max([got[f"iso{i}"], *[got[f"f{i}_{j}"] for j in range(len(formats))]])
            if best / n > threshold:
                families[name] = DATETIME
        for i, name in numbers:
            if got[f"bin{i}"] and got[f"both{i}"]:
                families[name] = CATEGORICAL
    return {c: families[c] for c in df.columns}


def column_types_frame(df: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    types = column_types(df, overrides)
    return rows_frame(df.sparkSession, [(i, c, t) for i, (c, t) in enumerate(types.items())], "position int, name string, family string")


def columns_of_type(df: DataFrame, family: str) -> list[str]:
    return [c for c, t in column_types(df).items() if t == family]


def convert_datetimes(
    df: DataFrame, columns: Sequence[str] | None = None, formats: Sequence[str] = tuple(DATETIME_FORMATS)
) -> DataFrame:
    """Cast datetime text columns to timestamps; bad values become NULL."""
    if columns is None:
        columns = columns_of_type(df, DATETIME)
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if f.name in columns and isinstance(f.dataType, T.StringType):
            c = F.coalesce(c.try_cast("timestamp"), *[_parsed(c, fmt) for fmt in formats]).alias(f.name)
        out.append(c)
    return df.select(out)


def narrow_types(df: DataFrame) -> DataFrame:
    """Smallest signed integer type that fits; float when it loses < 1e-7 relative."""
    fields = [f for f in df.schema.fields if is_numeric(f.dataType)]
    aggs = []
    for i, f in enumerate(fields):
        c = col(f.name)
        if isinstance(f.dataType, T.IntegralType):
            aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
        else:
            # double -> float text keeps the exact value, so this measures the loss
            v = clean(c)
            loss = F.abs(v - v.cast("float").cast("double")) <= F.lit(1e-8) + F.lit(1e-7) * F.abs(v.cast("float").cast("double"))
            aggs.append(F.bool_and(loss).alias(f"ok{i}"))
    got = df.agg(*aggs).first() if aggs else None
    casts = {}
    for i, f in enumerate(fields):
        if isinstance(f.dataType, T.IntegralType):
            lo, hi = got[f"lo{i}"], got[f"hi{i}"]
            casts[f.name] = "bigint" if lo is None else next(
                t for t, bits in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if -(2**bits) <= lo and hi < 2**bits
            )
        else:
            casts[f.name] = "float" if got[f"ok{i}"] else "double"
    return df.select(*[col(c).cast(casts[c]).alias(c) if c in casts else col(c) for c in df.columns])


# --------------------------------------------------------- column statistics
def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(column, value, *by, count) of non-null values, combined map-side."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns])
    long = df.select(*[col(b) for b in by], F.explode(pairs).alias("_x"))
    grouped = long.where(F.col("_x.value").isNotNull()).groupBy(
        F.col("_x.column").alias("column"), F.col("_x.value").alias("value"), *[col(b) for b in by]
    )
    return grouped.count()


def two_valued(df: DataFrame, columns: Sequence[str]) -> int:
    """How many columns hold exactly two values: the smallest, the largest and nothing else. Two aggregates, no shuffle of values."""
    frame = nan_to_null(df)
    cells = [F.when(col(c).isNotNull(), col(c)).cast("string") for c in columns]
    ends = frame.agg(*[F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias(f"x{i}") for i, x in enumerate(cells)]).first() if columns else []
    open_ = {i: e for i, e in enumerate(ends) if e["lo"] is not None and e["lo"] != e["hi"]}
    if not open_:
        return 0
    inside = frame.agg(*[F.bool_and(cells[i].isin(e["lo"], e["hi"])) for i, e in open_.items()]).first()
    return sum(bool(x) for x in inside)


def cardinality(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct non-null values per column."""
    columns = list(columns or df.columns)
    spark = df.sparkSession
    if approx:
        got = df.agg(*[F.approx_count_distinct(col(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
        return rows_frame(spark, [(c, got[i]) for i, c in enumerate(columns)], "column string, unique_values long")
    counted = value_counts(nan_to_null(df), columns).groupBy("column").agg(F.count("*").alias("unique_values"))
    names = rows_frame(spark, [(c,) for c in columns], "column string")
    return names.join(counted, "column", "left").select(
        "column", F.coalesce("unique_values", F.lit(0)).alias("unique_values")
    )


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """The k most frequent values per column; ties by value."""
    counts = value_counts(df, columns)
    w = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def column_stats(df: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """One row per column: type, cardinality, missing share and type-specific facts."""
    families = column_types(df, overrides)
    clean_df = nan_to_null(df)
    fields = {f.name: f.dataType for f in clean_df.schema.fields}
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count(col(c)).alias(f"n{i}"))
        if is_numeric(fields[c]) and families[c] == NUMERIC:
            v = clean(col(c))
            aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}")]
        if is_datetime(fields[c]):
            aggs += [F.min(col(c)).cast("string").alias(f"lo{i}"), F.max(col(c)).cast("string").alias(f"hi{i}")]
            aggs.append(
                F.floor(F.unix_seconds(F.max(col(c)).cast("timestamp")) / 86400 - F.unix_seconds(F.min(col(c)).cast("timestamp")) / 86400).alias(f"d{i}")
            )
    got = clean_df.agg(*aggs).first()
    rows = []
    for i, c in enumerate(df.columns):
        missing = got["rows"] - got[f"n{i}"]
        numeric = families[c] == NUMERIC and is_numeric(fields[c])
        dated = is_datetime(fields[c])
        rows.append(
            (
                i,
                c,
                families[c],
                type_label(fields[c]),
                missing,
                missing / got["rows"] * 100 if got["rows"] else None,
                got[f"lo{i}"] if numeric else None,
                got[f"hi{i}"] if numeric else None,
                got[f"m{i}"] if numeric else None,
                got[f"s{i}"] if numeric else None,
                got[f"lo{i}"] if dated else None,
                got[f"hi{i}"] if dated else None,
                got[f"d{i}"] if dated else None,
            )
        )
    base = rows_frame(
        df.sparkSession,
        rows,
        "position int, column string, type string, dtype string, missing_count long, missing_percent double, "
        "min double, max double, mean double, std double, min_date string, max_date string, range_days long",
    )
    distinct = cardinality(df)
    cats = [c for c in df.columns if families[c] == CATEGORICAL]
    out = base.join(distinct, "column", "left")
    if not cats:
        return out.withColumn("top_values", F.lit(None).cast("map<string,bigint>"))
    pair = F.struct("rank", "value", "count")
    tops = top_values(clean_df, cats).groupBy("column").agg(F.sort_array(F.collect_list(pair)).alias("_t"))
    tops = tops.select(
        "column",
        F.map_from_entries(F.transform("_t", lambda x: F.struct(x["value"], x["count"]))).alias("top_values"),
    )
    return out.join(tops, "column", "left")


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Counts and shares of the non-null target values."""
    counts = df.where(col(target).isNotNull()).groupBy(col(target).cast("string").alias("class")).count()
    total = df.agg(F.count(col(target)).alias("n")).first()["n"]
    return counts.select("class", "count", (F.col("count") / F.lit(total)).alias("share"))


def profile_document(df: DataFrame, target: str | None = None, measures_too: bool = True) -> DataFrame:
    """One-row profile: basic info, column types, target analysis, measures."""
    families = column_types(df)
    spark = df.sparkSession
    rows = df.count()

    def named(kind: str) -> list[str]:
        return [c for c, t in families.items() if t == kind]

    kind = families.get(target) if target else None
    # one entry per class of the target
    shares = (
        [tuple(r) for r in class_distribution(df, target).select("class", "count", "share").orderBy("class").collect()]
        if kind == CATEGORICAL
        else None
    )
    doc = rows_frame(
        spark,
        [(rows, len(df.columns), df.columns, named(NUMERIC), named(CATEGORICAL), named(DATETIME), target, kind, shares)],
        "rows long, columns int, column_names array<string>, numeric array<string>, categorical array<string>, "
        "datetime array<string>, target string, target_type string, "
        "class_distribution array<struct<class: string, count: long, share: double>>",
    )
    if measures_too:
        scalars = [(n, c, v) for n, c, v in TableProfile(df, target).rows()]
        doc = doc.withColumn(
            "meta_features",
            F.array(*[F.struct(F.lit(n).alias("measure"), F.lit(c).cast("string").alias("column"), F.lit(v).cast("double").alias("value")) for n, c, v in scalars]),
        )
    return doc


def compact_metadata(df: DataFrame, target: str | None = None, dtype: bool = False) -> DataFrame:
    """JSON document of row count, column types and missing rates; no raw values."""
    got = nan_to_null(df).agg(
        F.count("*").alias("rows"), *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]
    ).first()
    rows = got["rows"]
    families = {f.name: type_label(f.dataType) for f in df.schema.fields} if dtype else {
        c: t.upper() for c, t in column_types(df).items()
    }
    entries = [
        (c, families[c], round((rows - got[f"n{i}"]) / rows, 6) if rows else None) for i, c in enumerate(df.columns)
    ]
    frame = rows_frame(
        df.sparkSession,
        [(rows, entries, target)],
        f"rows long, columns array<struct<name: string, {'dtype' if dtype else 'type'}: string, missing_rate: double>>, target string",
    )
    return frame.select(F.to_json(F.struct("rows", "columns", "target")).alias("metadata"))


# -------------------------------------------------------------- measures
# fixed values: measure names, simple / statistical / information-theoretic
SIMPLE = [
    "ATTR_TO_INST", "INST_TO_ATTR", "CAT_TO_NUM", "NUM_TO_CAT", "CLASS_TO_ATTR", "INST_TO_CLASS", "FREQ_CLASS",
    "NR_ATTR", "NR_ATTR_MISSING", "NR_BIN", "NR_CAT", "NR_CLASS", "NR_INST", "NR_INST_MISSING", "NR_MISSING", "NR_NUM",
]
STATISTICAL = [
    "CAN_COR", "COR", "COV", "NR_DISC", "EIGHENVALUES", "G_MEAN", "H_MEAN", "IQR", "KURTOSIS", "MAD", "MAX", "MEAN",
    "MEDIAN", "MIN", "NR_COR_ATTR", "NR_NORM", "NR_OUTLIERS", "RANGE", "SD", "SD_RATIO", "SKEWNESS", "T_MEAN", "VAR",
    "W_LAMBDA",
]
INFORMATION = ["ATTR_ENT", "CLASS_ENT", "EQ_NUM_ATTR", "JOINT_ENT", "MUT_INF", "NS_RATIO"]
NEEDS_TARGET = {
    "CLASS_TO_ATTR", "INST_TO_CLASS", "FREQ_CLASS", "NR_CLASS", "CAN_COR", "NR_DISC", "SD_RATIO", "W_LAMBDA",
    "CLASS_ENT", "EQ_NUM_ATTR", "JOINT_ENT", "MUT_INF", "NS_RATIO",
}

Row3 = tuple[str, str | None, float | None]


def normal_test_p(n: int, skew: float, excess_kurtosis: float) -> float:
    """p-value of the D'Agostino-Pearson omnibus test from moments (n > 8)."""
    y = skew * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (beta2 - 1))
    delta = 1 / math.sqrt(0.5 * math.log(w2))
    alpha = math.sqrt(2.0 / (w2 - 1))
    z1 = delta * math.asinh(y / alpha)
    expected = 3.0 * (n - 1) / (n + 1)
    variance = 24.0 * n * (n - 2) * (n - 3) / ((n + 1.0) ** 2 * (n + 3) * (n + 5))
    x = (excess_kurtosis + 3 - expected) / math.sqrt(variance)
    root_beta = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / root_beta * (2.0 / root_beta + math.sqrt(1 + 4.0 / root_beta**2))
    base = (1 - 2.0 / a) / (1 + x * math.sqrt(2.0 / (a - 4.0)))
    term = math.copysign(abs(base) ** (1 / 3.0), base)
    z2 = (1 - 2.0 / (9.0 * a) - term) / math.sqrt(2.0 / (9.0 * a))
    return math.exp(-(z1 * z1 + z2 * z2) / 2)


@dataclass(frozen=True)
class Measure:
    """A measure as partial aggregates and a value made of their results."""

    over: str
    aggregates: Callable[..., dict[str, Column]]
    value: Callable[[dict], float | None]


DECLARED: dict[str, Measure] = {}


def register_measure(name: str, aggregates: Callable[..., dict[str, Column]], value: Callable[[dict], float | None], over: str = NUMERIC) -> None:
    """Add a measure that any request may name.

    `aggregates` gives named aggregates of one column ("numeric" or "categorical") or, over "table", of a dict of all
    columns; `value` gets their results by name. The aggregates of all measures of a request run in one pass. Names of
    the built-in measures are refused; registering one's own name again replaces the measure.
    """
    if name in [*SIMPLE, *STATISTICAL, *INFORMATION]:
        raise ValueError(f"{name} is a built-in measure")
    if over not in (NUMERIC, CATEGORICAL, "table"):
        raise ValueError(f"a measure is over numeric or categorical columns or the table, not {over}")
    DECLARED[name] = Measure(over, aggregates, value)


class TableProfile:
    """Measures of a table; every job runs once and only when needed."""

    def __init__(
        self, df: DataFrame, target: str | None = None, overrides: dict[str, str] | None = None,
        families: dict[str, str] | None = None, limit: int = SMALL_ROWS,
    ) -> None:
        if target is not None and target not in df.columns:
            raise ValueError(f"target column not found: {target}")
        self.df = nan_to_null(df)
        self.target = target
        self._overrides = overrides
        self._families = families
        self._limit = limit
        self._names: tuple[str, ...] = ()
        self.attributes = [c for c in df.columns if c != target]

    # ---- jobs
    @cached_property
    def families(self) -> dict[str, str]:
        return self._families or column_types(self.df, self._overrides)

    @cached_property
    def num(self) -> list[str]:
        numbers = numeric_columns(self.df)
        return [c for c in self.attributes if self.families[c] == NUMERIC and c in numbers]

    @cached_property
    def cat(self) -> list[str]:
        return [c for c in self.attributes if self.families[c] == CATEGORICAL]

    @cached_property
    def _sums(self) -> dict:
        """The partial aggregates of all chosen measures, in one pass; equal ones are made once."""
        aggs = self._count_aggregates() if _FROM_COUNTS & set(self._names) else {}
        aggs.update(self._moment_aggregates())
        for name in self._names:
            if name in DECLARED:
                aggs.update(self._declared_aggregates(name))
        if not aggs:
            return {}
        got = self.df.agg(*[a.alias(k) for k, a in aggs.items()]).first()
        return dict(zip(aggs, got, strict=True))

    def _declared_aggregates(self, name: str) -> dict[str, Column]:
        measure = DECLARED[name]
        return {f"{name}/{i}/{k}": a for i, (_, v) in enumerate(self._inputs(measure)) for k, a in measure.aggregates(v).items()}

    def _inputs(self, measure: Measure) -> list[tuple[str | None, object]]:
        """What a declared measure is made of: each column of its family, or all of them at once."""
        numbers = {c: clean(col(c)) for c in self.num}
        texts = {c: col(c) for c in self.cat}
        if measure.over == "table":
            return [(None, {**numbers, **texts})]
        return list((numbers if measure.over == NUMERIC else texts).items())

    def _declared(self, name: str) -> list[tuple[str | None, float | None]]:
        measure = DECLARED[name]
        out = []
        for i, (c, v) in enumerate(self._inputs(measure)):
            out.append((c, measure.value({k: self._sums[f"{name}/{i}/{k}"] for k in measure.aggregates(v)})))
        return out

    def _count_aggregates(self) -> dict[str, Column]:
        columns = self.df.columns
        any_null = F.lit(False)
        for c in columns:
            any_null = any_null | col(c).isNull()
        aggs = {"rows": F.count("*"), "null_rows": F.count_if(any_null)}
        return {**aggs, **{f"n{i}": F.count(col(c)) for i, c in enumerate(columns)}}

    @cached_property
    def counts(self) -> dict:
        """Rows, nulls per column and rows with any null."""
        got = self._sums
        if "rows" not in got:
            got = self.df.agg(*[a.alias(k) for k, a in self._count_aggregates().items()]).first().asDict()
        return {
            "rows": got["rows"],
            "null_rows": got["null_rows"],
            "nulls": {c: got["rows"] - got[f"n{i}"] for i, c in enumerate(self.df.columns)},
        }

    def _moment_aggregates(self) -> dict[str, Column]:
        """The moments that the chosen measures need."""

        def made(v: Column) -> dict[str, Column]:
            positive = F.when(v > 0, v)
            return {
                "n": F.count(v), "min": F.min(v), "max": F.max(v), "mean": F.avg(v), "sd": F.stddev_samp(v),
                "var": F.var_samp(v), "skew": F.skewness(v), "kurt": F.kurtosis(v), "log": F.avg(F.ln(positive)),
                "rec": F.sum(1 / positive), "pos": F.count(positive),
            }

        keys = sorted({k for name in self._names for k in _FROM_MOMENTS.get(name, ())})
        return {f"{k}/{i}": made(clean(col(c)))[k] for i, c in enumerate(self.num) for k in keys}

    @cached_property
    def moments(self) -> dict[str, dict]:
        found: dict[str, dict] = {c: {} for c in self.num}
        for key in self._moment_aggregates():
            k, i = key.split("/")
            found[self.num[int(i)]][k] = self._sums[key]
        return found

    @cached_property
    def quartiles(self) -> dict[str, list[float | None]]:
        return quantiles(
            self.df, {c: col(c) for c in self.num}, [0.25, 0.5, 0.75], rows=self.counts["rows"], limit=self._limit
        )

    @cached_property
    def deviations(self) -> dict[str, list[float | None]]:
        spread = {
            c: F.abs(clean(col(c)) - F.lit(self.quartiles[c][1])) for c in self.num if self.quartiles[c][1] is not None
        }
        return quantiles(self.df, spread, [0.5], rows=self.counts["rows"], limit=self._limit)

    @cached_property
    def pairs(self):
        return gram(self.df, self.num)

    @cached_property
    def class_sums(self):
        return class_grams(self.df, self.num, self.target)

    @cached_property
    def n_classes(self) -> int:
        return self.df.select(col(self.target)).distinct().where(col(self.target).isNotNull()).count()

    @cached_property
    def class_counts(self) -> list[tuple[str, int]]:
        rows = class_distribution(self.df, self.target).orderBy("class").collect()
        return [(r["class"], r["count"]) for r in rows]

    @cached_property
    def class_entropy(self) -> float:
        total = self.df.agg(F.count(col(self.target)).alias("n")).first()["n"]
        counts = self.df.where(col(self.target).isNotNull()).groupBy(col(self.target)).count()
        got = counts.agg(F.sum(entropy_term(F.col("count"), F.lit(total))).alias("h")).first()
        return got["h"] or 0.0

    @cached_property
    def entropies(self) -> dict[str, float]:
        """Entropy per string attribute over its non-null rows."""
        if not self.cat:
            return {}
        got = column_entropies(self.df, self.cat).collect()
        found = {r["column"]: r["entropy"] for r in got}
        return {c: found.get(c, 0.0) for c in self.cat}

    @cached_property
    def contingency(self) -> dict[str, dict[str, float]]:
        """Per string attribute: H(attr), H(class), H(joint) over pair-complete rows."""
        if not self.cat:
            return {}
        pairs = self.df.where(col(self.target).isNotNull())
        joint = value_counts(pairs, self.cat, [self.target]).withColumnRenamed("count", "k")
        # three levels of the same counts, each an aggregate of the level before
        total = joint.groupBy("column").agg(F.sum("k").alias("n"))
        n = F.col("n")

        def level(grouped: DataFrame, name: str) -> DataFrame:
            # one total per attribute
            with_n = grouped.join(F.broadcast(total), "column")
            return with_n.groupBy("column").agg(F.sum(entropy_term(F.col("k"), n)).alias(name))

        attr = level(joint.groupBy("column", "value").agg(F.sum("k").alias("k")), "attr")
        cls = level(joint.groupBy("column", col(self.target)).agg(F.sum("k").alias("k")), "cls")
        both = level(joint, "joint")
        rows = attr.join(cls, "column").join(both, "column").collect()
        found = {r["column"]: {"attr": r["attr"], "cls": r["cls"], "joint": r["joint"]} for r in rows}
        empty = {"attr": 0.0, "cls": 0.0, "joint": 0.0}
        return {c: found.get(c, empty) for c in self.cat}

    # ---- rows
    def rows(self, names: Sequence[str] | None = None) -> list[Row3]:
        chosen = list(names) if names is not None else [*SIMPLE, *STATISTICAL, *INFORMATION]
        if not set(chosen) <= set(self._names):
            self._names = tuple(chosen)
            for made in ("_sums", "moments"):
                self.__dict__.pop(made, None)
        out: list[Row3] = []
        for name in chosen:
            if name in NEEDS_TARGET and self.target is None:
                if names is not None:
                    raise ValueError("a target column is required for classification measures")
                out.append((name, None, None))
                continue
            out += [(name, c, None if v is None else float(v)) for c, v in self._measure(name)]
        return out

    def frame(self, names: Sequence[str] | None = None) -> DataFrame:
        """Rows (measure, column, value); the pairs of a table with many columns don't pass the driver."""
        chosen = list(names) if names is not None else [*SIMPLE, *STATISTICAL, *INFORMATION]
        apart = [n for n in chosen if n in _PAIRS] if any(n in _PAIRS for n in chosen) and len(self.num) > NARROW else []
        out = rows_frame(self.df.sparkSession, self.rows([n for n in chosen if n not in apart] if apart else names), "measure string, column string, value double")
        for name in apart:
            value = F.abs(F.col("r" if name == "COR" else "cov"))
            pairs = named_pairs(self.bands.where("i < j"), self.num)
            found = pairs.select(F.lit(name).alias("measure"), F.concat_ws("|", "a", "b").alias("column"), value.alias("value"))
            out = out.unionByName(found.where("value <> 0"))
        return out

    @cached_property
    def bands(self) -> DataFrame:
        return covariance_bands(self.df, self.num)

    def _covariances(self) -> np.ndarray:
        """The whole matrix on the driver, for the spectrum; refused where it doesn't fit."""
        d = len(self.num)
        if d <= NARROW:
            return self.pairs.covariance()
        if d > SPECTRUM:
            raise ValueError(f"all eigenvalues of {d} columns need a matrix of {8 * d * d >> 20} MB; use leading_components")
        out = np.zeros((d, d))
        for r in self.bands.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "cov"))).alias("row")).toLocalIterator():
            cells = np.array([np.nan if c["cov"] is None else c["cov"] for c in r["row"]])
            out[r["i"], r["i"] :] = out[r["i"] :, r["i"]] = cells
        return out

    def _per_column(self, value) -> list[tuple[str | None, float | None]]:
        return [(c, value(c)) for c in self.num] or [(None, 0.0)]

    def _measure(self, name: str) -> list[tuple[str | None, float | None]]:
        num, cat = self.num, self.cat
        d = len(self.attributes)
        one = lambda v: [(None, v)]
        if name in DECLARED:
            return self._declared(name)
        m = self.moments if name in _FROM_MOMENTS else {}
        match name:
            case "ATTR_TO_INST":
                return one(d / self.counts["rows"] if self.counts["rows"] else 0)
            case "INST_TO_ATTR":
                return one(self.counts["rows"] / d if d else 0)
            case "CAT_TO_NUM":
                return one(_ratio_or_inf(len(cat), len(num)))
            case "NUM_TO_CAT":
                return one(_ratio_or_inf(len(num), len(cat)))
            case "CLASS_TO_ATTR":
                return one(self.n_classes / d if d else 0)
            case "INST_TO_CLASS":
                return one(self.counts["rows"] / self.n_classes if self.n_classes else 0)
            case "FREQ_CLASS":
                if self.families[self.target] != CATEGORICAL:
                    return []
                total = sum(k for _, k in self.class_counts)
                return [(c, k / total) for c, k in self.class_counts]
            case "NR_ATTR":
                return one(d)
            case "NR_ATTR_MISSING":
                return one(sum(self.counts["nulls"][c] > 0 for c in self.attributes))
            case "NR_BIN":
                return one(two_valued(self.df, self.attributes))
            case "NR_CAT":
                return one(len(cat))
            case "NR_CLASS":
                return one(self.n_classes)
            case "NR_INST":
                return one(self.counts["rows"])
            case "NR_INST_MISSING":
                return one(self.counts["null_rows"])
            case "NR_MISSING":
                return one(sum(self.counts["nulls"].values()))
            case "NR_NUM":
                return one(len(num))
            case "COR" | "COV":
                got = self.pairs.correlation() if name == "COR" else self.pairs.covariance()
                found = [
                    (f"{a}|{b}", abs(got[i, j]))
                    for i, a in enumerate(num) for j, b in enumerate(num)
                    if i < j and got[i, j] != 0 and not math.isnan(got[i, j])
                ]
                return found if len(num) >= 2 else one(0)
            case "NR_COR_ATTR":
                if len(num) < 2:
                    return one(0)
                if len(num) > NARROW:
                    high = self.bands.where("i < j and abs(r) > 0.8").count()
                    return one(high / (len(num) * (len(num) - 1) // 2))
                got = self.pairs.correlation()
                high = sum(abs(got[i, j]) > 0.8 for i in range(len(num)) for j in range(i + 1, len(num)))
                return one(high / (len(num) * (len(num) - 1) // 2))
            case "EIGHENVALUES":
                if not num:
                    return one(0)
                values = np.linalg.eigvalsh(np.nan_to_num(self._covariances()))[::-1]
                return [(str(i), v) for i, v in enumerate(values) if v >= 0]
            case "CAN_COR":
                roots = self.class_sums.discriminant_roots() if num else []
                return [(str(i), math.sqrt(r / (1 + r))) for i, r in enumerate(roots)] or one(0)
            case "W_LAMBDA":
                roots = self.class_sums.discriminant_roots() if num else []
                return one(min(1.0, max(0.0, math.prod(1 / (1 + r) for r in roots))))
            case "SD_RATIO":
                return one(self.class_sums.spread_ratio() if num else 1.0)
            case "NR_DISC":
                return one(max(0, min(self.n_classes - 1, len(num))))
            case "G_MEAN":
                return self._per_column(lambda c: math.exp(m[c]["log"]) if m[c]["pos"] else 0)
            case "H_MEAN":
                return self._per_column(lambda c: m[c]["pos"] / m[c]["rec"] if m[c]["pos"] else 0)
            case "IQR":
                q = self.quartiles
                return self._per_column(lambda c: q[c][2] - q[c][0] if q[c][0] is not None else 0)
            case "KURTOSIS":
                return self._per_column(lambda c: (m[c]["kurt"] if m[c]["n"] > 3 else 0) or 0)
            case "SKEWNESS":
                return self._per_column(lambda c: (m[c]["skew"] if m[c]["n"] > 2 else 0) or 0)
            case "MAD":
                return self._per_column(lambda c: self.deviations[c][0] if c in self.deviations else 0)
            case "MEDIAN":
                return self._per_column(lambda c: self.quartiles[c][1])
            case "MAX" | "MEAN" | "MIN" | "SD" | "VAR":
                return self._per_column(lambda c: m[c][name.lower()])
            case "RANGE":
                return self._per_column(lambda c: m[c]["max"] - m[c]["min"] if m[c]["n"] else None)
            case "NR_NORM":
                return one(
                    sum(
                        x["n"] > 8 and x["skew"] is not None and normal_test_p(x["n"], x["skew"], x["kurt"]) > 0.05
                        for x in m.values()
                    )
                )
            case "NR_OUTLIERS":
                q = {c: v for c, v in self.quartiles.items() if v[0] is not None}
                flags = [
                    F.coalesce(F.bool_or(outside_iqr(clean(col(c)), v[0], v[2])), F.lit(False)).alias(f"o{i}")
                    for i, (c, v) in enumerate(q.items())
                ]
                return one(sum(self.df.agg(*flags).first()) if flags else 0)
            case "T_MEAN":
                got = trimmed_means(self.df, num, 0.1, self._limit)
                return self._per_column(lambda c: got[c])
            case "ATTR_ENT":
                return list(self.entropies.items()) or one(0)
            case "CLASS_ENT":
                return one(self.class_entropy)
            case "JOINT_ENT":
                return [(c, x["joint"]) for c, x in self.contingency.items()] or one(0)
            case "MUT_INF":
                return [(c, _mutual(x)) for c, x in self.contingency.items()] or one(0)
            case "EQ_NUM_ATTR":
                total = sum(_mutual(x, clip=False) for x in self.contingency.values())
                return one(total / self.class_entropy if self.class_entropy > 0 and cat else 0)
            case "NS_RATIO":
                if not cat or self.class_entropy <= 0:
                    return one(0)
                noise = [(x["joint"] - x["attr"]) / self.class_entropy for x in self.contingency.values()]
                return one(max(0.0, sum(noise) / len(noise)))
        raise ValueError(f"unknown measure: {name}")


# columns up to which all eigenvalues are taken on the driver, from a matrix of 128 MB
SPECTRUM = 4096
_PAIRS = ("COR", "COV")
_FROM_COUNTS = {
    "ATTR_TO_INST", "INST_TO_ATTR", "INST_TO_CLASS", "NR_ATTR_MISSING", "NR_INST", "NR_INST_MISSING", "NR_MISSING",
    "IQR", "MAD", "MEDIAN", "NR_OUTLIERS",
}
# the moments each measure is made of
_FROM_MOMENTS = {
    "G_MEAN": ("log", "pos"),
    "H_MEAN": ("pos", "rec"),
    "KURTOSIS": ("n", "kurt"),
    "SKEWNESS": ("n", "skew"),
    "MAX": ("max",),
    "MEAN": ("mean",),
    "MIN": ("min",),
    "SD": ("sd",),
    "VAR": ("var",),
    "RANGE": ("n", "min", "max"),
    "NR_NORM": ("n", "skew", "kurt"),
}


def _ratio_or_inf(a: int, b: int) -> float:
    return a / b if b else (math.inf if a else 0.0)


def _mutual(x: dict[str, float], clip: bool = True) -> float:
    value = x["attr"] + x["cls"] - x["joint"]
    return max(0.0, value) if clip else value


def measures(df: DataFrame, target: str | None = None, names: Sequence[str] | None = None, **options) -> DataFrame:
    """Long table (measure, column, value) of the chosen measures."""
    return TableProfile(df, target, **options).frame(names)


def trimmed_means(df: DataFrame, columns: Sequence[str], proportion: float = 0.1, limit: int = SMALL_ROWS) -> dict[str, float]:
    """Mean without the lowest and highest floor(proportion * n) values."""
    if not columns:
        return {}
    values = {c: clean(col(c)) for c in columns}
    counts = df.agg(*[F.count(v).alias(f"n{i}") for i, v in enumerate(values.values())]).first()
    n = {c: counts[f"n{i}"] for i, c in enumerate(columns)}
    cut = {c: int(proportion * n[c]) for c in columns}
    edges = order_statistics(df, values, {c: {cut[c], n[c] - 1 - cut[c]} for c in columns if n[c]}, limit)
    aggs = []
    live = [c for c in columns if n[c] and n[c] > 2 * cut[c]]
    for i, c in enumerate(live):
        v, lo, hi = values[c], edges[(c, cut[c])], edges[(c, n[c] - 1 - cut[c])]
        aggs += [
            F.coalesce(F.sum(F.when((v > lo) & (v < hi), v)), F.lit(0.0)).alias(f"s{i}"),
            F.count_if(v <= lo).alias(f"lo{i}"),
            F.count_if(v < hi).alias(f"hi{i}"),
        ]
    got = df.agg(*aggs).first() if aggs else None
    out = {c: 0.0 for c in columns}
    for i, c in enumerate(live):
        lo, hi = edges[(c, cut[c])], edges[(c, n[c] - 1 - cut[c])]
        if lo == hi:
            out[c] = lo
            continue
        kept_low, kept_high = got[f"lo{i}"] - cut[c], n[c] - cut[c] - got[f"hi{i}"]
        out[c] = (got[f"s{i}"] + kept_low * lo + kept_high * hi) / (n[c] - 2 * cut[c])
    return out


def column_entropies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, entropy) in bits with the 1e-10 guard."""
    counts = value_counts(df, columns)
    # one total per column
    totals = counts.groupBy("column").agg(F.sum("count").alias("n"))
    joined = counts.join(F.broadcast(totals), "column")
    return joined.groupBy("column").agg(F.sum(entropy_term(F.col("count"), F.col("n"))).alias("entropy"))


def robust_entropy(df: DataFrame, column: str, base: float = 2.0) -> DataFrame:
    """Plain entropy in any base; 0 for an empty or one-valued column."""
    counts = value_counts(df, [column])
    # H = log n - sum(k log k) / n needs one pass over the counts
    n, weighted = F.sum("count"), F.sum(F.col("count") * F.ln("count"))
    plain = (F.ln(n) - weighted / n) / F.lit(math.log(base))
    return counts.agg(F.when(F.count("*") > 1, plain).otherwise(F.lit(0.0)).alias("entropy"))


def outside_iqr(c: Column, q1: float, q3: float, k: float = 1.5) -> Column:
    spread = q3 - q1
    return (c < F.lit(q1 - k * spread)) | (c > F.lit(q3 + k * spread))


def detect_outliers(df: DataFrame, column: str, k: float = 1.5, name: str = "outlier") -> DataFrame:
    """Flag values outside k interquartile ranges."""
    q1, q3 = quantiles(df, {"v": col(column)}, [0.25, 0.75])["v"]
    if q1 is None:
        return df.withColumn(name, F.lit(False))
    return df.withColumn(name, F.coalesce(outside_iqr(clean(col(column)), q1, q3, k), F.lit(False)))


def min_max_normalise(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Min-max scale every numeric column; a constant column becomes 0."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    if not columns:
        return df
    bounds = df.agg(
        *[F.min(clean(col(c))).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(clean(col(c))).alias(f"hi{i}") for i, c in enumerate(columns)],
    ).first()
    scaled = {}
    for i, c in enumerate(columns):
        lo, hi = bounds[f"lo{i}"], bounds[f"hi{i}"]
        v = clean(col(c))
        scaled[c] = F.lit(0.0) if lo is None or lo == hi else (v - F.lit(lo)) / F.lit(hi - lo)
        if lo is not None and lo == hi:
            scaled[c] = F.when(v.isNotNull(), F.lit(0.0))
    return df.select(*[scaled[c].alias(c) if c in scaled else col(c) for c in df.columns])


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Full Pearson matrix in long form (a, b, r)."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    if len(columns) > NARROW:
        pairs = named_pairs(covariance_bands(df, columns), columns)
        mirrored = pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "r")
        return pairs.select("a", "b", "r").unionByName(mirrored)
    r = gram(nan_to_null(df), columns).correlation()
    rows = [
        (a, b, None if math.isnan(r[i, j]) else float(r[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)
    ]
    return rows_frame(df.sparkSession, rows, "a string, b string, r double")


