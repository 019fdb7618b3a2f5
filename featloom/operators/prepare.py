"""Fitted preparation: learn on training rows, replay on any rows.

Fitting collects scalars and, for one 0/1 column per category, the categories.
Steps on different columns are fitted together, so a plan costs a few aggregates
per dependency level and not one per step. A fitted preparation is a projection,
with a join on a frozen map for each index of categories; it never reads the
training rows again and also applies to streaming frames.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featloom.core import checked_broadcast, checkpointed, clean, col, is_numeric, nan_to_null, numeric_columns, require_columns, rows_frame
from featloom.functions.columns import negative_as_missing, zero_as_missing
from featloom.functions.ordering import SMALL_ROWS, global_row_number, quantiles
from featloom.operators.gram import NARROW, gram
from featloom.operators.ordered import backward_fill, discrete_cosine, forward_fill
from featloom.operators.wide import centre, leading_components, packed
from featloom.plans.plan import Plan

# ------------------------------------------------------------ small methods


def drop_column(df: DataFrame, column: str) -> DataFrame:
    return df.drop(column)


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    return df.where(clean_if_float(df, column).isNotNull())


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def clean_if_float(df: DataFrame, column: str) -> Column:
    c = col(column)
    return F.when(~F.isnan(c), c) if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)) else c


def features_by_family(df: DataFrame, family: str, target: str | None = None) -> DataFrame:
    """Numeric columns, or the others, without the target."""
    numbers = numeric_columns(df)
    picked = [c for c in df.columns if c != target and (c in numbers) == (family == "numeric")]
    return df.select(*[col(c) for c in picked])


def freeze_schema(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly these columns in this order; absent ones are 0.0, extras are dropped."""
    return df.select(*[col(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns])


def require_same_columns(found: Sequence[str], wanted: Sequence[str]) -> None:
    if set(found) != set(wanted):
        extra, lost = set(found) - set(wanted), set(wanted) - set(found)
        raise ValueError(f"input columns differ: missing {sorted(lost)}, unexpected {sorted(extra)}")


def inference_frame(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Model inputs with missing values as 0; the column sets must be equal."""
    require_same_columns(df.columns, columns)
    return nan_to_null(df).select(*[col(c) for c in columns]).na.fill(0)


def l2_normalise(columns: Sequence[str]) -> list[Column]:
    """Each row divided by its length over the columns; a zero row stays zero."""
    values = [clean(col(c)) for c in columns]
    total = sum((v * v for v in values[1:]), values[0] * values[0])
    length = F.sqrt(total)
    return [F.when(length == 0, F.lit(0.0)).otherwise(v / F.when(length > 0, length)).alias(c) for v, c in zip(values, columns, strict=True)]


def bin_index(c: Column, edges: Sequence[float], lowest: bool = True) -> Column:
    """Bin of (lo, hi] edges as 0..n-1; the lowest edge is included; outside is NULL."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        low = (c >= F.lit(edges[i])) if i == 0 and lowest else (c > F.lit(edges[i]))
        out = F.when(low & (c <= F.lit(edges[i + 1])), F.lit(i)).otherwise(out)
    return out


def kbins_index(c: Column, edges: Sequence[float]) -> Column:
    """Bin of [lo, hi) edges; values beyond the outer edges fall into the outer bins."""
    out = F.lit(0)
    for i in range(1, len(edges) - 1):
        out = out + F.when(c >= F.lit(edges[i]), 1).otherwise(0)
    return F.when(c.isNotNull(), out)


def kbins_edges(df: DataFrame, column: str, strategy: str, n_bins: int = 3) -> list[float]:
    if strategy == "quantile":
        found = quantiles(df, {"v": col(column)}, [i / n_bins for i in range(n_bins + 1)])["v"]
    else:
        got = df.agg(F.min(clean(col(column))).alias("lo"), F.max(clean(col(column))).alias("hi")).first()
        found = list(np.linspace(got["lo"], got["hi"], n_bins + 1)) if got["lo"] is not None else []
    if not found or found[0] is None:
        raise ValueError(f"cannot bin a column without values: {column}")
    return [float(e) for i, e in enumerate(found) if i == 0 or e != found[i - 1]]


def discretise(
    df: DataFrame, column: str, strategy: str, n_bins: int = 3, one_hot: bool = False
) -> DataFrame:
    """Add `{column}_bin`, or one 0/1 column per bin; replaces the column."""
    edges = kbins_edges(df, column, strategy, n_bins)
    index = kbins_index(clean(col(column)), edges)
    if not one_hot:
        return df.withColumn(f"{column}_bin", index).drop(column)
    flags = [(index == i).cast("double").alias(f"{column}_bin_{i}") for i in range(max(1, len(edges) - 1))]
    return df.select(*[col(c) for c in df.columns if c != column], *flags)


def discretise_target(
    df: DataFrame, column: str, bins: Sequence[float], labels: Sequence[Any] | None = None, method: str = "quantile"
) -> DataFrame:
    """Cut a target at quantiles or values; integer labels by default."""
    labels = list(labels) if labels is not None else list(range(len(bins) - 1))
    edges = quantiles(df, {"v": col(column)}, bins)["v"] if method == "quantile" else [float(b) for b in bins]
    if len(set(edges)) < len(edges):
        raise ValueError("bin edges must be unique")
    if len(labels) != len(edges) - 1:
        raise ValueError("labels must match the intervals")
    return df.withColumn(column, _labelled(bin_index(clean(col(column)), edges), labels))


def _labelled(index: Column, labels: Sequence[Any]) -> Column:
    if all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in labels):
        values = [F.lit(int(x)) for x in labels]
    else:
        values = [F.lit(str(x)) for x in labels]
    return F.get(F.array(*values), index)


def pca_components(df: DataFrame, columns: Sequence[str], max_components: int = 5, prefix: str | None = None) -> DataFrame:
    """Standardise and project on the leading components; replaces the columns.

    Each component is signed so that its largest loading is positive.
    """
    columns = list(columns)
    bad = [c for c in columns if not is_numeric(df.schema[c].dataType)]
    if bad:
        raise TypeError("PCA requires numeric data")
    prefix = prefix or columns[0]
    names = [f"{prefix}_pca_component_{k + 1}" for k in range(max_components)]
    kept = [col(c) for c in df.columns if c not in columns]
    if len(columns) > NARROW:
        return _wide_components(df, columns, kept, names)
    stats = df.agg(
        F.count("*").alias("rows"),
        *[F.avg(clean(col(c))).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(clean(col(c))).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    mean = [stats[f"m{i}"] or 0.0 for i in range(len(columns))]
    sd = [stats[f"s{i}"] or 1.0 for i in range(len(columns))]
    n = min(stats["rows"], len(columns), max_components)
    scaled = [(clean(col(c)) - F.lit(m)) / F.lit(s) for c, m, s in zip(columns, mean, sd, strict=True)]
    cov = np.nan_to_num(gram(df.select(*[s.alias(f"z{i}") for i, s in enumerate(scaled)]), [f"z{i}" for i in range(len(columns))]).covariance())
    values, vectors = np.linalg.eigh(cov)
    vectors = vectors[:, np.argsort(values)[::-1][:n]]
    out = []
    for k in range(n):
        v = _signed(vectors[:, k])
        terms = [s * F.lit(float(w)) for s, w in zip(scaled, v, strict=True)]
        out.append(sum(terms[1:], terms[0]).alias(names[k]))
    return df.select(*kept, *out)


def _signed(v: np.ndarray) -> np.ndarray:
    return v * np.sign(v[np.argmax(np.abs(v))])


def _wide_components(df: DataFrame, columns: Sequence[str], kept: Sequence[Column], names: Sequence[str]) -> DataFrame:
    """Components of many columns; a missing value stands at its column's mean while they are fitted."""
    d = len(columns)
    x = packed(df, columns)
    rows = x.count()
    middle = centre(x, d)
    sd = np.where(middle.sd > 0, middle.sd, 1.0)
    n = min(rows, d, len(names))
    vectors = leading_components(x, d, n, middle.mean, sd, rows).vectors
    numbers = F.array(*[clean(col(c)) for c in columns])
    out = []
    for k in range(n):
        weight = _signed(vectors[:, k]) / sd
        products = F.zip_with(numbers, F.lit([float(w) for w in weight]), lambda a, w: a * w)
        total = F.aggregate(products, F.lit(0.0), lambda s, v: s + v)
        out.append((total - F.lit(float(weight @ middle.mean))).alias(names[k]))
    return df.select(*kept, *out)


def dummies(df: DataFrame, columns: Sequence[str], drop_first: bool = True, fill_rounded_mean: bool = False) -> DataFrame:
    """0/1 columns for text columns, optionally without the first category and
    with numeric gaps filled by the rounded mean."""
    columns = list(columns)
    cats = _categories(df, columns)
    numbers = numeric_columns(df, exclude=columns)
    means = {}
    if fill_rounded_mean and numbers:
        got = df.agg(*[F.bround(F.avg(clean(col(c)))).alias(f"m{i}") for i, c in enumerate(numbers)]).first()
        means = {c: got[i] for i, c in enumerate(numbers)}
    out = []
    for c in df.columns:
        if c in columns:
            continue
        if means.get(c) is None:
            out.append(col(c))
        else:
            out.append(F.coalesce(clean_if_float(df, c), F.lit(means[c]).cast(df.schema[c].dataType)).alias(c))
    for c in columns:
        values = [v for v in cats[c] if v is not None]
        out += [
            F.coalesce((col(c).cast("string") == F.lit(v)), F.lit(False)).cast("double").alias(f"{c}_{v}")
            for v in (values[1:] if drop_first else values)
        ]
    return df.select(*out)


# ---------------------------------------------------------- category facts
def _counts(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """(i, v, count) of the values of several expressions, NULL included."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), c.cast("string").alias("v")) for i, c in enumerate(exprs.values())])
    long = df.select(F.explode(pairs).alias("x"))
    return long.groupBy(F.col("x.i").alias("i"), F.col("x.v").alias("v")).count()


def _category_lists(df: DataFrame, exprs: dict[str, Column], types: dict[str, T.DataType]) -> dict[str, list[str | None]]:
    """Sorted values per expression (NULL last): each becomes a column, so the driver needs them all."""
    if not exprs:
        return {}
    names = list(exprs)
    found: dict[str, list] = {n: [] for n in names}
    for r in _counts(df, exprs).select("i", "v").toLocalIterator():
        found[names[r["i"]]].append(r["v"])
    out = {}
    for n, values in found.items():
        key: Callable = (lambda v: float(v)) if is_numeric(types[n]) else (lambda v: v)
        out[n] = sorted([v for v in values if v is not None], key=key) + ([None] if None in values else [])
    return out


def _categories(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str | None]]:
    return _category_lists(df, {c: col(c) for c in columns}, {c: df.schema[c].dataType for c in columns})


def _modes(df: DataFrame, exprs: dict[str, Column], types: dict[str, T.DataType]) -> dict[str, Any]:
    """Most frequent non-null value, smallest on a tie; counts first, so no value map is held."""
    if not exprs:
        return {}
    counts = _counts(df, exprs).where("v is not null")
    aggs = []
    for i, n in enumerate(exprs):
        typed = F.col("v").cast(types[n])
        best = F.min(F.when(F.col("i") == i, F.struct((-F.col("count")).alias("k"), typed.alias("v"))))
        aggs.append(best["v"].alias(f"m{i}"))
    got = counts.agg(*aggs).first()
    return {n: got[f"m{i}"] for i, n in enumerate(exprs)}


def frequency_index(df: DataFrame, column: str, limit: int = SMALL_ROWS) -> DataFrame:
    """(value, index): non-null values by frequency descending, ties by value."""
    counts = df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).count()
    ranked = global_row_number(counts, [F.desc("count"), F.asc("value")], "index", limit=limit)
    return ranked.select("value", (F.col("index") - 1).cast("int").alias("index"))


def string_index(df: DataFrame, column: str, mapping: DataFrame | None = None, unknown: int | None = -1) -> DataFrame:
    """Replace a column by its frequency rank."""
    mapping = frequency_index(df, column) if mapping is None else mapping
    side = checked_broadcast(mapping.select(F.col("value").alias("_value"), F.col("index").alias("_index")))
    joined = df.join(side, col(column) == F.col("_value"), "left")
    index = F.col("_index") if unknown is None else F.coalesce("_index", F.lit(unknown))
    return joined.select(*[index.alias(c) if c == column else col(c) for c in df.columns])


# --------------------------------------------------------- fitted pipeline
class Working:
    """A frame with the current expression and type of every predictor; other columns ride along."""

    def __init__(self, df: DataFrame, predictors: Sequence[str], others: Sequence[str] = ()) -> None:
        self.frame = nan_to_null(df)
        self.others = list(others)
        self.exprs = {c: col(c) for c in predictors}
        self.types = {c: self.frame.schema[c].dataType for c in predictors}

    def put(self, name: str, expr: Column, kind: T.DataType) -> None:
        self.exprs[name], self.types[name] = expr, kind

    def join(self, name: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """Evaluate all expressions, then let `change` rewrite the named column by a join."""
        flat = self.frame.select(*[col(c) for c in self.others], *[e.alias(c) for c, e in self.exprs.items()])
        self.frame = change(flat)
        for c in self.exprs:
            self.put(c, col(c), self.frame.schema[c].dataType)


@dataclass
class Operation:
    """One fitted step of one column."""

    method: str
    column: str
    category = ""

    def run(self, on: Working) -> None:
        raise NotImplementedError


@dataclass
class Fill(Operation):
    """A constant for NULL; `number` turns the column into doubles."""

    value: Any
    number: bool = False
    category = "impute"

    def run(self, on: Working) -> None:
        kind = T.DoubleType() if self.number else on.types[self.column]
        on.put(self.column, F.coalesce(on.exprs[self.column].cast(kind), F.lit(self.value).cast(kind)), kind)


@dataclass
class Blank(Operation):
    """NULL for values that stand for a missing one."""

    def __post_init__(self) -> None:
        self.category, self.rule = {
            "ZERO_AS_MISSING_VALUE": ("replace_zero", zero_as_missing), "NEGATIVE_AS_MISSING_VALUE": ("replace_negative", negative_as_missing),
        }[self.method]

    def run(self, on: Working) -> None:
        on.put(self.column, self.rule(on.exprs[self.column]), on.types[self.column])


@dataclass
class Rescale(Operation):
    """(x - shift) / scale."""

    shift: float
    scale: float
    category = "numeric"

    def run(self, on: Working) -> None:
        on.put(self.column, (on.exprs[self.column].cast("double") - F.lit(self.shift)) / F.lit(self.scale), T.DoubleType())


@dataclass
class Positive(Operation):
    """1 above zero, else 0."""

    category = "numeric"

    def run(self, on: Working) -> None:
        on.put(self.column, (on.exprs[self.column].cast("double") > 0).cast("double"), T.DoubleType())


@dataclass
class Indicators(Operation):
    """A 0/1 column per category, at the end, in place of the column."""

    values: list[str | None]
    category = "one_hot"

    def names(self) -> list[str]:
        return [f"{self.column}_{'nan' if v is None else v}" for v in self.values]

    def run(self, on: Working) -> None:
        source = on.exprs.pop(self.column)
        del on.types[self.column]
        for name, v in zip(self.names(), self.values, strict=True):
            hit = source.isNull() if v is None else source.cast("string") == F.lit(v)
            on.put(name, F.coalesce(hit, F.lit(False)).cast("double"), T.DoubleType())


@dataclass
class Rank(Operation):
    """The frequency rank of a category, -1 if it was not seen; `mapping` is frozen at fit."""

    mapping: DataFrame
    category = "string_index"

    def run(self, on: Working) -> None:
        kind = on.types[self.column]
        if not isinstance(kind, T.StringType):
            on.put(self.column, on.exprs[self.column].cast("string"), T.StringType())
        on.join(self.column, lambda df: string_index(df, self.column, self.mapping))


@dataclass
class FittedPreparation:
    """Fitted operations in order, and the columns they leave."""

    target: str
    operations: list[Operation]
    output_columns: list[str]
    manifest: dict[str, Any]
    strict: bool = True
    sampling_methods: list[str] = field(default_factory=list)
    edges: list[float] | None = None
    labels: list | None = None
    passthrough: list[str] = field(default_factory=list)
    rename: dict[str, str] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        """Passthrough columns, frozen features and, if present, the target."""
        others = [c for c in (*self.passthrough, self.target) if c in df.columns]
        on = Working(df, [c for c in df.columns if c not in others], others)
        for op in self.operations:
            if op.column in on.exprs:
                op.run(on)
            elif self.strict:
                raise ValueError(f"missing input column: {op.column}")
        source = {shown: made for made, shown in self.rename.items()}
        features = [on.exprs.get(source.get(c, c), F.lit(0.0)).alias(c) for c in self.output_columns]
        return on.frame.select(*[col(c) for c in others if c != self.target], *features, *self._answer(others))

    def _answer(self, present: Sequence[str]) -> list[Column]:
        if self.target not in present:
            return []
        y = col(self.target)
        if self.edges is not None:
            y = _labelled(bin_index(y.cast("double"), self.edges), self.labels)
        return [y.alias(self.target)]

    def features(self, df: DataFrame) -> list[str]:
        return list(self.output_columns)

    def fit_resample_training(self, df: DataFrame, key: str | None = None, seed: int = 42) -> DataFrame:
        """Transformed training rows with classes balanced by the plan's samplers."""
        from featloom.operators.sampling import resample

        require_columns(df, [self.target])
        out = self.transform(df)
        for method in self.sampling_methods:
            out = resample(out, self.target, self.output_columns, method, key=key, seed=seed)
        return out

    def manifest_frame(self, df: DataFrame) -> DataFrame:
        return rows_frame(df.sparkSession, [(json.dumps(self.manifest, default=str),)], "manifest string")


# What a fitted step needs to know of its column.
NEEDS = {
    ("missing_values", "MEAN"): "mean", ("missing_values", "MEDIAN"): "median", ("missing_values", "MODE"): "mode",
    ("missing_values", "ZERO_AS_MISSING_VALUE"): None, ("missing_values", "NEGATIVE_AS_MISSING_VALUE"): None,
    ("transformation", "STANDARDIZE"): "spread", ("transformation", "MIN_MAX_SCALE"): "spread", ("transformation", "BINARIZE"): None,
    ("encoding", "ONE_HOT_ENCODE"): "values", ("encoding", "STRING_INDEX"): "ranks",
}
ANY_TYPE = {("missing_values", "MODE"), ("encoding", "ONE_HOT_ENCODE"), ("encoding", "STRING_INDEX")}


class Preparation:
    """Compiles a plan to fitted operations."""

    def __init__(self, strict: bool = True, order: Sequence[str] = ("missing_values", "transformation", "encoding")) -> None:
        self.strict = strict
        self.order = tuple(order)

    def fit(
        self, train: DataFrame, plan: Plan, target: str | None = None, *, masks: dict | None = None,
        target_quantiles: Sequence[float] | None = None, target_labels: Sequence | None = None,
        passthrough: Sequence[str] = (),
    ) -> FittedPreparation:
        target = target or plan.target
        require_columns(train, [target])
        if plan.target != target:
            raise ValueError(f"the plan's target {plan.target} does not match {target}")
        plan = plan.keep(masks) if masks else plan
        if self.strict and any(s.methods for s in plan.extraction):
            raise ValueError("extraction has no fitted form; apply it with apply_plan")
        predictors = [c for c in train.columns if c != target and c not in passthrough]
        steps = [(c, s.column, m) for c in self.order for s in getattr(plan, c) for m in s.methods]
        rows = train.count()
        operations = self._fit_steps(Working(train, predictors), steps, rows)
        # The order of the output follows the plan.
        after = Working(train, predictors)
        for op in operations:
            op.run(after)
        samplers = [m for s in plan.sampling for m in s.methods]
        edges, labels = None, None
        if target_quantiles is not None:
            edges, labels = fit_target_bins(nan_to_null(train), target, target_quantiles, target_labels, rows)
        if samplers:
            operations = operations + self._fit_sampling_inputs(after, rows)
        columns = list(after.exprs)
        # fixed values: keys of the manifest
        manifest = {
            "training_rows": rows, "target_column": target, "output_columns": columns,
            "operations": [{"category": o.category, "method": o.method, "column": o.column} for o in operations],
            "sampling_methods": samplers, "target_bin_edges": edges, "target_labels": labels,
        }
        return FittedPreparation(
            target, operations, columns, manifest, strict=self.strict, sampling_methods=samplers, edges=edges,
            labels=labels, passthrough=list(passthrough),
        )

    def _fit_steps(self, on: Working, steps: list, rows: int) -> list[Operation]:
        """Fit in rounds: each takes the next step of every column, so all steps of a round share their aggregates."""
        waiting: dict[str, list[int]] = {}
        for i, (_, column, _) in enumerate(steps):
            waiting.setdefault(column, []).append(i)
        done: dict[int, Operation] = {}
        while any(waiting.values()):
            turn = [queue.pop(0) for queue in waiting.values() if queue]
            absent = [steps[i][1] for i in turn if steps[i][1] not in on.exprs]
            if absent and self.strict:
                raise ValueError(f"missing column for a step: {absent}")
            turn = [i for i in turn if steps[i][1] in on.exprs]
            fitted = self.fit_round(on, [steps[i] for i in turn], rows)
            done.update(zip(turn, fitted, strict=True))
            for op in fitted:
                op.run(on)
        return [done[i] for i in sorted(done)]

    def fit_round(self, on: Working, steps: list, rows: int) -> list[Operation]:
        wanted: dict[str, dict[str, Column]] = {}
        for category, column, method in steps:
            if (category, method) not in NEEDS:
                raise ValueError(f"{category}/{method} is not supported in a fitted plan")
            if (category, method) not in ANY_TYPE and not is_numeric(on.types[column]):
                raise ValueError(f"{method} requires a numeric column: {column}")
            wanted.setdefault(NEEDS[category, method], {})[column] = on.exprs[column]
        facts = self._facts(on, wanted, rows)
        return [self._operation(on, *s, facts) for s in steps]

    @staticmethod
    def _facts(on: Working, wanted: dict[str, dict[str, Column]], rows: int) -> dict[tuple[str, str], Any]:
        """(need, column) -> fact; means and spreads come from one aggregate."""
        aggs, places = [], []
        for need in ("mean", "spread"):
            for c, e in wanted.get(need, {}).items():
                v = clean(e)
                aggs.append(F.struct(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi")).alias(f"x{len(aggs)}"))
                places.append((need, c))
        facts: dict[tuple[str, str], Any] = {}
        if aggs:
            facts.update(zip(places, on.frame.agg(*aggs).first(), strict=True))
        found = {
            "median": lambda exprs: {c: v[0] for c, v in quantiles(on.frame, exprs, [0.5], rows=rows).items()},
            "mode": lambda exprs: _modes(on.frame, exprs, on.types),
            "values": lambda exprs: _category_lists(on.frame, exprs, on.types),
            "ranks": lambda exprs: {c: frozen_ranks(on.frame.select(e.cast("string").alias(c)), c) for c, e in exprs.items()},
        }
        for need, find in found.items():
            if wanted.get(need):
                facts.update({(need, c): v for c, v in find(wanted[need]).items()})
        return facts

    @staticmethod
    def _operation(on: Working, category: str, column: str, method: str, facts: dict) -> Operation:
        need = NEEDS[category, method]
        fact = facts.get((need, column))
        if need == "values":
            return Indicators(method, column, fact)
        if need == "ranks":
            return Rank(method, column, fact)
        if need is None:
            return Positive(method, column) if category == "transformation" else Blank(method, column)
        value = fact["mean"] if need in ("mean", "spread") else fact
        if value is None:
            raise ValueError(f"{method} on a column without values: {column}")
        if need != "spread":
            return Fill(method, column, value, number=need != "mode")
        if method == "MIN_MAX_SCALE":
            return Rescale(method, column, fact["lo"], (fact["hi"] - fact["lo"]) or 1.0)
        # a spread at rounding level is a constant column
        level = 10 * np.finfo(float).eps * abs(value)
        return Rescale(method, column, value, fact["sd"] if fact["sd"] and fact["sd"] > level else 1.0)

    @staticmethod
    def _fit_sampling_inputs(on: Working, rows: int) -> list[Operation]:
        """Samplers need a complete numeric matrix: impute gaps, one-hot the rest."""
        names = list(on.exprs)
        got = on.frame.agg(*[F.count(on.exprs[c]).alias(f"n{i}") for i, c in enumerate(names)]).first() if names else []
        gaps = {c: on.exprs[c] for i, c in enumerate(names) if got[i] < rows}
        numbers = {c: e for c, e in gaps.items() if is_numeric(on.types[c])}
        texts = {c: e for c, e in gaps.items() if c not in numbers}
        found = {c: v[0] for c, v in quantiles(on.frame, numbers, [0.5], rows=rows).items()} if numbers else {}
        found.update(_modes(on.frame, texts, on.types))
        # fixed values: names of the steps that samplers imply
        out: list[Operation] = [Fill("SAMPLING_PREREQUISITE_MEDIAN" if c in numbers else "SAMPLING_PREREQUISITE_MOST_FREQUENT", c, found[c], number=c in numbers) for c in gaps]
        for op in out:
            op.run(on)
        left = {c: e for c, e in on.exprs.items() if not is_numeric(on.types[c])}
        for c, values in _category_lists(on.frame, left, on.types).items():
            out.append(Indicators("SAMPLING_PREREQUISITE_ONE_HOT", c, values))
            out[-1].run(on)
        return out


def frozen_ranks(df: DataFrame, column: str) -> DataFrame:
    """The frequency index of a column, written to the shared folder, so that it outlives the training rows."""
    return checkpointed(frequency_index(df, column))


def fit_target_bins(df: DataFrame, target: str, shares: Sequence[float], labels: Sequence | None, rows: int) -> tuple[list[float], list]:
    """Bins of a target between its quantiles at `shares`: open at both ends, equal quantiles once, a label for each."""
    if len(shares) < 2 or (shares[0], shares[-1]) != (0, 1):
        raise ValueError(f"shares of the rows run from 0 to 1, not {list(shares)}")
    cuts = quantiles(df, {"t": col(target)}, shares, rows=rows)["t"]
    ordered = list(dict.fromkeys(float(c) for c in cuts if c is not None))
    if len(ordered) < 2:
        raise ValueError(f"{target} has too few values for bins")
    edges = [-math.inf, *ordered[1:-1], math.inf]
    names = list(labels) if labels else list(range(len(edges) - 1))
    if len(names) != len(edges) - 1:
        raise ValueError(f"{len(names)} labels for {len(edges) - 1} bins")
    return edges, names


def fit_baseline(train: DataFrame, target: str, passthrough: Sequence[str] = ()) -> FittedPreparation:
    """Fixed preparation: numbers -> median, standardise; others -> mode, one-hot."""
    require_columns(train, [target])
    predictors = [c for c in train.columns if c != target and c not in passthrough]
    numbers = [c for c in predictors if c in numeric_columns(train)]
    others = [c for c in predictors if c not in numbers]
    plan = Plan.of(
        target,
        missing_values=[*[(c, ["MEDIAN"]) for c in numbers], *[(c, ["MODE"]) for c in others]],
        transformation=[(c, ["STANDARDIZE"]) for c in numbers],
        encoding=[(c, ["ONE_HOT_ENCODE"]) for c in others],
    )
    fitted = Preparation().fit(train, plan, passthrough=passthrough)
    made = {n for op in fitted.operations if isinstance(op, Indicators) for n in op.names()}
    # fixed values: prefixes of the baseline's columns
    shown = {c: f"categorical__{c}" if c in made else f"numeric__{c}" for c in fitted.output_columns}
    columns = [shown[c] for c in sorted(fitted.output_columns, key=lambda c: c in made)]
    manifest = {"kind": "deterministic_baseline", "target_column": target, "output_columns": columns}
    return FittedPreparation(target, fitted.operations, columns, manifest, passthrough=list(passthrough), rename=shown)


def finalise_numeric(train: DataFrame, test: DataFrame, target: str, passthrough: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Baseline-prepared train and test with the target attached."""
    fitted = fit_baseline(train, target, passthrough)
    return fitted.transform(train), fitted.transform(test)


# ------------------------------------------------------- unfitted applier
Step = Callable[..., DataFrame]
_METHODS: dict[tuple[str, str], Step] = {}


def register_method(category: str, method: str):
    """Add a preparation step `f(df, column, **options) -> df` under (category, method)."""

    def decorate(function: Step) -> Step:
        _METHODS[(category, method)] = function
        return function

    return decorate


def apply_method(df: DataFrame, category: str, method: str, column: str, **options) -> DataFrame:
    if (category, method) not in _METHODS:
        raise ValueError(f"unsupported method: {category}/{method}")
    return _METHODS[(category, method)](df, column, **options)


def _fitted_step(category: str, method: str) -> Step:
    """Unfitted form of a fitted step: fit on the frame itself; text is left alone."""

    def run(df: DataFrame, column: str, **_) -> DataFrame:
        numeric_only = (category, method) != ("missing_values", "MODE")
        if numeric_only and not is_numeric(df.schema[column].dataType):
            return df
        on = Working(df, df.columns)
        Preparation().fit_round(on, [(category, column, method)], df.count())[0].run(on)
        return on.frame.select(*[on.exprs[c].alias(c) for c in df.columns])

    return run


for _c, _m in [
    ("missing_values", "MEAN"), ("missing_values", "MEDIAN"), ("missing_values", "MODE"),
    ("missing_values", "ZERO_AS_MISSING_VALUE"), ("missing_values", "NEGATIVE_AS_MISSING_VALUE"),
    ("transformation", "STANDARDIZE"), ("transformation", "MIN_MAX_SCALE"), ("transformation", "BINARIZE"),
]:
    register_method(_c, _m)(_fitted_step(_c, _m))


@register_method("missing_values", "DROP")
def _drop(df: DataFrame, column: str, **_) -> DataFrame:
    return drop_missing(df, column)


@register_method("missing_values", "FORWARD_FILL")
def _ffill(df: DataFrame, column: str, order_by: Sequence[str] = (), partition_by: Sequence[str] = (), **_) -> DataFrame:
    if not order_by:
        raise ValueError("forward fill needs order_by")
    return forward_fill(df, column, order_by, partition_by)


@register_method("missing_values", "BACKWARD_FILL")
def _bfill(df: DataFrame, column: str, order_by: Sequence[str] = (), partition_by: Sequence[str] = (), **_) -> DataFrame:
    if not order_by:
        raise ValueError("backward fill needs order_by")
    return backward_fill(df, column, order_by, partition_by)


@register_method("transformation", "NORMALIZE")
def _normalise(df: DataFrame, column: str, **_) -> DataFrame:
    scaled = l2_normalise([column])[0]
    return df.select(*[scaled if c == column else col(c) for c in df.columns])


@register_method("transformation", "UNIFORM_DISCRETIZE")
def _uniform(df: DataFrame, column: str, n_bins: int = 5, **_) -> DataFrame:
    return discretise(df, column, "uniform", n_bins)


@register_method("transformation", "QUANTILE_DISCRETIZE")
def _quantile(df: DataFrame, column: str, n_bins: int = 5, **_) -> DataFrame:
    return discretise(df, column, "quantile", n_bins)


@register_method("transformation", "DISCRETE_COSINE")
def _cosine(df: DataFrame, column: str, order_by: Sequence[str] = (), partition_by: Sequence[str] = (), **_) -> DataFrame:
    if not order_by:
        raise ValueError("a cosine transform needs order_by")
    return discrete_cosine(df, column, order_by, partition_by)


@register_method("encoding", "ONE_HOT_ENCODE")
def _one_hot(df: DataFrame, column: str, **_) -> DataFrame:
    return dummies(df, [column], drop_first=False)


@register_method("encoding", "STRING_INDEX")
def _index(df: DataFrame, column: str, **_) -> DataFrame:
    return string_index(df, column, unknown=None)


@register_method("extraction", "PCA")
def _pca(df: DataFrame, column: str, max_n_components: int = 5, **_) -> DataFrame:
    return pca_components(df, [column], max_n_components)


# fixed values: step names of the history, by plan category
_HISTORY = {
    "missing_values": "missing_values",
    "encoding": "feature_creation",
    "transformation": "transformation",
    "extraction": "feature_selection",
}


def apply_plan(
    df: DataFrame, plan: Plan, *, masks: dict | None = None, only_cleaning: bool = False,
    target_bins: Sequence[float] | None = None, target_labels: Sequence | None = None,
    order_by: Sequence[str] = (), partition_by: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Apply a plan without a holdout: cleaning, encoding, transformation, extraction.

    Failed steps are recorded and skipped; unknown columns are passed over.
    """
    if masks:
        plan = plan.keep(masks)
    history = []
    out = df
    categories = ["missing_values"] if only_cleaning else list(_HISTORY)
    for category in categories:
        for step in getattr(plan, category):
            if step.column not in out.columns:
                continue
            for method in step.methods:
                try:
                    out = apply_method(out, category, method, step.column, order_by=order_by, partition_by=partition_by)
                    history.append((len(history), _HISTORY[category], method, step.column, True, None))
                except Exception as error:  # noqa: BLE001
                    history.append((len(history), _HISTORY[category], method, step.column, False, str(error)))
    if target_bins is not None:
        out = discretise_target(out, plan.target, target_bins, target_labels)
    frame = rows_frame(
        df.sparkSession, history,
        "position int, step string, method string, column string, success boolean, error_message string",
    )
    return out, frame


def is_classification_target(df: DataFrame, target: str) -> bool:
    """Text, or numbers that are exactly {0, 1}."""
    if not is_numeric(df.schema[target].dataType):
        return True
    v = clean(col(target))
    got = df.agg(F.bool_and((v == 0) | (v == 1)).alias("bin"), F.bool_or(v == 0).alias("zero"), F.bool_or(v == 1).alias("one")).first()
    return bool(got["bin"] and got["zero"] and got["one"])


def category_mappings(df: DataFrame, exclude: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Frozen frequency index of every text column."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]
    return {c: frozen_ranks(df, c) for c in texts}


def encode_categories(df: DataFrame, mappings: dict[str, DataFrame]) -> DataFrame:
    for c, mapping in mappings.items():
        df = string_index(df, c, mapping)
    return df
