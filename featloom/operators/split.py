"""Reproducible splits: every part is a filter on the row's hash position."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.core import col, require_columns, rows_frame, written
from featloom.functions.ordering import cut_number, hash_cuts, quantiles, running_sums
from featloom.functions.strata import number_in_strata


@dataclass(frozen=True)
class Partitions:
    train: DataFrame
    test: DataFrame
    audit: DataFrame


def require_unique_key(df: DataFrame, key: str) -> None:
    """Raise when a key value repeats."""
    require_columns(df, [key])
    if not duplicate_keys(df, key).isEmpty():
        raise ValueError(f"entity key must be unique: {key}")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Key values that occur more than once, with their counts."""
    return df.groupBy(col(key).alias(key)).agg(F.count("*").alias("rows")).where("rows > 1")


def _check_fraction(fraction: float) -> None:
    if not 0 < fraction < 1:
        raise ValueError(f"a share of test rows lies strictly between 0 and 1, not at {fraction}")


def _first_rows(
    df: DataFrame, key: str, seed: int | str, quota: Callable[[int], int], strata: Sequence[str] = (),
    column_quota: Callable[[Column], Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The first quota(n) rows of each stratum in hash order, and the rest.

    `column_quota` is the same quota as a column, for strata that are too many for the driver.
    """
    parts = hash_cuts(df, key, seed, lambda n: [quota(n)], strata)
    if parts is None:
        numbered, beyond = number_in_strata(df, key, seed, lambda n: [column_quota(n)], strata, "_side")
        first = (F.col("_side") == 0) & F.lit(beyond > 0)
        return numbered.where(first).drop("_side"), numbered.where(~first).drop("_side")
    numbered = cut_number(df, key, seed, parts, strata, "_side")
    first = (F.col("_side") == 0) if any(p["cuts"] for p in parts) else F.lit(False)
    return numbered.where(first).drop("_side"), numbered.where(~first).drop("_side")


def random_split(
    df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Exact-size shuffled split; the test part has ceil(n * test_size) rows."""
    _check_fraction(test_size)
    test, train = _first_rows(df, key, seed, lambda n: math.ceil(n * test_size))
    return train, test


def stratified_split(
    df: DataFrame, key: str, target: str, test_size: float = 0.25, seed: int = 42, regression: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Split that keeps class proportions; unstratified for regression."""
    if regression:
        return random_split(df, key, test_size, seed)
    _check_fraction(test_size)
    require_columns(df, [target])
    test, train = _first_rows(df, key, seed, lambda n: round(n * test_size), [target], lambda n: F.rint(n * test_size))
    return train, test


def fraction_sample(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Exact-size sample of round(n * fraction) rows."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must be in [0, 1]")
    return _first_rows(df, key, seed, lambda n: round(n * fraction))[0]


def stratified_folds(
    df: DataFrame, key: str, target: str, folds: int = 5, seed: int = 42, name: str = "fold"
) -> DataFrame:
    """Add a fold number; fold sizes within a class differ by at most one row."""
    if folds < 2:
        raise ValueError("at least two folds are required")
    # fold i ends at row n * (i + 1) / folds of its class
    parts = hash_cuts(df, key, seed, lambda n: [n * i // folds for i in range(1, folds)], [target])
    if parts is None:
        return number_in_strata(df, key, seed, lambda n: [F.floor(n * i / folds) for i in range(1, folds)], [target], name)[0]
    return cut_number(df, key, seed, parts, [target], name)


def outcome_partitions(
    df: DataFrame, key: str, outcome: str, test_size: float = 0.2, seed: int = 42, quantile: float = 0.75
) -> Partitions:
    """Binary target "outcome above its training quantile", without leakage."""
    require_columns(df, [key, outcome])
    require_unique_key(df, key)
    source_rows = df.count()
    eligible = df.where(col(key).isNotNull() & col(outcome).isNotNull())
    # every fact, feature and model reads the parts again, so their rows are chosen once
    train, test = (written(p, "part") for p in random_split(eligible, key, test_size, seed))
    threshold = quantiles(train, {"t": col(outcome)}, [quantile])["t"][0]

    def labelled(part: DataFrame) -> DataFrame:
        rest = [c for c in part.columns if c not in (key, outcome, "target")]
        target = (col(outcome) > F.lit(threshold)).cast("int").alias("target")
        return part.select(col(key), *[col(c) for c in rest], target)

    train, test = labelled(train), labelled(test)
    facts = [_part_facts(p) for p in (train, test)]
    overlap = entity_overlap(train, test, key)
    audit = rows_frame(
        df.sparkSession,
        [
            (
                source_rows,
                facts[0]["rows"] + facts[1]["rows"],
                source_rows - facts[0]["rows"] - facts[1]["rows"],
                facts[0]["rows"],
                facts[1]["rows"],
                "training_partition_only",
                threshold,
                overlap,
                facts[0]["rate"],
                facts[1]["rate"],
            )
        ],
        "source_rows long, eligible_rows long, excluded_missing_key_or_outcome long, train_rows long, "
        "test_rows long, threshold_source string, threshold double, entity_overlap long, "
        "train_positive_rate double, test_positive_rate double",
    )
    return Partitions(train, test, audit)


def _part_facts(part: DataFrame):
    return part.agg(F.count("*").alias("rows"), F.avg("target").alias("rate")).first()


def entity_overlap(train: DataFrame, test: DataFrame, key: str) -> int:
    """Number of key values present in both parts."""
    return train.select(col(key)).intersect(test.select(col(key))).count()


def chronological_partitions(
    df: DataFrame,
    order_by: str,
    target: str,
    *,
    tie_break: str,
    leakage_columns: Sequence[str] = (),
    positive: object = "yes",
    negative: object = "no",
    test_size: float = 0.2,
    sentinels: dict[str, object] | None = None,
) -> Partitions:
    """First round(n * (1 - test_size)) rows in source order train, the rest test.

    `order_by` and the unique `tie_break` replace the implicit file order. Both are
    compared in their own types; NULLs come last.
    """
    _check_fraction(test_size)
    require_columns(df, [target, order_by, tie_break, *leakage_columns])
    label = (
        F.when(col(target) == F.lit(positive), 1).when(col(target) == F.lit(negative), 0).cast("int")
    )
    counted = df.agg(F.count("*").alias("n"), F.count(label).alias("labelled")).first()
    if counted["labelled"] < counted["n"]:
        raise ValueError("target must contain only the positive and negative value")
    n = counted["n"]
    split = round(n * (1 - test_size))
    kept = [c for c in df.columns if c not in (target, "target", *leakage_columns)]
    prepared = df.select(*[col(c) for c in df.columns if c in kept], label.alias("target"))
    first = _before_rank(df, order_by, tie_break, split)
    train = df.where(first).select(*[col(c) for c in kept], label.alias("target"))
    test = df.where(~first).select(*[col(c) for c in kept], label.alias("target"))
    facts = [_part_facts(p) for p in (train, test)]
    found = {k: v for k, v in (sentinels or {}).items() if k in prepared.columns}
    audit = rows_frame(
        df.sparkSession,
        [
            (
                n,
                facts[0]["rows"],
                facts[1]["rows"],
                "chronological_source_order",
                list(leakage_columns),
                {k: str(v) for k, v in found.items()},
                facts[0]["rate"],
                facts[1]["rate"],
            )
        ],
        "source_rows long, train_rows long, test_rows long, split string, excluded_leakage_columns array<string>, "
        "sentinel_columns map<string,string>, train_positive_rate double, test_positive_rate double",
    )
    return Partitions(train, test, audit)


def _before_rank(df: DataFrame, order_by: str, tie_break: str, split: int) -> Column:
    """Condition for the first `split` rows by (order_by, tie_break), in native types, NULL last.

    The level of the last row is narrowed by counting: the values of `order_by` up
    to it, then the ties among its rows. Only distinct values are ordered.
    """
    if split <= 0:
        return F.lit(False)
    order, tie = col(order_by), col(tie_break)
    level, rest = _level(df, order, split)
    if level is None:
        above, here = order.isNotNull(), order.isNull()
    else:
        above, here = F.coalesce(order < level, F.lit(False)), F.coalesce(order == level, F.lit(False))
    edge, _ = _level(df.where(here), tie, rest)
    if edge is None:
        return above | here
    return above | (here & F.coalesce(tie <= edge, F.lit(False)))


def _level(df: DataFrame, value: Column, rank: int) -> tuple[Column | None, int]:
    """The value (None: NULL) at which `rank` rows are reached, and how many rows of that value belong to them."""
    kind = df.select(value.alias("v")).schema["v"].dataType
    counts = df.where(value.isNotNull()).groupBy(value.alias("v")).agg(F.count("*").alias("n"))
    steps = running_sums(counts, [F.asc("v")], {"seen": F.col("n")})
    got = steps.where(F.col("seen") >= rank).agg(F.min(F.struct("v", "seen", "n")).alias("x")).first()["x"]
    if got is None:
        return None, rank - (counts.agg(F.sum("n")).first()[0] or 0)
    return F.lit(got["v"]).cast(kind), rank - (got["seen"] - got["n"])
