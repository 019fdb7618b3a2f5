"""Exact quotas in any number of strata, with cuts that stay in a table.

`ordering.hash_cuts` keeps one cut per stratum on the driver, which suits some strata. Here sizes, cuts and the numbering of
rows are joins: a cut is found among the rows of one hash prefix of its stratum, and rows of hot strata meet a broadcast of
bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featloom.core import col, scratch_path
from featloom.functions.ordering import _BUCKET_BITS, _HASH_BITS, hash_order

# a stratum with more than one of so many rows is hot; there are fewer hot strata than this
HOT_SHARE = 1000
_SALTS = 1024


def cut_table(
    df: DataFrame, key: str, seed: int | str, quotas: Callable[[Column], Sequence[Column]], strata: Sequence[str]
) -> DataFrame:
    """Stored cuts, one row per stratum: (_x0, ..., _n, _cuts array<struct<j, h, k>>).

    `quotas(n)` lists ascending row counts for a stratum of n rows; a quota of 0 has no cut. A stratum spreads over up to
    65,536 hash prefixes, so neither a count nor a ranking holds a whole stratum in one task.
    """
    spark = df.sparkSession
    names = [f"_x{i}" for i in range(len(strata))]
    base = df.select(*[col(s).alias(n) for s, n in zip(strata, names, strict=True)], hash_order(key, seed).alias("_h"), col(key).alias("_k"))
    base = base.withColumn("_b", F.shiftright("_h", _HASH_BITS - _BUCKET_BITS))
    counted = scratch_path(spark, "strata-counts")
    base.groupBy(*names, "_b").agg(F.count("*").alias("_count")).write.parquet(counted)
    counts = spark.read.parquet(counted)
    whole = Window.partitionBy(*names)
    running = counts.select(
        *names, "_b", "_count", F.sum("_count").over(whole.orderBy("_b")).alias("_upto"), F.sum("_count").over(whole).alias("_n"),
    )
    asked = F.array(*[F.struct(F.lit(j).alias("j"), q.cast("long").alias("q")) for j, q in enumerate(quotas(F.col("_n")))])
    start = F.col("_upto") - F.col("_count")
    reached = F.filter(asked, lambda a: (a["q"] > 0) & (start < a["q"]) & (a["q"] <= F.col("_upto")))
    ends = running.select(*names, "_b", "_n", start.alias("_start"), F.explode(reached).alias("_a"))
    ends = ends.select(*names, "_b", "_n", F.col("_a.j").alias("_j"), (F.col("_a.q") - F.col("_start")).alias("_need"))
    inside = _met(base, ends, [*names, "_b"])
    place = F.row_number().over(Window.partitionBy(*names, "_b", "_j").orderBy("_h", "_k"))
    hits = inside.withColumn("_rn", place).where("_rn = _need")
    cut = F.struct(F.col("_j").alias("j"), F.col("_h").alias("h"), F.col("_k").alias("k"))
    made = scratch_path(spark, "strata-cuts")
    hits.groupBy(*names).agg(F.max("_n").alias("_n"), F.array_sort(F.collect_list(cut)).alias("_cuts")).write.parquet(made)
    return spark.read.parquet(made)


def _met(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns that may be null."""
    renamed = right.select(*[F.col(n).alias(f"{n}r") if n in names else F.col(n) for n in right.columns])
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}r"))
    return left.join(renamed, same, how).drop(*[f"{n}r" for n in names])


def number_in_strata(
    df: DataFrame, key: str, seed: int | str, quotas: Callable[[Column], Sequence[Column]], strata: Sequence[str], name: str
) -> tuple[DataFrame, int]:
    """Add the number of the first cut a row lies within, and say the number of rows beyond all cuts.

    Rows are read once and shuffled once. Those of hot strata are numbered by a broadcast of fewer than `HOT_SHARE` rows and
    spread evenly in the join with the other strata, where they meet nothing.
    """
    names = [f"_x{i}" for i in range(len(strata))]
    cuts = cut_table(df, key, seed, quotas, strata)
    facts = cuts.agg(F.max(F.array_max(F.transform("_cuts", lambda c: c["j"]))).alias("j")).first()
    beyond = 0 if facts["j"] is None else facts["j"] + 1
    edge = df.count() / HOT_SHARE
    hot = cuts.where(F.col("_n") > edge).select(*names, F.col("_cuts").alias("_hot"))
    rest = cuts.where(F.col("_n") <= edge).select(*names, F.lit(-1).alias("_salt"), F.col("_cuts").alias("_own"))
    h = hash_order(key, seed)
    keyed = df.select("*", *[col(s).alias(n) for s, n in zip(strata, names, strict=True)])
    known = _met(keyed, F.broadcast(hot), names, "left")
    salted = known.withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.pmod(h, F.lit(_SALTS)).cast("int")).otherwise(-1))
    joined = _met(salted, rest, [*names, "_salt"], "left")
    within = F.filter(F.coalesce("_hot", "_own"), lambda c: (h < c["h"]) | ((h == c["h"]) & (col(key) <= c["k"])))
    number = F.coalesce(F.get(within, 0)["j"], F.lit(beyond))
    return joined.select(*[col(c) for c in df.columns], number.alias(name)), beyond
