"""Class balancing: exact nearest neighbours and interpolated minority rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from featloom.core import col, written
from featloom.functions.ordering import running_sums
from featloom.operators.metric_tree import nearest
from featloom.plans.plan import SAMPLING

_BATCH = 10_000


@dataclass(frozen=True)
class Sampler:
    """A function of (df, target, classes, features, key, seed); `classes` holds the aggregates by class."""

    take: Callable[..., DataFrame]
    aggregates: Callable[[], Mapping[str, Column]] | None


_SAMPLERS: dict[str, Sampler] = {}


def register_sampler(method: str, aggregates: Callable[[], Mapping[str, Column]] | None = None):
    """Add a sampler `f(df, target, classes, features, key, seed) -> df` that plans and `resample` may name.

    `aggregates` names sums that are made per class, in one pass, before the sampler is called; without it
    `classes` is empty.
    """

    def decorate(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _SAMPLERS[method] = Sampler(function, aggregates)
        if method not in SAMPLING:
            SAMPLING.append(method)
        return function

    return decorate


def resample(
    df: DataFrame, target: str, features: Sequence[str], method: str, key: str | None = None, seed: int = 42
) -> DataFrame:
    """Rows chosen or made by a registered sampler."""
    if method not in _SAMPLERS:
        raise ValueError(f"unsupported sampler: {method}")
    sampler, classes = _SAMPLERS[method], {}
    if sampler.aggregates is not None:
        sums = sampler.aggregates()
        grouped = df.groupBy(col(target).alias("class")).agg(*[a.alias(k) for k, a in sums.items()])
        # one row per class, as for the samplers that raise one class after another
        classes = {r["class"]: {k: r[k] for k in sums} for r in grouped.toLocalIterator()}
    return sampler.take(df, target, classes, features, key, seed)


def _uniform(*parts: Column) -> Column:
    """Reproducible number in [0, 1)."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _weighted_neighbours(found: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """Neighbour positions [start, stop) of each id; copies of a point count each."""
    weights = points.select(F.col("id").alias("other"), F.col("class").alias("other_class"), F.col("copies").alias("w"))
    joined = found.join(weights, "other")
    own = F.when(F.col("id") == F.col("other"), F.col("w") - 1).otherwise(F.col("w"))
    w = Window.partitionBy("id").orderBy("distance", "other")
    spans = joined.withColumn("w", own).where("w > 0").withColumn("stop", F.sum("w").over(w))
    return spans.withColumn("start", F.col("stop") - F.col("w")).where(F.col("start") < k)


def oversample(
    df: DataFrame, target: str, features: Sequence[str], method: str = "SMOTE", key: str | None = None, seed: int = 42
) -> DataFrame:
    """Raise every class to the majority size with interpolated rows.

    A new row lies between a row and one of its nearest rows of the class. The
    borderline form starts only from rows whose ten nearest rows belong at
    least half, but not all, to other classes.
    """
    features = list(features)
    # Each class is raised by jobs of its own, so the driver knows them all.
    sizes = list(df.groupBy(col(target).alias("class")).count().toLocalIterator())
    if not sizes or any(r["class"] is None for r in sizes):
        raise ValueError("sampling requires a class label on every row")
    counts = {r["class"]: r["count"] for r in sizes}
    if min(counts.values()) < 2:
        raise ValueError("sampling requires at least two rows per class")
    top = max(counts.values())
    k = min(5, min(counts.values()) - 1)
    vec = F.array(*[col(c).cast("double") for c in features])
    # copies are collapsed map-side, so a hot vector is one row from here on; written once, as each search reads them several times
    points = (
        df.select(col(target).alias("class"), vec.alias("vec"))
        .groupBy("class", "vec")
        .agg(F.count("*").alias("copies"))
        .withColumn("id", F.md5(F.concat_ws("|", F.col("class").cast("string"), F.col("vec").cast("string"))))
    )
    points = written(points, "points")
    out = df
    for label, size in sorted(counts.items(), key=lambda x: str(x[0])):
        if size == top:
            continue
        mine = points.where(F.col("class") == F.lit(label))
        seeds, seed_rows = mine, size
        if method == "BORDERLINE_SMOTE":
            around = _weighted_neighbours(nearest(mine, points, 11), points, 10)
            inside = F.least("stop", F.lit(10)) - F.col("start")
            others = around.groupBy("id").agg(
                F.sum(F.when(F.col("other_class") != F.lit(label), inside).otherwise(0)).alias("others"), F.sum(inside).alias("all")
            )
            danger = others.where((F.col("others") * 2 >= F.col("all")) & (F.col("others") < F.col("all"))).select("id")
            # the search behind these rows is made once
            seeds = written(mine.join(danger, "id", "left_semi"), "seeds")
            seed_rows = seeds.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
            if not seed_rows:
                continue
        out = out.unionByName(
            _synthetic(mine, seeds, seed_rows, top - size, k, df, target, label, features, seed), allowMissingColumns=True
        )
    return out


def _synthetic(mine, seeds, seed_rows, wanted, k, df, target, label, features, seed) -> DataFrame:
    # the share of each seed in hash order, so that the shares sum to `wanted`
    order = F.xxhash64("id", F.lit(seed))
    shared = running_sums(seeds.withColumn("_h", order), [F.asc("_h"), F.asc("id")], {"_upto": F.col("copies")})
    upto = F.floor(F.col("_upto") * F.lit(wanted) / F.lit(seed_rows))
    before = F.floor((F.col("_upto") - F.col("copies")) * F.lit(wanted) / F.lit(seed_rows))
    used = written(shared.select("id", "vec", (upto - before).cast("long").alias("share")).where("share > 0"), "used")
    # a seed with a huge share is spread over many rows before it is expanded
    batches = used.select(
        "id", "vec", "share", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("share") - 1) / _BATCH))).alias("batch")
    )
    first = F.col("batch") * _BATCH
    last = F.least(first + _BATCH, F.col("share")) - 1
    copies = batches.repartition(F.col("id"), F.col("batch")).select("id", "vec", F.explode(F.sequence(first, last)).alias("i"))
    picks = copies.select(
        "id", "vec", _uniform(F.col("id"), F.col("i"), F.lit(seed)).alias("u"),
        F.floor(_uniform(F.col("i"), F.col("id"), F.lit(seed + 1)) * k).alias("pick"),
    )
    spans = _weighted_neighbours(nearest(used, mine, k + 1), mine, k).select("id", "other", "start", "stop")
    partner = mine.select(F.col("id").alias("other"), F.col("vec").alias("partner"))
    known = spans.join(partner, "other")
    # at most k spans per id, exactly one of which holds the pick
    spots = known.groupBy("id").agg(F.collect_list(F.struct("start", "stop", "partner")).alias("spans"))
    made = picks.join(spots, "id").select(
        "vec", "u",
        F.get(F.filter("spans", lambda s: (s["start"] <= F.col("pick")) & (F.col("pick") < s["stop"])), 0)["partner"].alias("partner"),
    )
    values = F.zip_with("vec", "partner", lambda a, b: a + F.col("u") * (b - a))
    rows = made.select(values.alias("v"))
    return rows.select(
        *[F.get("v", i).alias(c) for i, c in enumerate(features)], F.lit(label).cast(df.schema[target].dataType).alias(target)
    )


@register_sampler("SMOTE")
def _smote(df, target, classes, features, key, seed):
    return oversample(df, target, features, "SMOTE", key=key, seed=seed)


@register_sampler("BORDERLINE_SMOTE")
def _borderline(df, target, classes, features, key, seed):
    return oversample(df, target, features, "BORDERLINE_SMOTE", key=key, seed=seed)
