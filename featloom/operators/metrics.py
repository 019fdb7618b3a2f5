"""Classification, reproducibility and paired-comparison statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featloom.core import beside, checkpointed, clean, col, rows_frame, safe_divide
from featloom.functions.ordering import SMALL_ROWS, quantiles, range_tagged, running_sums
from featloom.operators.prepare import bin_index
from featloom.operators.profile import value_counts
from featloom.operators.set_similarity import mean_jaccard


# ---------------------------------------------------------- classification
BINARY_ONLY = ("f1", "precision", "recall", "specificity")


def _number(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def _keys(by: Sequence[str]) -> tuple[list[Column], list[str], list[Column]]:
    """Columns of `by` under names of their own, these names, and the way back."""
    names = [f"_by{i}" for i in range(len(by))]
    pairs = list(zip(by, names, strict=True))
    return [col(b).alias(n) for b, n in pairs], names, [F.col(n).alias(b) for b, n in pairs]


def class_metrics(df: DataFrame, truth: str, prediction: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Label metrics over any classes, in one pass, for each group of `by`; `weight` counts a row several times.

    Accuracy is the share of equal labels and balanced accuracy the mean recall
    over the classes of the truth. The metrics of `BINARY_ONLY` see 1 as the
    positive class; they are NULL as soon as a label other than 0 and 1 occurs.
    Zero denominators give 0.
    """
    n = F.count("*") if weight is None else F.sum(col(weight))
    keys, names, back = _keys(by)
    pairs = df.groupBy(*keys, col(truth).alias("t"), col(prediction).alias("p")).agg(n.alias("n"))
    t, p = F.col("t"), F.col("p")
    same = F.coalesce(_number(t) == _number(p), t.cast("string").eqNullSafe(p.cast("string")))
    is_ = lambda c, v: F.coalesce(_number(c) == v, F.lit(False))
    known = F.lit(True)
    for c in (t, p):
        known = known & (c.isNull() | is_(c, 0) | is_(c, 1))
    count = lambda where: F.sum(F.when(where, F.col("n")).otherwise(0))
    by_class = pairs.groupBy(*names, "t").agg(
        F.sum("n").alias("n"), count(same).alias("same"), F.bool_and(known).alias("known"), count(is_(t, 1) & is_(p, 1)).alias("tp"),
        count(is_(t, 0) & is_(p, 0)).alias("tn"), count(is_(t, 0) & is_(p, 1)).alias("fp"), count(is_(t, 1) & is_(p, 0)).alias("fn"),
    )
    got = by_class.groupBy(*names).agg(
        F.sum("n").alias("n"), F.sum("same").alias("same"), F.bool_and("known").alias("known"),
        F.avg(F.when(t.isNotNull(), F.col("same") / F.col("n"))).alias("balanced"), *[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")],
    )
    tp, tn, fp, fn = (F.coalesce(c, F.lit(0)) for c in ("tp", "tn", "fp", "fn"))
    two = {
        "f1": safe_divide(2 * tp, 2 * tp + fp + fn), "precision": safe_divide(tp, tp + fp),
        "recall": safe_divide(tp, tp + fn), "specificity": safe_divide(tn, tn + fp),
    }
    return got.select(
        *back, safe_divide(F.col("same"), F.col("n"), None).alias("accuracy"), F.coalesce("balanced", F.lit(0.0)).alias("balanced_accuracy"),
        *[F.when(F.coalesce("known", F.lit(True)), two[m]).alias(m) for m in BINARY_ONLY],
    )


def score_levels(df: DataFrame, truth: str, score: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per group and distinct score, combined map-side; groups are named `_by0`, `_by1`, ..."""
    t, n = col(truth), F.lit(1) if weight is None else col(weight)
    return df.groupBy(*_keys(by)[0], clean(col(score)).alias("score")).agg(
        F.sum(F.when(t == 1, n).otherwise(0)).alias("pos"), F.sum(F.when(t == 0, n).otherwise(0)).alias("neg")
    )


def ranking_metrics(
    df: DataFrame, truth: str, score: str, limit: int = SMALL_ROWS, weight: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """AUROC (tie-averaged), average precision and Brier score, for each group of `by`.

    Running sums go over distinct descending scores, split over range
    partitions when there are many of them.
    """
    _, names, back = _keys(by)
    levels = score_levels(df, truth, score, weight, by)
    steps = running_sums(
        levels, [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")}, limit=limit, by=names
    )
    pos, neg = F.sum("pos"), F.sum("neg")
    # negatives ranked below a positive score count 1, tied ones 1/2
    area = F.sum(F.col("pos").cast("double") * (F.col("fp") - F.col("neg") / 2))
    precision = F.sum(F.col("pos").cast("double") * F.col("tp") / (F.col("tp") + F.col("fp")))
    squared = F.sum(F.col("pos") * F.pow(F.col("score") - 1, 2) + F.col("neg") * F.pow("score", 2))
    got = steps.groupBy(*names).agg(
        pos.alias("p"), neg.alias("n"), area.alias("area"), precision.alias("precision"), squared.alias("squared")
    )
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return got.select(
        *back,
        F.when(both, 1 - F.col("area") / (F.col("p") * F.col("n"))).alias("auroc"),
        F.when(both, F.col("precision") / F.col("p")).alias("pr_auc"),
        F.when(both, F.col("squared") / (F.col("p") + F.col("n"))).alias("brier"),
        F.when(~both, F.lit("single_class")).alias("probability_reason"),
    )


def classification_metrics(df: DataFrame, truth: str, prediction: str, probability: str | None = None) -> DataFrame:
    """One row with label metrics and, given a probability, ranking metrics."""
    by = [truth, prediction] if probability is None else [truth, prediction, probability]
    # The scored rows are read once; all metrics come from their counts.
    counted = checkpointed(df.groupBy(*[col(c) for c in by]).agg(F.count("*").alias("_n")))
    if counted.isEmpty():
        raise ValueError("there are no rows to score")
    labels = class_metrics(counted, truth, prediction, "_n")
    if probability is None:
        none = F.lit(None).cast("double")
        return labels.select(
            "*", none.alias("auroc"), none.alias("pr_auc"), none.alias("brier"), F.lit("unavailable").alias("probability_reason")
        )
    return beside(labels, ranking_metrics(counted, truth, probability, weight="_n"))


def rmse(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    gap = clean(col(prediction)) - clean(col(truth))
    return df.agg(F.sqrt(F.avg(gap * gap)).alias("rmse"))


def evaluate_runs(
    df: DataFrame, by: Sequence[str], truth: str, prediction: str, score: str, inputs: Sequence[str] = (), limit: int = SMALL_ROWS
) -> DataFrame:
    """One row per run with its rows, share of missing input cells, label metrics, ranking metrics and root mean squared error.

    The scored rows of all runs are read once: metrics and missing cells come from counts per run, truth, prediction
    and score. A null run is a run of its own; no rows give no runs; without `inputs` the share is NULL.
    """
    by = list(by)
    if not by:
        raise ValueError("evaluate_runs needs at least one column that tells runs apart")
    numeric = ("double", "float")
    lost = [(clean(col(c)) if df.schema[c].dataType.typeName() in numeric else col(c)).isNull().cast("long") for c in inputs]
    keys, names, back = _keys(by)
    facts = [col(truth).alias("truth"), col(prediction).alias("prediction"), clean(col(score)).alias("score")]
    counted = df.groupBy(*keys, *facts).agg(F.count("*").alias("n"), F.sum(sum(lost[1:], lost[0]) if lost else F.lit(0)).alias("lost"))
    counted = checkpointed(counted)
    gap, n = clean(F.col("prediction")) - clean(F.col("truth")), F.sum("n")
    share = F.sum("lost") / (n * len(lost)) if lost else F.lit(None).cast("double")
    known = F.sum(F.when(gap.isNotNull(), F.col("n")))
    rows = counted.groupBy(*names).agg(n.alias("rows"), share.alias("missing_rate"), F.sqrt(F.sum(gap * gap * F.col("n")) / known).alias("rmse"))
    labels = class_metrics(counted, "truth", "prediction", "n", by=names)
    ranks = ranking_metrics(counted, "truth", "score", limit, "n", by=names)
    for other in (labels, ranks):
        twin = other.select(*[F.col(b).alias(f"{b}x") for b in names], *[c for c in other.columns if c not in names])
        same = [F.col(b).eqNullSafe(F.col(f"{b}x")) for b in names]
        rows = rows.join(twin, same).drop(*[f"{b}x" for b in names])
    return rows.select(*back, *[c for c in rows.columns if c not in names])


# fixed values: scorer names
SCORERS = ["accuracy", "f1", "neg_root_mean_squared_error"]


def scorer(name: str, df: DataFrame, truth: str, prediction: str) -> float:
    if name in ("accuracy", "f1", "precision", "recall", "balanced_accuracy"):
        value = class_metrics(df, truth, prediction).first()[name]
        if value is None:
            raise ValueError(f"{name} needs the labels 0 and 1; use accuracy or balanced_accuracy")
        return float(value)
    if name == "neg_root_mean_squared_error":
        return -float(rmse(df, truth, prediction).first()["rmse"])
    raise ValueError(f"unknown scorer: {name}")


# ------------------------------------------------------------ data quality
def missing_rate(df: DataFrame) -> DataFrame:
    """Mean over columns of the share of missing cells."""
    shares = [1 - F.count(clean(col(f.name)) if f.dataType.typeName() in ("double", "float") else col(f.name)) / F.count("*") for f in df.schema.fields]
    return df.agg((sum(shares[1:], shares[0]) / len(shares)).alias("missing_rate"))


def binned_mutual_information(df: DataFrame, target: str, bins: int = 10) -> DataFrame:
    """Mutual information in nats of each feature with the target.

    Numeric features are cut at their quantiles; gaps take the rounded mean.
    """
    numbers = [f.name for f in df.schema.fields if f.name != target and f.dataType.typeName() not in ("string", "boolean", "timestamp", "timestamp_ntz", "date")]
    texts = [f.name for f in df.schema.fields if f.name != target and f.dataType.typeName() in ("string", "boolean")]
    means = df.agg(F.count("*").alias("rows"), *[F.bround(F.avg(clean(col(c)))).alias(f"m{i}") for i, c in enumerate(numbers)]).first()
    filled = {c: F.coalesce(clean(col(c)), F.lit(means[f"m{i}"])) for i, c in enumerate(numbers)}
    edges = quantiles(df, filled, [i / bins for i in range(bins + 1)], rows=means["rows"])
    cut = {}
    for c in numbers:
        unique = [e for i, e in enumerate(edges[c]) if e is not None and (i == 0 or e != edges[c][i - 1])]
        cut[c] = bin_index(filled[c], unique) if len(unique) > 1 else F.lit(0)
    binned = df.where(col(target).isNotNull()).select(
        col(target).alias(target), *[cut[c].alias(c) for c in numbers], *[col(c) for c in texts]
    )
    joint = value_counts(binned, [*numbers, *texts], [target])
    # n * MI = sum k log k - sum a log a - sum b log b + n log n over cells and margins
    def level(keys: Sequence[str], name: str) -> DataFrame:
        k = joint.groupBy("column", *keys).agg(F.sum("count").alias("k"))
        return k.groupBy("column").agg(F.sum(F.col("k") * F.ln("k")).alias(name))

    n = joint.groupBy("column").agg(F.sum("count").alias("n"))
    cells = level(["value", target], "cells")
    rows, cols = level(["value"], "rows"), level([target], "cols")
    total = cells.join(rows, "column").join(cols, "column").join(n, "column")
    mi = (F.col("cells") - F.col("rows") - F.col("cols")) / F.col("n") + F.ln("n")
    return total.select(F.col("column").alias("feature"), F.greatest(mi, F.lit(0.0)).alias("mutual_information"))


def top_mean(df: DataFrame, value: str, k: int = 10) -> DataFrame:
    """Mean of the k largest values."""
    return df.orderBy(F.desc(value)).limit(k).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("top_mean"))


# --------------------------------------------------------- reproducibility
def reproducibility(df: DataFrame, run: str, features: str, f1: str) -> DataFrame:
    """Column-set Jaccard and the spread of feature counts and F1 over runs."""
    spread = df.agg(
        F.coalesce(F.var_samp(F.size(F.array_distinct(col(features)))), F.lit(0.0)).alias("feature_space_variance"),
        F.coalesce(F.var_samp(clean(col(f1))), F.lit(0.0)).alias("performance_variance_f1"),
    )
    jaccard = mean_jaccard(df, run, features).select(F.col("mean_jaccard").alias("action_consistency_jaccard"))
    return beside(jaccard, spread)


def aggregate_report(df: DataFrame, group: str, metrics: Sequence[str]) -> DataFrame:
    """Mean of every metric over the runs of a group."""
    return df.groupBy(col(group)).agg(*[F.avg(clean(col(m))).alias(m) for m in metrics])


# -------------------------------------------------------- paired statistics
def _exact_wilcoxon(n: int, w_plus: float) -> float:
    """Two-sided p of the signed-rank statistic without ties, by counting subsets of ranks."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for rank in range(1, n + 1):
        ways[rank:] += ways[:-rank].copy()
    ways /= ways.sum()
    low = min(w_plus, n * (n + 1) / 2 - w_plus)
    return float(min(1.0, 2 * ways[: int(low) + 1].sum()))


def signed_rank_facts(df: DataFrame, difference: str, limit: int = SMALL_ROWS) -> DataFrame:
    """Non-zero count, W+ and tie correction of tie-averaged ranks of |d|."""
    d = clean(col(difference))
    levels = (
        df.where(d.isNotNull() & (d != 0))
        .groupBy(F.abs(d).alias("size"))
        .agg(F.count("*").alias("k"), F.count_if(d > 0).alias("up"))
    )
    ranked = running_sums(levels, [F.asc("size")], {"upto": F.col("k")}, limit=limit)
    k = F.col("k").cast("double")
    middle = F.col("upto") - (k - 1) / 2
    return ranked.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("nonzero"),
        F.coalesce(F.sum(F.col("up") * middle), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(k * k * k - k), F.lit(0.0)).alias("ties"),
    )


def wilcoxon_p(pairs: int, nonzero: int, w_plus: float, ties: float) -> float | None:
    """Exact up to 50 pairs without ties or zeros, else the normal approximation."""
    if pairs <= 1 or nonzero == 0:
        return None
    n = nonzero
    if pairs <= 50 and ties == 0 and nonzero == pairs:
        return _exact_wilcoxon(n, w_plus)
    mean = n * (n + 1) / 4
    variance = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    if variance <= 0:
        return 1.0
    # the statistic is the smaller rank sum
    low = min(w_plus, n * (n + 1) / 2 - w_plus)
    return float(min(1.0, math.erfc(abs(low - mean) / math.sqrt(variance) / math.sqrt(2))))


def paired_summary(left: DataFrame, right: DataFrame, pair: str, value: str) -> DataFrame:
    """Paired differences: centre, spread, 95% interval, effect size, signed-rank p."""
    joined = left.select(col(pair).alias("pair"), clean(col(value)).alias("a")).join(
        right.select(col(pair).alias("pair"), clean(col(value)).alias("b")), "pair", "full"
    )
    diff = joined.select("pair", (F.col("a") - F.col("b")).alias("d"))
    got = diff.agg(F.count("*").alias("rows"), F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd")).first()
    if got["rows"] == 0 or got["rows"] != got["n"]:
        raise ValueError("a paired comparison takes one value on each side for every pair, and at least one pair")
    median = quantiles(diff, {"d": F.col("d")}, [0.5], rows=got["rows"])["d"][0]
    facts = signed_rank_facts(diff, "d").first()
    n, mean, sd = got["n"], got["mean"], got["sd"]
    margin = None if sd is None else 1.96 * sd / math.sqrt(n)
    row = (
        n, mean, median, sd, None if margin is None else mean - margin, None if margin is None else mean + margin,
        mean / sd if sd else None, wilcoxon_p(n, facts["nonzero"], facts["w_plus"], facts["ties"]),
    )
    return rows_frame(
        left.sparkSession, [row],
        "pairs long, mean_difference double, median_difference double, sd_difference double, ci95_low double, "
        "ci95_high double, cohen_dz double, wilcoxon_p double",
    )


def holm_adjust(df: DataFrame, key: str, p_value: str, limit: int = SMALL_ROWS) -> DataFrame:
    """Add `adjusted`: running maximum of min(1, (m - rank) * p) in ascending order."""
    m = df.count()
    order = [col(p_value).asc(), col(key).asc()]
    numbered = running_sums(df, order, {"_position": F.lit(1).cast("long")}, rows=m, limit=limit)
    step = F.least(F.lit(1.0), (F.lit(m) - F.col("_position") + 1) * clean(col(p_value)))
    stepped = numbered.withColumn("_step", step)
    tagged, parts = range_tagged(stepped, [F.col("_position")], rows=m, limit=limit)
    upto = (Window.unboundedPreceding, 0)
    if parts == 1:
        best = F.max("_step").over(Window.orderBy("_position").rowsBetween(*upto))
        return stepped.select(*[col(c) for c in df.columns], best.alias("adjusted"))
    local = F.max("_step").over(Window.partitionBy("_part").orderBy("_position").rowsBetween(*upto))
    peaks = tagged.groupBy("_part").agg(F.max("_step").alias("_peak"))
    before = F.max("_peak").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = peaks.select("_part", before.alias("_before"))
    # one row per range partition
    joined = tagged.withColumn("_local", local).join(F.broadcast(carried), "_part")
    return joined.select(*[col(c) for c in df.columns], F.greatest("_local", "_before").alias("adjusted"))


# ------------------------------------------------------------- run records
def run_conditions(records: DataFrame) -> DataFrame:
    """One row per run and condition."""
    return records.select("split_seed", "repetition", F.explode("conditions").alias("condition", "_c")).select(
        "split_seed", "repetition", "condition", "_c.*"
    )


def condition_summary(conditions: DataFrame) -> DataFrame:
    """Runs, successes, failures and mean metrics over succeeded runs."""
    ok = F.col("status") == "succeeded"
    return conditions.groupBy("condition").agg(
        F.count("*").alias("runs"),
        F.count_if(ok).alias("successful_runs"),
        F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed_runs"),
        *[F.avg(F.when(ok, clean(F.col(m)))).alias(f"mean_{m}") for m in ("accuracy", "f1", "auroc", "pr_auc")],
    )


def dimension_counts(conditions: DataFrame) -> DataFrame:
    """Counts by condition, status, stage, reason and phase."""
    fields = [
        ("condition", F.col("condition")),
        ("status", F.coalesce("status", F.lit("unknown"))),
        *[(n, F.coalesce(F.col(n), F.lit("none"))) for n in ("stage", "reason", "phase")],
    ]
    pairs = F.array(*[F.struct(F.lit(n).alias("dimension"), c.alias("value")) for n, c in fields])
    return conditions.select(F.explode(pairs).alias("x")).groupBy("x.dimension", "x.value").count()


def failure_stage_counts(conditions: DataFrame) -> DataFrame:
    counts = dimension_counts(conditions)
    return counts.where("dimension = 'stage' and value <> 'none'").select(F.col("value").alias("stage"), "count")


def run_summary(runs: DataFrame, run: str, operations: str = "operations") -> DataFrame:
    """Means and spreads over succeeded runs plus operation Jaccard."""
    good = runs.where("status = 'succeeded'")
    means = [F.avg(F.when(F.col("status") == "succeeded", clean(F.col(m)))).alias(f"mean_{m}") for m in ("accuracy", "f1", "auroc")]
    sds = [F.stddev_samp(F.when(F.col("status") == "succeeded", clean(F.col(m)))).alias(f"sd_{m}") for m in ("accuracy", "f1", "auroc")]
    counts = runs.agg(
        F.count("*").alias("total_runs"), F.count_if(F.col("status") == "succeeded").alias("successful_runs"),
        F.count_if(F.col("status") != "succeeded").alias("failed_runs"), *means, *sds,
    )
    jaccard = mean_jaccard(good, run, operations, empty_union=1.0, single=None)
    return beside(counts, jaccard.select(F.col("mean_jaccard").alias("operation_jaccard")))
