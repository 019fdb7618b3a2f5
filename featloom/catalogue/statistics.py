"""Metrics, paired statistics and run summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from featloom.catalogue.base import query, shaped, table
from featloom.catalogue.sources import RUN_ROWS, run_records
from featloom.operators import metrics as m


def scored(spark, d):
    """Lines as truth, prediction and a coarse score with many ties."""
    discount = F.col("l_discount")
    return table(spark, d, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("truth"), (discount > 0.05).cast("int").alias("guess"), (discount * 10).alias("score")
    )


_SCORED = "(SELECT CAST(l_returnflag = 'R' AS INTEGER) AS truth, CAST(l_discount > 0.05 AS INTEGER) AS guess, l_discount * 10 AS score FROM lineitem)"


@query(
    "v1_class_metrics",
    f"""WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE truth = 1 AND guess = 1) AS tp, count(*) FILTER (WHERE truth = 0 AND guess = 0) AS tn,
      count(*) FILTER (WHERE truth = 0 AND guess = 1) AS fp, count(*) FILTER (WHERE truth = 1 AND guess = 0) AS fn FROM {_SCORED})
    SELECT round((tp + tn) / n, 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
      round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity FROM c""",
)
def v1(spark, d):
    return shaped(m.class_metrics(scored(spark, d), "truth", "guess"))


_AUROC = f"""WITH g AS (SELECT score, count(*) AS k, sum(truth) AS p FROM {_SCORED} GROUP BY score),
  r AS (SELECT p, k, sum(k) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) - (k - 1) / 2 AS rank FROM g)"""


@query("v2_auroc", _AUROC + "SELECT round((sum(p * rank) - sum(p) * (sum(p) + 1) / 2) / (CAST(sum(p) AS DOUBLE) * (sum(k) - sum(p))), 6) AS auroc FROM r")
def v2(spark, d):
    return shaped(m.ranking_metrics(scored(spark, d), "truth", "score").select("auroc"))


@query(
    "v2_auroc_in_ranges",
    """WITH s AS (SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS truth, o_totalprice AS score FROM orders),
    r AS (SELECT truth, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rank FROM s)
    SELECT round((sum(truth * rank) - sum(truth) * (sum(truth) + 1) / 2) / (CAST(sum(truth) AS DOUBLE) * (count(*) - sum(truth))), 6) AS auroc FROM r""",
)
def v2_ranges(spark, d):
    orders = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("truth"), F.col("o_totalprice").alias("score"))
    return shaped(m.ranking_metrics(orders, "truth", "score", limit=4_000).select("auroc"))


@query(
    "v3_pr_auc",
    f"""WITH g AS (SELECT score, count(*) AS k, sum(truth) AS p FROM {_SCORED} GROUP BY score),
    r AS (SELECT p, sum(p) OVER w / sum(k) OVER w AS precision FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
    SELECT round(sum(p * precision) / sum(p), 6) AS pr_auc FROM r""",
)
def v3(spark, d):
    return shaped(m.ranking_metrics(scored(spark, d), "truth", "score").select("pr_auc"))


@query("v4_brier", f"SELECT round(avg(pow(score - truth, 2)), 6) AS brier FROM {_SCORED}")
def v4(spark, d):
    return shaped(m.ranking_metrics(scored(spark, d), "truth", "score").select("brier"))


@query("v5_rmse", f"SELECT round(sqrt(avg(pow(score - truth, 2))), 6) AS rmse FROM {_SCORED}")
def v5(spark, d):
    return shaped(m.rmse(scored(spark, d), "truth", "score"))


@query("v6_missing_rate", "SELECT round((avg(CAST(l_linenumber = 7 AS INTEGER)) + avg(CAST(l_quantity = 50 AS INTEGER)) + avg(CAST(l_linenumber = 3 AS INTEGER))) / 8, 6) AS missing_rate FROM lineitem")
def v6(spark, d):
    from featloom.catalogue.measures import lines

    return shaped(m.missing_rate(lines(spark, d)))


_RUNS = "(SELECT l_linenumber AS run, CAST(l_returnflag = 'R' AS INTEGER) AS truth, CAST(l_discount > 0.05 AS INTEGER) AS guess, l_extendedprice / 1000000 AS score, l_quantity FROM lineitem)"


@query(
    "v8_evaluate_runs",
    f"""WITH s AS {_RUNS}, g AS (SELECT run, score, count(*) AS k, sum(truth) AS p FROM s GROUP BY ALL),
    r AS (SELECT run, k, p, sum(k) OVER (PARTITION BY run ORDER BY score ROWS UNBOUNDED PRECEDING) - (k - 1) / 2 AS rank, sum(p) OVER w / sum(k) OVER w AS precision
      FROM g WINDOW w AS (PARTITION BY run ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    a AS (SELECT run, (sum(p * rank) - sum(p) * (sum(p) + 1) / 2) / (CAST(sum(p) AS DOUBLE) * (sum(k) - sum(p))) AS auroc, sum(p * precision) / sum(p) AS pr_auc FROM r GROUP BY run),
    c AS (SELECT run, count(*) AS rows, avg(CAST(l_quantity = 50 AS INTEGER)) / 2 AS missing_rate, avg(pow(score - truth, 2)) AS brier, sqrt(avg(pow(guess - truth, 2))) AS rmse,
      count(*) FILTER (WHERE truth = 1 AND guess = 1) AS tp, count(*) FILTER (WHERE truth = 0 AND guess = 0) AS tn, count(*) FILTER (WHERE truth = 0 AND guess = 1) AS fp, count(*) FILTER (WHERE truth = 1 AND guess = 0) AS fn FROM s GROUP BY run)
    SELECT run, rows, round(missing_rate, 6) AS missing_rate, round(rmse, 6) AS rmse, round((tp + tn) / rows, 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy,
      round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity,
      round(auroc, 6) AS auroc, round(pr_auc, 6) AS pr_auc, round(brier, 6) AS brier FROM c JOIN a USING (run)""",
)
def v8_runs(spark, d):
    lines = table(spark, d, "lineitem").select(
        F.col("l_linenumber").alias("run"), (F.col("l_returnflag") == "R").cast("int").alias("truth"), (F.col("l_discount") > 0.05).cast("int").alias("guess"),
        (F.col("l_extendedprice") / 1000000).alias("score"), F.when(F.col("l_quantity") != 50, F.col("l_quantity")).alias("quantity"),
    )
    return shaped(m.evaluate_runs(lines, ["run"], "truth", "guess", "score", ["quantity", "score"]).drop("probability_reason"))


def _user_runs(spark, d):
    step = F.concat("event_type", F.when(F.col("value") < 8, (F.rint("value").cast("int") % 4).cast("string")).otherwise("high"))
    return table(spark, d, "events").groupBy("user_id").agg(
        F.collect_set(step).alias("operations"), F.count("*").alias("n"), (F.count("*") / 1000).alias("f1")
    )


_USER_RUNS = """WITH s AS (SELECT user_id, list(DISTINCT event_type || CASE WHEN value < 8 THEN CAST(CAST(value AS INTEGER) % 4 AS VARCHAR) ELSE 'high' END) AS ops, count(*) AS n, count(*) / 1000 AS f1
  FROM events GROUP BY user_id)"""
_JACCARD = "(SELECT avg(len(list_intersect(a.ops, b.ops)) * 1.0 / len(list_distinct(list_concat(a.ops, b.ops)))) FROM {0} a JOIN {0} b ON a.user_id < b.user_id)"


@query("v8_reproducibility", _USER_RUNS + f"SELECT round({_JACCARD.format('s')}, 6) AS action_consistency_jaccard, round(var_samp(len(ops)), 6) AS feature_space_variance, round(var_samp(f1), 10) AS performance_variance_f1 FROM s")
def v8(spark, d):
    got = m.reproducibility(_user_runs(spark, d), "user_id", "operations", "f1")
    return shaped(
        got.select(
            *[F.round(c, 6).alias(c) for c in ("action_consistency_jaccard", "feature_space_variance")], "performance_variance_f1"
        ),
        10,
    )


@query("v9_aggregate_report", "SELECT p_type, round(avg(p_retailprice), 4) AS p_retailprice, round(avg(p_size), 4) AS p_size FROM part GROUP BY p_type")
def v9(spark, d):
    return shaped(m.aggregate_report(table(spark, d, "part"), "p_type", ["p_retailprice", "p_size"]), 4)


def _sides(spark, d):
    orders = table(spark, d, "orders")
    done = F.col("o_orderstatus") == "F"
    sides = [orders.where(w).groupBy("o_custkey").agg((F.avg("o_totalprice") / 100000).alias("v")) for w in (done, ~done)]
    return [a.join(b.select("o_custkey"), "o_custkey", "left_semi") for a, b in (sides, sides[::-1])]


_DIFF = """WITH d AS (SELECT a.o_custkey, a.v - b.v AS d FROM (SELECT o_custkey, avg(o_totalprice) / 100000 AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) a
  JOIN (SELECT o_custkey, avg(o_totalprice) / 100000 AS v FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey) b USING (o_custkey))"""


@query(
    "v10_paired_summary",
    _DIFF + """SELECT count(*) AS pairs, round(avg(d), 6) AS mean_difference, round(median(d), 6) AS median_difference, round(stddev_samp(d), 6) AS sd_difference,
    round(avg(d) - 1.96 * stddev_samp(d) / sqrt(count(*)), 6) AS ci95_low, round(avg(d) + 1.96 * stddev_samp(d) / sqrt(count(*)), 6) AS ci95_high, round(avg(d) / stddev_samp(d), 6) AS cohen_dz FROM d""",
)
def v10(spark, d):
    return shaped(m.paired_summary(*_sides(spark, d), "o_custkey", "v").drop("wilcoxon_p"))


@query("v10_signed_rank", """WITH x AS (SELECT l_quantity - 25 AS d FROM lineitem WHERE l_quantity <> 25), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rank FROM x)
    SELECT count(*) AS nonzero, round(sum(rank) FILTER (WHERE d > 0), 2) AS w_plus, (SELECT sum(CAST(k AS DOUBLE) * k * k - k) FROM (SELECT count(*) AS k FROM x GROUP BY abs(d))) AS ties FROM r""")
def v10_ranks(spark, d):
    return shaped(m.signed_rank_facts(table(spark, d, "lineitem").select((F.col("l_quantity") - 25).alias("d")), "d"), 2)


@query("v10_wilcoxon_p")
def v10_p(spark, d):
    return m.paired_summary(*_sides(spark, d), "o_custkey", "v").select("pairs", "wilcoxon_p")


@query(
    "v11_condition_summary",
    RUN_ROWS + """SELECT condition, count(*) AS runs, count(*) FILTER (WHERE status = 'succeeded') AS successful_runs, count(*) FILTER (WHERE status <> 'succeeded') AS failed_runs,
    round(avg(accuracy) FILTER (WHERE status = 'succeeded'), 6) AS mean_accuracy, round(avg(f1) FILTER (WHERE status = 'succeeded'), 6) AS mean_f1,
    round(avg(auroc) FILTER (WHERE status = 'succeeded'), 6) AS mean_auroc, round(avg(pr_auc) FILTER (WHERE status = 'succeeded'), 6) AS mean_pr_auc FROM runs GROUP BY condition""",
)
def v11(spark, d):
    return shaped(m.condition_summary(m.run_conditions(run_records(spark, d))))


@query(
    "v12_dimension_counts",
    RUN_ROWS + """SELECT dimension, value, count(*) AS count FROM (SELECT 'condition' AS dimension, condition AS value FROM runs UNION ALL SELECT 'status', status FROM runs
    UNION ALL SELECT 'stage', coalesce(stage, 'none') FROM runs UNION ALL SELECT 'reason', coalesce(reason, 'none') FROM runs UNION ALL SELECT 'phase', coalesce(phase, 'none') FROM runs) GROUP BY ALL""",
)
def v12(spark, d):
    return m.dimension_counts(m.run_conditions(run_records(spark, d)))


@query("v12_failure_stages", RUN_ROWS + "SELECT stage, count(*) AS count FROM runs WHERE stage IS NOT NULL GROUP BY stage")
def v12_stages(spark, d):
    return m.failure_stage_counts(m.run_conditions(run_records(spark, d)))


@query(
    "v13_run_summary",
    _USER_RUNS + f""", g AS (SELECT * FROM s WHERE n % 5 <> 0)
    SELECT (SELECT count(*) FROM s) AS total_runs, count(*) AS successful_runs, (SELECT count(*) FROM s WHERE n % 5 = 0) AS failed_runs, round(avg(n / 100), 6) AS mean_accuracy, round(avg(f1), 6) AS mean_f1,
    CAST(NULL AS DOUBLE) AS mean_auroc, round(stddev_samp(n / 100), 6) AS sd_accuracy, round(stddev_samp(f1), 6) AS sd_f1, CAST(NULL AS DOUBLE) AS sd_auroc,
    round({_JACCARD.format('g')}, 6) AS operation_jaccard FROM g""",
)
def v13(spark, d):
    runs = _user_runs(spark, d).withColumns(
        {
            "status": F.when(F.col("n") % 5 != 0, "succeeded").otherwise("failed"),
            "accuracy": F.col("n") / 100,
            "auroc": F.lit(None).cast("double"),
        }
    )
    return shaped(m.run_summary(runs, "user_id"))
