"""Models, plan selection, comparison arms and streaming scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from featloom.catalogue.base import query, shaped, table
from featloom.core import scratch_path, written
from featloom.operators import model as k
from featloom.operators import relate
from featloom.operators.metrics import classification_metrics
from featloom.operators.prepare import fit_baseline
from featloom.operators.split import outcome_partitions
from featloom.plans.select import Candidate, PlanSelector, SelectionConfig, run_comparison
from featloom.plans.parse import ValidationContext
from featloom.streaming.scoring import read_submissions, score_stream, write_scores


def fused_orders(spark, d):
    """Orders with counts, sums and means of their lines."""
    es = relate.EntitySet()
    es.add_entity("orders", table(spark, d, "orders").drop("o_orderdate", "o_custkey"), "o_orderkey")
    items = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount")
    es.add_entity("lines", items.withColumn("line", F.monotonically_increasing_id()), "line", check_key=False)
    es.add_relation("orders", "o_orderkey", "lines", "l_orderkey")
    fused, _ = relate.synthesise(es, "orders", sanitise=True, agg=["count", "sum", "mean"], transform=[], max_depth=1)
    return fused.na.fill(0.0)


def parts(spark, d):
    fused = fused_orders(spark, d)
    # the outcome is the price of the order's lines, which the other features only hint at
    kept = ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "COUNT_lines", "SUM_lines_l_quantity", "MEAN_lines_l_discount", "SUM_lines_l_extendedprice"]
    # the joins run once, not once per fitted scalar
    return outcome_partitions(written(fused.select(*kept), "fused"), "o_orderkey", "SUM_lines_l_extendedprice")


def flagship(spark, d):
    got = parts(spark, d)
    scored = k.fixed_model(got.train, got.test, "target", ["o_orderkey"])
    return classification_metrics(scored, "target", "prediction", "probability")


@query("k1_fixed_model")
def k1(spark, d):
    return flagship(spark, d)


def _search(spark, d, **options):
    got = parts(spark, d)
    return got, k.ModelSearch().train(got.train, "o_orderkey", "target", folds=2, **options)


@query("k2_model_search")
def k2(spark, d):
    _, search = _search(spark, d)
    return search.describe(spark, "info")


@query("k3_predict")
def k3(spark, d):
    got, search = _search(spark, d, algorithms=["linear"])
    return search.predict(got.test)


@query("k4_save_and_load")
def k4(spark, d):
    got, search = _search(spark, d, algorithms=["linear"])
    path = scratch_path(spark, "model")
    search.save(spark, path)
    return k.ModelSearch.load(spark, path).predict(got.test).groupBy("prediction").count()


@query("k5_predict_dataset")
def k5(spark, d):
    got, search = _search(spark, d, algorithms=["linear"])
    return search.predict_dataset(got.test.drop("o_orderkey"), "target")


@query("k6_score_stream")
def k6(spark, d):
    got = parts(spark, d)
    fitted = fit_baseline(got.train, "target", ["o_orderkey"])
    prepared = fitted.transform(got.train)
    trained = k.fit_estimator(prepared, fitted.output_columns, "target", k.logistic(42, prepared.count()))
    folder, out, state = (scratch_path(spark, n) for n in ("submitted", "scores", "state"))
    got.test.drop("target").repartition(4).write.parquet(folder)
    stream = read_submissions(spark, folder, got.test.drop("target").schema, maxFilesPerTrigger=2)
    write_scores(score_stream(stream, fitted, trained).select("o_orderkey", "prediction", "probability"), out, state).awaitTermination()
    return spark.read.parquet(out)


def _step(column, *methods):
    listed = ", ".join(f'"{m}"' for m in methods)
    return f'{{"column": "{column}", "methods": [{listed}]}}'


def _text(cleaning=(), encoding=(), transformation=(), sampling=()):
    join = ", ".join
    return (
        '{"data_quality_report": {"overall_quality": "GOOD", "summary": "", "issues": [], "strengths": []}, "modeling_approaches": [{"task_type": "CLASSIFICATION", '
        '"target": "target", "recommended_algorithm": {"name": "logistic", "reason": "", "params": {}}, "evaluation_metrics": ["F1"], '
        '"cross_validation": {"method": "K_FOLD", "folds": 2, "stratified": true}, '
        f'"data_cleaning": {{"missing_values": [{join(cleaning)}], "sampling": [{join(sampling)}]}}, '
        f'"feature_engineering": {{"encoding": [{join(encoding)}], "transformation": [{join(transformation)}], "extraction": []}}, "test_size": 0.2, "validation_size": 0.1}}]}}'
    )


_ENCODE = [_step("o_orderstatus", "ONE_HOT_ENCODE"), _step("o_orderpriority", "STRING_INDEX")]
CANDIDATES = [
    Candidate("scaled", _text([_step("o_totalprice", "MEDIAN")], _ENCODE, [_step("o_totalprice", "MIN_MAX_SCALE"), _step("COUNT_lines", "STANDARDIZE")])),
    Candidate("unknown_column", _text([_step("absent", "MEAN")], _ENCODE)),
    Candidate("no_plan", "nothing to see"),
]
CONTEXT = ValidationContext("target", "CLASSIFICATION", ids=frozenset(["o_orderkey"]))


@query("p5_select_plan")
def p5(spark, d):
    train = parts(spark, d).train
    return PlanSelector(context=CONTEXT).select(train, "o_orderkey", "target", CANDIDATES, SelectionConfig(folds=2)).frame()


@query("p6_run_comparison")
def p6(spark, d):
    got = parts(spark, d)

    def doubled(train, holdout):
        made = [f.withColumn("o_totalprice", F.col("o_totalprice") * 2) for f in (train, holdout)]
        return made[0], made[1]

    return run_comparison(
        got.train, got.test, "o_orderkey", "target", CANDIDATES, CONTEXT, ["deterministic", "user_function", "guarded", "without_cv"],
        SelectionConfig(folds=2), user_function=doubled,
    )


@query("d6_cross_validation", "SELECT count(*) AS rows, CAST(2 AS BIGINT) AS folds FROM labels")
def d6(spark, d):
    labels = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    found = k.cross_validate(labels, "doc_id", ["n_chars", "toxic"], "quality", lambda seed: k.logistic(seed), folds=2)
    return shaped(found.agg(F.count("*").alias("rows"), F.count_distinct("fold").alias("folds")))


@query("v6_evaluate_run")
def v6(spark, d):
    return k.evaluate_run(parts(spark, d).train, "o_orderkey", "target")


@query("t4_feature_importance")
def t4(spark, d):
    from pyspark.ml.classification import RandomForestClassifier

    got = parts(spark, d)
    fitted = fit_baseline(got.train, "target", ["o_orderkey"])
    forest = k.fit_estimator(fitted.transform(got.train), fitted.output_columns, "target", RandomForestClassifier(seed=42))
    return k.feature_importance(forest, fitted.output_columns, spark)
