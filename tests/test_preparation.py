import math

import pytest
from pyspark.sql import functions as F

from featloom.operators import prepare as p
from featloom.operators.ordered import backward_fill, discrete_cosine, forward_fill
from featloom.plans.plan import Plan

PLAN = Plan.of(
    "target", missing_values=[("age", ["MEDIAN"])], transformation=[("age", ["STANDARDIZE"])], encoding=[("city", ["ONE_HOT_ENCODE"])]
)


def frames(spark):
    schema = "id string, age double, city string, target int"
    train = spark.createDataFrame([("a", 1.0, "A", 0), ("b", None, "B", 1), ("c", 2.0, "A", 0), ("d", 3.0, "B", 1)], schema)
    holdout = spark.createDataFrame([("x", 100.0, "C", 0), ("y", None, "A", 1)], schema)
    return train, holdout


def test_schema_is_frozen_and_holdout_does_not_change_the_fit(spark):
    train, holdout = frames(spark)
    fitted = p.Preparation().fit(train, PLAN, passthrough=["id"])
    assert fitted.output_columns == ["age", "city_A", "city_B"]
    rows = {r["id"]: r for r in fitted.transform(holdout).collect()}
    assert (rows["x"]["city_A"], rows["x"]["city_B"]) == (0.0, 0.0)
    assert rows["y"]["age"] == 0.0
    assert {r["id"]: r["age"] for r in fitted.transform(train).collect()}["b"] == 0.0
    assert fitted.manifest["training_rows"] == 4


def test_strict_and_lenient_missing_input(spark):
    train, holdout = frames(spark)
    with pytest.raises(ValueError, match="missing input column"):
        p.Preparation().fit(train, PLAN, passthrough=["id"]).transform(holdout.drop("age"))
    lenient = p.Preparation(strict=False).fit(train, PLAN, passthrough=["id"]).transform(holdout.drop("age"))
    assert {r["age"] for r in lenient.collect()} == {0.0}


def test_fit_rejects_bad_plans(spark):
    train, _ = frames(spark)
    with pytest.raises(ValueError, match="does not match"):
        p.Preparation().fit(train, PLAN, target="city")
    with pytest.raises(ValueError, match="missing column"):
        p.Preparation().fit(train, Plan.of("target", missing_values=[("nope", ["MEAN"])]))
    with pytest.raises(ValueError, match="extraction"):
        p.Preparation().fit(train, Plan.of("target", extraction=[("age", ["PCA"])]))
    with pytest.raises(ValueError, match="not supported"):
        p.Preparation().fit(train, Plan.of("target", transformation=[("age", ["NORMALIZE"])]))


def test_masks_keep_chosen_methods_and_leave_the_source():
    plan = Plan.of("t", missing_values=[("a", ["MEAN", "MEDIAN"])])
    kept = plan.keep({"missing_values": {0: [False, True]}})
    assert kept.missing_values[0].methods == ("MEDIAN",)
    assert plan.missing_values[0].methods == ("MEAN", "MEDIAN")
    with pytest.raises(ValueError, match="3 selections"):
        plan.keep({"missing_values": {0: [True, True, True]}})


def test_target_bins_use_training_quantiles(spark):
    train = spark.createDataFrame([(i, "c", i) for i in range(8)], "age long, city string, target long")
    fitted = p.Preparation().fit(train, Plan.of("target", task_type="REGRESSION"), target_quantiles=[0, 0.75, 1])
    assert fitted.edges == [-math.inf, 5.25, math.inf]
    holdout = spark.createDataFrame([(0, "c", -100), (0, "c", 100)], "age long, city string, target long")
    assert [r["target"] for r in fitted.transform(holdout).collect()] == [0, 1]


def test_balancing_raises_only_the_training_minority(spark):
    df = spark.createDataFrame([(i, float(i), "AB"[i % 2], 0 if i < 9 else 1) for i in range(12)], "id int, age double, city string, target int")
    fitted = p.Preparation().fit(df, Plan.of("target", sampling=[("target", ["SMOTE"])]), passthrough=["id"])
    balanced = fitted.fit_resample_training(df, key="id")
    assert {r["target"]: r["count"] for r in balanced.groupBy("target").count().collect()} == {0: 9, 1: 9}
    made = balanced.where("id is null").collect()
    assert all(9.0 <= r["age"] <= 11.0 for r in made)
    assert fitted.transform(df).count() == 12


def test_string_index_of_many_values_uses_a_join_and_unknown_is_minus_one(spark):
    train = spark.createDataFrame([(i, f"v{i % 100:03d}", i % 2) for i in range(250)], "id int, name string, y int")
    plan = Plan.of("y", encoding=[("name", ["STRING_INDEX"])])
    fitted = p.Preparation().fit(train, plan, passthrough=["id"])
    assert fitted.operations[0].mapping is not None
    later = spark.createDataFrame([(1, "v000", 0), (2, "v060", 0), (3, "zz", 0)], "id int, name string, y int")
    assert {r["id"]: r["name"] for r in fitted.transform(later).collect()} == {1: 0, 2: 60, 3: -1}


def test_constant_null_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None)], "c double, n double").withColumn("y", F.lit(0))
    scaled = p.apply_method(df, "transformation", "STANDARDIZE", "c")
    assert [r["c"] for r in scaled.collect()] == [0.0, 0.0]
    with pytest.raises(ValueError, match="without values"):
        p.Preparation().fit(df, Plan.of("y", missing_values=[("n", ["MEAN"])]))
    nan = spark.createDataFrame([(float("nan"),), (3.0,)], "c double")
    assert sorted(r["c"] for r in p.apply_method(nan, "missing_values", "MEAN", "c").collect()) == [3.0, 3.0]


def test_baseline_names_and_unknown_category(spark):
    train, holdout = frames(spark)
    fitted = p.fit_baseline(train, "target", ["id"])
    assert fitted.output_columns == ["numeric__age", "categorical__city_A", "categorical__city_B"]
    row = fitted.transform(holdout).where("id = 'x'").first()
    assert (row["categorical__city_A"], row["categorical__city_B"]) == (0.0, 0.0)


def test_fitted_preparation_is_a_pure_projection(spark):
    train, holdout = frames(spark)
    plan = p.Preparation().fit(train, PLAN, passthrough=["id"]).transform(holdout)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_history_records_failures(spark):
    train, _ = frames(spark)
    plan = Plan.of("target", missing_values=[("age", ["MEAN", "FORWARD_FILL"]), ("gone", ["MEAN"])], extraction=[("city", ["PCA"])])
    _, history = p.apply_plan(train, plan)
    assert [(r["method"], r["success"]) for r in history.orderBy("position").collect()] == [("MEAN", True), ("FORWARD_FILL", False), ("PCA", False)]


def test_users_can_register_methods(spark):
    @p.register_method("transformation", "DOUBLED")
    def doubled(df, column, **_):
        return df.withColumn(column, F.col(column) * 2)

    df = spark.createDataFrame([(2.0,)], "x double")
    assert p.apply_method(df, "transformation", "DOUBLED", "x").first()["x"] == 4.0


@pytest.mark.parametrize("fill", [forward_fill, backward_fill])
def test_range_fill_equals_window_fill_on_a_hot_group(spark, fill):
    df = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g"), F.when(F.col("id") % 11 == 0, F.col("id")).alias("v")
    )
    whole, split = fill(df, "v", ["id"], ["g"]), fill(df, "v", ["id"], ["g"], limit=200)
    assert whole.exceptAll(split).isEmpty() and split.exceptAll(whole).isEmpty()


def test_long_series_transform_equals_the_short_one(spark):
    df = spark.range(37).select("id", F.sin("id").alias("x"))
    short = {r["id"]: r["x"] for r in discrete_cosine(df, "x", ["id"]).collect()}
    long = {r["id"]: r["x"] for r in discrete_cosine(df, "x", ["id"], series_limit=10).collect()}
    want = [2 * sum(math.sin(n) * math.cos(math.pi * k * (2 * n + 1) / 74) for n in range(37)) for k in range(37)]
    for k in range(37):
        assert short[k] == pytest.approx(want[k], abs=1e-9) and long[k] == pytest.approx(want[k], abs=1e-8)


def test_an_index_of_many_values_is_frozen_and_feeds_later_steps(spark, tmp_path):
    """Standardised ranks of 70 values, then the training rows are gone; the fit does not depend on the number of values."""
    import shutil

    from featloom.operators.prepare import Preparation
    from featloom.plans.plan import Plan

    rows = [(i, f"v{i % 70:02d}", i % 2) for i in range(700)]
    spark.createDataFrame(rows, "id long, v string, y int").write.parquet(str(tmp_path / "t"))
    train = spark.read.parquet(str(tmp_path / "t"))
    plan = Plan.of("y", encoding=[("v", ["STRING_INDEX"])], transformation=[("v", ["STANDARDIZE"])])
    fitted = Preparation(order=("encoding", "transformation")).fit(train, plan, passthrough=["id"])
    shutil.rmtree(tmp_path / "t")
    got = {r["id"]: r["v"] for r in fitted.transform(spark.createDataFrame(rows, "id long, v string, y int")).collect()}
    values = sorted(set(round(v, 6) for v in got.values()))
    assert len(values) == 70 and abs(sum(got.values())) < 1e-6 and abs(sum(v * v for v in got.values()) / 700 - 1) < 1e-6


def test_one_hot_has_no_limit(spark):
    from featloom.operators.prepare import fit_baseline

    train = spark.createDataFrame([(i, f"c{i}", i % 2) for i in range(2_100)], "id long, v string, y int")
    fitted = fit_baseline(train, "y", ["id"])
    assert len(fitted.output_columns) == 2_100


def test_chronological_split_of_large_and_null_orders(spark):
    from featloom.operators.split import chronological_partitions

    base = 1 << 60
    rows = [(i, base + i if i % 10 else None, i % 2) for i in range(1_000)]
    got = chronological_partitions(spark.createDataFrame(rows, "id long, at long, y int"), "at", "y", tie_break="id", positive=1, negative=0)
    train, test = ([r["id"] for r in p.collect()] for p in (got.train, got.test))
    order = sorted(range(1_000), key=lambda i: (i % 10 == 0, i))
    assert set(train) == set(order[:800]) and set(test) == set(order[800:])


def test_metrics_of_three_classes(spark):
    from featloom.operators.metrics import class_metrics

    rows = [("a", "a")] * 6 + [("b", "a")] * 2 + [("b", "b")] * 2 + [("c", "c")] * 2
    got = class_metrics(spark.createDataFrame(rows, "t string, p string"), "t", "p").first()
    assert abs(got["accuracy"] - 10 / 12) < 1e-12 and abs(got["balanced_accuracy"] - (1 + 0.5 + 1) / 3) < 1e-12 and got["f1"] is None
    two = class_metrics(spark.createDataFrame([(1, 1.0), (0, 1.0), (0, 0.0)], "t int, p double"), "t", "p").first()
    assert abs(two["accuracy"] - 2 / 3) < 1e-12 and two["precision"] == 0.5


def test_parts_are_chosen_once_and_read_by_column(spark):
    from featloom.core import written
    from featloom.operators.split import outcome_partitions

    df = spark.range(50).select("id", (F.col("id") % 7).alias("SUM(a.b, c)"), F.col("id").cast("double").alias("y"))
    got = outcome_partitions(df, "id", "y")
    for part, rows in ((got.train, 40), (got.test, 10)):
        assert part.count() == rows and part.columns == ["id", "SUM(a.b, c)", "target"]
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "md5" not in plan and "parquet" in plan.lower()
    odd = spark.createDataFrame([(1, 2, None)], "a int, A int, b void")
    assert written(odd.drop("b").toDF("a", "A"), "x").collect() == [(1, 2)] and written(odd.select("b"), "x").collect() == [(None,)]


def test_ranks_of_a_column_share_a_sketch(spark):
    from featloom.functions.ordering import order_statistics

    df = spark.range(5_000).select((F.col("id") * 7919 % 5000).cast("double").alias("v"), (F.col("id") % 2).cast("double").alias("w"))
    seen = []
    real = F.percentile_approx
    try:
        F.percentile_approx = lambda *a: seen.append(a) or real(*a)
        got = order_statistics(df, {"v": F.col("v"), "w": F.col("w")}, {"v": range(0, 5000, 500), "w": [0, 2499, 2500, 4999]}, limit=300)
    finally:
        F.percentile_approx = real
    assert len(seen) < 14 and [got["v", r] for r in range(0, 5000, 500)] == [float(r) for r in range(0, 5000, 500)]
    assert [got["w", r] for r in (0, 2499, 2500, 4999)] == [0, 0, 1, 1]
