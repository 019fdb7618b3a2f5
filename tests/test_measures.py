import math

import pytest
from pyspark.sql import functions as F

from featloom.functions.ordering import global_row_number, hash_cuts, order_statistics, quantiles
from featloom.operators import profile


def values(df, target, names, **options):
    return {(r["measure"], r["column"]): r["value"] for r in profile.measures(df, target, names, **options).collect()}


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1.0, 2.0, "a", "x"), (2.0, 4.0, "a", "x"), (3.0, 6.0, "b", "y"), (10.0, 20.0, None, "y")]
    return spark.createDataFrame(rows, "p double, q double, s string, y string")


def test_numbers_by_hand(small):
    got = values(small, "y", ["MEAN", "MEDIAN", "RANGE", "MAD", "H_MEAN", "G_MEAN", "COR", "NR_COR_ATTR", "CLASS_ENT", "NR_MISSING", "NR_DISC", "IQR"])
    assert got[("MEAN", "p")] == 4.0 and got[("MEDIAN", "p")] == 2.5 and got[("RANGE", "p")] == 9.0 and got[("MAD", "p")] == 1.0
    assert got[("H_MEAN", "p")] == pytest.approx(4 / (1 + 0.5 + 1 / 3 + 0.1))
    assert got[("G_MEAN", "p")] == pytest.approx(60 ** 0.25)
    assert got[("COR", "p|q")] == pytest.approx(1.0) and got[("NR_COR_ATTR", None)] == 1.0
    assert got[("CLASS_ENT", None)] == pytest.approx(1.0, abs=1e-6)
    assert got[("NR_MISSING", None)] == 1.0 and got[("NR_DISC", None)] == 1.0 and got[("IQR", "p")] == 3.0


def test_constant_null_and_single_class(spark):
    df = spark.createDataFrame([(5.0, None, "k"), (5.0, None, "k")], "c double, n double, y string")
    got = values(df, "y", ["COR", "KURTOSIS", "SKEWNESS", "SD_RATIO", "W_LAMBDA", "CAN_COR", "NS_RATIO", "T_MEAN"])
    assert ("COR", "c|n") not in got
    assert got[("KURTOSIS", "c")] == 0.0 and got[("SKEWNESS", "c")] == 0.0
    assert got[("SD_RATIO", None)] == 1.0 and got[("W_LAMBDA", None)] == 1.0 and got[("NS_RATIO", None)] == 0.0
    assert got[("T_MEAN", "c")] == 5.0 and got[("T_MEAN", "n")] == 0.0


def test_discriminant_measures_in_one_dimension(spark):
    # two classes: within sum of squares 4, between sum of squares 4 * 2.5^2 * ... by hand
    df = spark.createDataFrame([(0.0, "a"), (2.0, "a"), (5.0, "b"), (7.0, "b")], "x double, y string")
    got = values(df, "y", ["CAN_COR", "W_LAMBDA"])
    root = 25.0 / 4.0
    assert got[("CAN_COR", "0")] == pytest.approx(math.sqrt(root / (1 + root)))
    assert got[("W_LAMBDA", None)] == pytest.approx(1 / (1 + root))


def test_eigenvalues(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 3.0)], "a double, b double")
    got = values(df, None, ["EIGHENVALUES"])
    assert sorted(got.values()) == pytest.approx([0.5, 1.5])


def test_missing_target_is_an_error(small):
    with pytest.raises(ValueError):
        profile.measures(small, None, ["CLASS_ENT"])


def test_families(spark):
    df = spark.createDataFrame([("2020-01-01", "red", 0, 5.0), ("2021-02-03", "blue", 1, 6.0)], "d string, s string, b int, n double")
    assert profile.column_types(df) == {"d": "datetime", "s": "categorical", "b": "categorical", "n": "numeric"}
    assert profile.column_types(df, {"n": "categorical"})["n"] == "categorical"


def test_document_holds_no_raw_values(small):
    text = profile.compact_metadata(small, "y").first()["metadata"]
    assert '"name":"p"' in text and "20.0" not in text


def test_quantiles_by_refinement_equal_exact_ones(spark):
    df = spark.range(5000).select(F.pow(F.col("id") % 977, 2).alias("v"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("hot"))
    columns = {"v": F.col("v"), "hot": F.col("hot")}
    assert quantiles(df, columns, [0, 0.1, 0.5, 0.9, 1], limit=20) == quantiles(df, columns, [0, 0.1, 0.5, 0.9, 1])
    ordered = sorted(r["v"] for r in df.collect())
    assert order_statistics(df, {"v": F.col("v")}, {"v": [0, 1234, 4999]}, limit=10) == {("v", k): ordered[k] for k in (0, 1234, 4999)}


def test_global_rank_in_ranges(spark):
    df = spark.range(2000).select((F.col("id") * 7919 % 2000).alias("k"))
    got = global_row_number(df, [F.col("k").asc()], "n", limit=150)
    assert got.where("n <> k + 1").isEmpty() and got.count() == 2000


def test_hash_cut_holds_exactly_the_quota(spark):
    df = spark.range(1000).withColumn("c", F.col("id") % 3)
    for part in hash_cuts(df, "id", 1, lambda n: [n // 4], ["c"]):
        assert part["cuts"][0] is not None and part["n"] in (333, 334)


def test_trimmed_mean_small_limit(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert profile.trimmed_means(df, ["v"], 0.1)["v"] == 50.0 == profile.trimmed_means(df, ["v"], 0.1, limit=7)["v"]
