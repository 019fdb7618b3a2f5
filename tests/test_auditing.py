import random

import pytest
from pyspark.sql import functions as F

from featloom.operators import corrupt as c
from featloom.operators import metrics as m


def frame(spark):
    return spark.range(20).select("id", (F.col("id") + 1).alias("value"), F.lit("A").alias("city"), (F.col("id") % 2).alias("target"))


def test_corruption_counts_and_ledger(spark):
    df = frame(spark)
    specs = [c.CorruptionSpec(c.MISSING, "value", 0.2), c.CorruptionSpec(c.UNSEEN_CATEGORY, "city", 0.1)]
    out, ledger = c.corrupt(df, "id", specs, 7, ["target"])
    again, _ = c.corrupt(df.repartition(5), "id", specs, 7, ["target"])
    assert out.where("value is null").count() == 4 and out.where(F.col("city") == c.UNSEEN).count() == 2 and ledger.count() == 6
    assert out.exceptAll(again).isEmpty() and df.where("value is null").isEmpty()


def test_corruption_guards(spark):
    with pytest.raises(ValueError, match="protected"):
        c.corrupt(frame(spark), "id", [c.CorruptionSpec(c.ZERO, "target", 0.1)], 1, ["target"])
    with pytest.raises(ValueError, match="not found"):
        c.corrupt(frame(spark), "id", [c.CorruptionSpec(c.ZERO, "gone", 0.1)], 1)
    with pytest.raises(ValueError, match="rate"):
        c.CorruptionSpec(c.ZERO, "value", 0.0)


def test_duplicates_get_fresh_keys(spark):
    out, ledger = c.corrupt(frame(spark), "id", [c.CorruptionSpec(c.DUPLICATE, "value", 0.1)], 3)
    assert out.count() == 22 and out.select("id").distinct().count() == 22 and ledger.count() == 2


def test_repair_rates(spark):
    def keys(*rows):
        return spark.createDataFrame(list(rows), "row_key string, column string")

    row = m_row(c.repair_metrics(keys(("1", "a"), ("2", "a")), keys(("1", "a"), ("3", "a")), keys(("1", "a"), ("4", "a")), keys(("1", "a"))))
    assert row["detection_precision"] == row["detection_recall"] == row["correct_repair_rate"] == row["harmful_change_rate"] == 0.5
    none = spark.createDataFrame([], "row_key string, column string")
    assert m_row(c.repair_metrics(none, none, none, none))["detection_recall"] == 0.0


def m_row(df):
    return df.first().asDict()


def test_contract(spark):
    df = frame(spark)
    blind = df.drop("target")
    c.assert_contract(df, df.withColumn("z", F.lit(1)), blind, blind.withColumn("z", F.lit(1)), "id", "target")
    with pytest.raises(ValueError, match="training_target_unchanged"):
        c.assert_contract(df, df.withColumn("target", 1 - F.col("target")), blind, blind, "id", "target")
    with pytest.raises(ValueError, match="holdout_rows_kept"):
        c.assert_contract(df, df, blind, blind.where("id > 3"), "id", "target")
    with pytest.raises(ValueError, match="same_feature_columns"):
        c.assert_contract(df, df.drop("city"), blind, blind, "id", "target")


def test_classification_metrics(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.6), (1, 1, 0.7), (1, 1, 0.9)], "t int, p int, s double")
    row = m_row(m.classification_metrics(df, "t", "p", "s"))
    assert (row["accuracy"], row["specificity"], row["auroc"], row["pr_auc"]) == (0.75, 0.5, 1.0, 1.0)
    single = m_row(m.classification_metrics(df.where("t = 0"), "t", "p", "s"))
    assert single["auroc"] is None and single["probability_reason"] == "single_class"
    assert m_row(m.classification_metrics(df, "t", "p"))["probability_reason"] == "unavailable"
    with pytest.raises(ValueError):
        m.classification_metrics(df.where("false"), "t", "p")


def test_ranking_in_ranges_equals_one_window(spark):
    df = spark.range(800).select((F.col("id") % 3 == 0).cast("int").alias("t"), (F.col("id") * 37 % 201 / 201).alias("s"))
    a, b = m.ranking_metrics(df, "t", "s").first(), m.ranking_metrics(df, "t", "s", limit=40).first()
    assert a["auroc"] == pytest.approx(b["auroc"]) and a["pr_auc"] == pytest.approx(b["pr_auc"])


def test_paired_summary_and_wilcoxon(spark):
    left = spark.createDataFrame(list(enumerate([0.8, 0.7, 0.9, 0.85])), "i int, v double")
    right = spark.createDataFrame(list(enumerate([0.7, 0.7, 0.8, 0.8])), "i int, v double")
    assert m_row(m.paired_summary(left, right, "i", "v"))["mean_difference"] == pytest.approx(0.0625)
    # all five differences positive and distinct: exact two-sided p = 2 / 2^5
    assert m.wilcoxon_p(5, 5, 15.0, 0.0) == pytest.approx(0.0625)
    assert m.wilcoxon_p(1, 1, 1.0, 0.0) is None and m.wilcoxon_p(4, 0, 0.0, 0.0) is None
    with pytest.raises(ValueError):
        m.paired_summary(left, right.where("i > 0"), "i", "v")


@pytest.mark.parametrize("limit", [1, 1000])
def test_holm(spark, limit):
    df = spark.createDataFrame([(1, 0.04), (2, 0.01), (3, 0.03)], "k int, p double")
    got = {r["k"]: r["adjusted"] for r in m.holm_adjust(df, "k", "p", limit=limit).collect()}
    assert got == pytest.approx({1: 0.06, 2: 0.03, 3: 0.06})


def test_jaccard_blocks_and_edge_rules(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["a", "b"]), (4, ["c"]), (5, [])], "i int, s array<string>")
    whole = m.mean_jaccard(df, "i", "s").first()["mean_jaccard"]
    assert whole == pytest.approx(2.0 / 10) and m.mean_jaccard(df, "i", "s", block=1).first()["mean_jaccard"] == pytest.approx(whole)
    assert m.mean_jaccard(df.where("i = 1"), "i", "s").first()["mean_jaccard"] == 1.0
    empty = spark.createDataFrame([(1, []), (2, [])], "i int, s array<string>")
    assert m.mean_jaccard(empty, "i", "s").first()["mean_jaccard"] == 0.0
    assert m.mean_jaccard(empty, "i", "s", empty_union=1.0).first()["mean_jaccard"] == 1.0


def _brute_jaccard(sets, empty_union):
    total, n = 0.0, len(sets)
    for i in range(n):
        for j in range(i):
            union = sets[i] | sets[j]
            total += len(sets[i] & sets[j]) / len(union) if union else empty_union
    return total / (n * (n - 1) / 2)


@pytest.mark.parametrize("block", [3, 1000])
def test_mean_jaccard_equals_all_pairs(spark, block):
    rng = random.Random(block)
    sets = [rng.sample(range(40), rng.randrange(7)) + rng.choice([[], [99], [1000 + i]]) for i in range(150)]
    sets += [[], [], sets[3], sets[3], list(range(40))]
    df = spark.createDataFrame([(i, s + s[:1]) for i, s in enumerate(sets)] + [(900, None)], "i int, s array<int>").repartition(5)
    for empty_union in (0.0, 1.0):
        got = m.mean_jaccard(df, "i", "s", empty_union=empty_union, block=block).first()
        assert got["runs"] == len(sets) + 1
        assert got["mean_jaccard"] == pytest.approx(_brute_jaccard([set(s) for s in sets] + [set()], empty_union), rel=1e-12)


def test_many_nearly_disjoint_sets(spark):
    n = 100_000
    # Neighbours share one of four elements; one set in a hundred holds a common element as well.
    ids = spark.range(n).repartition(8)
    own = F.array(F.col("id") * 3, F.col("id") * 3 + 1, F.col("id") * 3 + 2, F.col("id") * 3 + 3)
    sets = ids.select("id", F.when(F.col("id") % 100 == 0, F.concat(own, F.array(F.lit(-1).cast("long")))).otherwise(own).alias("s"))
    got = m.mean_jaccard(sets, "id", "s").first()["mean_jaccard"]
    common = n // 100
    plain, touched = n - 1 - (2 * common - 1), 2 * common - 1
    total = plain / 7 + touched / 8 + common * (common - 1) / 2 / 9
    assert got == pytest.approx(total / (n * (n - 1) / 2), rel=1e-9)


def test_all_runs_are_evaluated_at_once_as_each_alone(spark):
    rng = random.Random(5)
    rows = [
        (rng.choice(["a", "a", "a", "b", None]), rng.randrange(3), rng.randrange(2), rng.randrange(2), rng.choice([None, *[k / 9 for k in range(10)]]), rng.choice([None, 1.0, float("nan")]), "clash")
        for _ in range(600)
    ] + [("one", 0, 1, 1, 0.5, 1.0, "clash"), ("one", 0, 1, 0, 0.5, None, "clash")]
    df = spark.createDataFrame(rows, "run string, fold int, truth int, guess int, chance double, x double, n string")
    whole = m.evaluate_runs(df, ["run", "fold"], "truth", "guess", "chance", ["x"])
    parted = m.evaluate_runs(df, ["run", "fold"], "truth", "guess", "chance", ["x"], limit=40)
    got = {(r["run"], r["fold"]): r.asDict() for r in whole.collect()}
    assert set(got) == {(r[0], r[1]) for r in rows}
    near = lambda a, b: a == b or abs(a - b) < 1e-12
    for r in parted.collect():
        assert all(near(v, got[r["run"], r["fold"]][k]) for k, v in r.asDict().items())
    for run, fold in (("a", 1), (None, 2), ("one", 0)):
        alone = df.where(F.col("run").eqNullSafe(F.lit(run)) & (F.col("fold") == fold))
        want = m.classification_metrics(alone, "truth", "guess", "chance").first().asDict()
        want |= m.rmse(alone, "truth", "guess").first().asDict() | m.missing_rate(alone.select("x")).first().asDict() | {"rows": alone.count()}
        assert want.keys() <= got[run, fold].keys() and all(near(v, got[run, fold][k]) for k, v in want.items())
    assert got["one", 0]["probability_reason"] == "single_class" and got["one", 0]["auroc"] is None
    assert m.evaluate_runs(df.limit(0), ["run"], "truth", "guess", "chance").count() == 0
    with pytest.raises(ValueError, match="tells runs apart"):
        m.evaluate_runs(df, [], "truth", "guess", "chance")


def test_intersections_of_dense_and_sparse_blocks(spark, monkeypatch):
    import pyarrow as pa

    from featloom.operators import set_similarity as s

    rng = random.Random(5)
    monkeypatch.setattr(s, "CELLS", 700)
    for universe, most in ((25, 20), (3000, 6)):
        left, right = ([[f"e{e}" for e in rng.sample(range(universe), rng.randrange(most))] for _ in range(n)] for n in (90, 70))
        known = pa.array(sorted({e for own in left for e in own}))
        coded = [s._coded(pa.chunked_array([pa.array(sets, pa.list_(pa.string()))]), known) for sets in (left, right)]
        parts = [(first, both.tolist()) for first, both in s._intersections(*coded, len(known))]
        assert [first for first, _ in parts] == list(range(0, 70, 7))
        assert [row for _, both in parts for row in both] == [[len(set(a) & set(b)) for a in left] for b in right]


def test_many_distinct_sets_of_few_elements(spark):
    # All sets share elements, so a meeting of each set with small blocks would be millions of rows.
    n = 6_000
    held = [F.when((F.col("id") + 1).bitwiseAND(1 << i) > 0, F.lit(f"e{i}")) for i in range(13)]
    sets = spark.range(n).select("id", F.array_compact(F.array(*held)).alias("s"))
    got = m.mean_jaccard(sets, "id", "s").first()["mean_jaccard"]
    import numpy as np

    bits = ((np.arange(1, n + 1)[:, None] >> np.arange(13)) & 1).astype(float)
    both, size = bits @ bits.T, bits.sum(1)
    score = both / (size[:, None] + size[None, :] - both)
    assert got == pytest.approx((score.sum() - n) / (n * (n - 1)), rel=1e-9)
