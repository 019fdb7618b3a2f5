"""Splits, samples and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from featloom.catalogue.base import hash_sql, query, shaped, table
from featloom.operators import split

_H42 = hash_sql("o_orderkey", 42)


def _parts(train, test, key):
    return train.select(F.lit("train").alias("part"), key).unionByName(test.select(F.lit("test").alias("part"), key))


@query(
    "d1_random_split",
    f"""SELECT CASE WHEN rn <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS part, o_orderkey FROM
    (SELECT o_orderkey, row_number() OVER (ORDER BY {_H42}, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)""",
)
def d1(spark, d):
    return _parts(*split.random_split(table(spark, d, "orders"), "o_orderkey"), "o_orderkey")


@query(
    "d2_stratified_split",
    f"""SELECT CASE WHEN rn <= round_even(n * 0.25, 0) THEN 'test' ELSE 'train' END AS part, o_orderkey FROM
    (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_H42}, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)""",
)
def d2(spark, d):
    return _parts(*split.stratified_split(table(spark, d, "orders"), "o_orderkey", "o_orderpriority"), "o_orderkey")


_OUTCOME = f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY {_H42}, o_orderkey) AS rn, count(*) OVER () AS n FROM orders WHERE o_totalprice > 2000),
  p AS (SELECT *, rn <= ceil(n * 0.2) AS held FROM r), q AS (SELECT quantile_cont(o_totalprice, 0.75) AS t FROM p WHERE NOT held)"""


def _outcomes(spark, d):
    price = F.col("o_totalprice")
    return split.outcome_partitions(table(spark, d, "orders").withColumn("o_totalprice", F.when(price > 2000, price)), "o_orderkey", "o_totalprice")


@query(
    "d3_outcome_partitions",
    _OUTCOME + "SELECT CASE WHEN held THEN 'test' ELSE 'train' END AS part, o_orderkey, o_orderstatus, CAST(o_totalprice > t AS BIGINT) AS target FROM p, q",
)
def d3(spark, d):
    got = _outcomes(spark, d)
    parts = [p.select(F.lit(n).alias("part"), "o_orderkey", "o_orderstatus", "target") for n, p in (("train", got.train), ("test", got.test))]
    return shaped(parts[0].unionByName(parts[1]))


@query(
    "d3_audit",
    _OUTCOME + """SELECT (SELECT count(*) FROM orders) AS source_rows, count(*) AS eligible_rows, (SELECT count(*) FROM orders) - count(*) AS excluded_missing_key_or_outcome,
    count(*) FILTER (WHERE NOT held) AS train_rows, count(*) FILTER (WHERE held) AS test_rows, 'training_partition_only' AS threshold_source, round(max(t), 4) AS threshold,
    0::BIGINT AS entity_overlap, round(avg(CAST(o_totalprice > t AS INTEGER)) FILTER (WHERE NOT held), 4) AS train_positive_rate, round(avg(CAST(o_totalprice > t AS INTEGER)) FILTER (WHERE held), 4) AS test_positive_rate FROM p, q""",
)
def d3_audit(spark, d):
    return shaped(_outcomes(spark, d).audit, 4)


# Every event; the time of views counts as unknown, so they come last.
_CLICKS = "(SELECT *, row_number() OVER (ORDER BY CASE WHEN event_type <> 'view' THEN ts END NULLS LAST, event_id) AS rn, count(*) OVER () AS n FROM events)"


@query(
    "d4_chronological_partitions",
    f"""SELECT CASE WHEN rn <= round_even(n * 0.8, 0) THEN 'train' ELSE 'test' END AS part, event_id, CAST(event_type = 'click' AS BIGINT) AS target FROM {_CLICKS}""",
)
def d4(spark, d):
    kind = F.when(F.col("event_type") == "click", "click").otherwise("other")
    events = table(spark, d, "events").withColumn("ts", F.when(F.col("event_type") != "view", F.col("ts"))).withColumn("event_type", kind)
    got = split.chronological_partitions(
        events, "ts", "event_type", tie_break="event_id", leakage_columns=["props"], positive="click", negative="other"
    )
    parts = [p.select(F.lit(n).alias("part"), "event_id", "target") for n, p in (("train", got.train), ("test", got.test))]
    return shaped(parts[0].unionByName(parts[1]))


@query(
    "d5_stratified_folds",
    f"""SELECT o_orderkey, CAST((rn > n * 1 // 5)::INT + (rn > n * 2 // 5)::INT + (rn > n * 3 // 5)::INT + (rn > n * 4 // 5)::INT AS BIGINT) AS fold FROM
    (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_H42}, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)""",
)
def d5(spark, d):
    return shaped(split.stratified_folds(table(spark, d, "orders"), "o_orderkey", "o_orderstatus").select("o_orderkey", "fold"))


@query(
    "d7_fraction_sample",
    f"SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY {hash_sql('event_id', 42)}, event_id) AS rn, count(*) OVER () AS n FROM events) WHERE rn <= round_even(n * 0.1, 0)",
)
def d7(spark, d):
    return split.fraction_sample(table(spark, d, "events"), "event_id", 0.1).select("event_id")
