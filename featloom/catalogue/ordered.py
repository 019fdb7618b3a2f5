"""Fills, adjusted p-values and the cosine transform."""

from __future__ import annotations

from pyspark.sql import functions as F

from featloom.catalogue.base import query, shaped, table
from featloom.operators.metrics import holm_adjust
from featloom.operators.ordered import backward_fill, discrete_cosine, forward_fill


def gapped(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", F.when(F.col("value") > 12, F.col("value")).alias("value"))


_GAPPED = "(SELECT event_id, ts, user_id, CASE WHEN value > 12 THEN value END AS value FROM events)"


@query("w1_forward_fill", f"SELECT event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value FROM {_GAPPED}")
def w1(spark, d):
    return forward_fill(gapped(spark, d), "value", ["ts", "event_id"], ["user_id"]).select("event_id", "value")


@query("w1_forward_fill_in_ranges", f"SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value FROM {_GAPPED}")
def w1_ranges(spark, d):
    return forward_fill(gapped(spark, d), "value", ["ts", "event_id"], limit=2_500).select("event_id", "value")


@query("w2_backward_fill", f"SELECT event_id, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM {_GAPPED}")
def w2(spark, d):
    return backward_fill(gapped(spark, d), "value", ["ts", "event_id"], ["user_id"]).select("event_id", "value")


@query(
    "w3_holm_adjust",
    """WITH p AS (SELECT p_partkey, (p_retailprice % 100) / 100000 AS p FROM part),
    r AS (SELECT p_partkey, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, p_partkey) + 1) * p) AS a, row_number() OVER (ORDER BY p, p_partkey) AS rn FROM p)
    SELECT p_partkey, round(max(a) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING), 8) AS adjusted FROM r""",
)
def w3(spark, d):
    tests = table(spark, d, "part").select("p_partkey", ((F.col("p_retailprice") % 100) / 100000).alias("p"))
    return shaped(holm_adjust(tests, "p_partkey", "p").select("p_partkey", "adjusted"), 8)


@query(
    "w4_discrete_cosine",
    """WITH s AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, count(*) OVER (PARTITION BY user_id) AS m FROM events)
    SELECT k.event_id, round(2 * sum(x.value * cos(pi() * k.n * (2 * x.n + 1) / (2.0 * k.m))), 4) + 0.0 AS value FROM s k JOIN s x ON x.user_id = k.user_id GROUP BY k.event_id""",
)
def w4(spark, d):
    series = table(spark, d, "events").select("event_id", "ts", "user_id", "value")
    return shaped(discrete_cosine(series, "value", ["ts", "event_id"], ["user_id"]).select("event_id", "value"), 4)


@query(
    "w4_long_series",
    """WITH s AS (SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_suppkey) - 1 AS n, count(*) OVER () AS m FROM supplier)
    SELECT k.s_suppkey, round(2 * sum(x.s_acctbal * cos(pi() * k.n * (2 * x.n + 1) / (2.0 * k.m))), 3) + 0.0 AS s_acctbal FROM s k, s x GROUP BY k.s_suppkey""",
)
def w4_long(spark, d):
    series = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return shaped(discrete_cosine(series, "s_acctbal", ["s_suppkey"], series_limit=50), 3)
