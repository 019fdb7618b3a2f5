"""Corruption ledgers, repair metrics and output contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from featloom.catalogue.base import hash_sql, query, shaped, table
from featloom.operators import corrupt as c


def _chosen(source: str, key: str, seed: str, rate: float) -> str:
    return f"(SELECT {key} AS chosen FROM (SELECT {key}, row_number() OVER (ORDER BY {hash_sql(key, seed)}, {key}) AS rn, count(*) OVER () AS n FROM {source}) WHERE rn <= greatest(1, round_even(n * {rate}, 0)))"


def _supply(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_type", F.col("p_size").cast("double").alias("size"), "p_retailprice")


def _run(spark, d, *specs):
    return c.corrupt(_supply(spark, d), "p_partkey", [c.CorruptionSpec(*s) for s in specs], 11, ["p_brand"])


_PART = "(SELECT p_partkey, p_type, CAST(p_size AS DOUBLE) AS size, p_retailprice FROM part)"
_A, _B = _chosen("part", "p_partkey", "11|0", 0.2), _chosen("part", "p_partkey", "11|1", 0.1)


@query(
    "e1_corrupt",
    f"""SELECT p_partkey, CASE WHEN p_partkey IN (SELECT chosen FROM {_B}) THEN '__UNSEEN__' ELSE p_type END AS p_type,
    CASE WHEN p_partkey NOT IN (SELECT chosen FROM {_A}) THEN size END AS size FROM {_PART}""",
)
def e1(spark, d):
    out, _ = _run(spark, d, (c.MISSING, "size", 0.2), (c.UNSEEN_CATEGORY, "p_type", 0.1))
    return out.select("p_partkey", "p_type", "size")


@query(
    "e1_ledger",
    f"""SELECT 0::BIGINT AS spec_index, 'missing' AS kind, 'size' AS attribute, CAST(p_partkey AS VARCHAR) AS row_key, CAST(size AS VARCHAR) AS original, CAST(NULL AS VARCHAR) AS replacement
    FROM {_PART} WHERE p_partkey IN (SELECT chosen FROM {_A})
    UNION ALL SELECT 1, 'unseen_category', 'p_type', CAST(p_partkey AS VARCHAR), p_type, '__UNSEEN__' FROM part WHERE p_partkey IN (SELECT chosen FROM {_B})""",
)
def e1_ledger(spark, d):
    _, ledger = _run(spark, d, (c.MISSING, "size", 0.2), (c.UNSEEN_CATEGORY, "p_type", 0.1))
    return shaped(ledger.select("spec_index", "kind", F.col("column").alias("attribute"), "row_key", "original", "replacement"))


@query(
    "e2_zero_and_negative",
    f"""SELECT p_partkey, CASE WHEN p_partkey IN (SELECT chosen FROM {_A}) THEN 0.0 ELSE p_retailprice END AS p_retailprice,
    CASE WHEN p_partkey IN (SELECT chosen FROM {_B}) THEN CASE WHEN size = 0 THEN -1.0 ELSE -abs(size) END ELSE size END AS size FROM {_PART}""",
)
def e2(spark, d):
    out, _ = _run(spark, d, (c.ZERO, "p_retailprice", 0.2), (c.NEGATIVE, "size", 0.1))
    return out.select("p_partkey", "p_retailprice", "size")


@query(
    "e3_outlier",
    f"""SELECT p_partkey, round(CASE WHEN p_partkey IN (SELECT chosen FROM {_A}) THEN m + 20 * greatest(s, 1.0) ELSE p_retailprice END, 4) AS p_retailprice FROM part,
    (SELECT median(p_retailprice) AS m, stddev_samp(p_retailprice) AS s FROM part)""",
)
def e3(spark, d):
    out, _ = _run(spark, d, (c.OUTLIER, "p_retailprice", 0.2))
    return shaped(out.select("p_partkey", "p_retailprice"), 4)


@query("e4_type_string", f"SELECT p_partkey, CAST(size AS VARCHAR) AS size FROM {_PART}")
def e4(spark, d):
    out, _ = _run(spark, d, (c.TYPE_STRING, "size", 0.2))
    return out.select("p_partkey", "size")


@query(
    "e5_duplicate",
    f"""SELECT p_partkey, p_type FROM part UNION ALL
    SELECT p_partkey + (SELECT max(p_partkey) - min(p_partkey) + 1 FROM part), p_type FROM part WHERE p_partkey IN (SELECT chosen FROM {_A})""",
)
def e5(spark, d):
    out, _ = _run(spark, d, (c.DUPLICATE, "size", 0.2))
    return out.select("p_partkey", "p_type")


@query(
    "e6_repair_metrics",
    """WITH k AS (SELECT DISTINCT l_orderkey AS row_key, l_returnflag AS "column", (l_linenumber - 1) % 4 + 1 AS n FROM lineitem),
    c AS (SELECT DISTINCT row_key, "column" FROM k WHERE n = 1), x AS (SELECT DISTINCT row_key, "column" FROM k WHERE n = 2),
    y AS (SELECT DISTINCT row_key, "column" FROM k WHERE n = 3), z AS (SELECT DISTINCT row_key, "column" FROM k WHERE n = 4),
    s AS (SELECT (SELECT count(*) FROM c) AS corruptions, (SELECT count(*) FROM x) AS detected, (SELECT count(*) FROM y) AS changed,
    (SELECT count(*) FROM (SELECT * FROM c INTERSECT SELECT * FROM y INTERSECT SELECT * FROM z)) AS correctly_repaired,
    (SELECT count(*) FROM (SELECT * FROM c INTERSECT SELECT * FROM x)) AS hits, (SELECT count(*) FROM (SELECT * FROM y EXCEPT SELECT * FROM c)) AS harm)
    SELECT corruptions, detected, changed, correctly_repaired, round(hits / detected, 6) AS detection_precision, round(hits / corruptions, 6) AS detection_recall,
    round(correctly_repaired / corruptions, 6) AS correct_repair_rate, round(harm / changed, 6) AS harmful_change_rate FROM s""",
)
def e6(spark, d):
    lines = table(spark, d, "lineitem")
    keys = [
        lines.where((F.col("l_linenumber") - 1) % 4 + 1 == n).select(F.col("l_orderkey").alias("row_key"), F.col("l_returnflag").alias("column")) for n in range(1, 5)
    ]
    return shaped(c.repair_metrics(*keys))


@query(
    "e7_contract",
    """SELECT x.name AS "check", x.ok AND (SELECT count(*) FROM orders) > 0 AS ok FROM (VALUES ('training_unique_columns', true), ('training_has_row_identity', true), ('training_rows_kept', true),
    ('holdout_unique_columns', true), ('holdout_has_row_identity', true), ('holdout_rows_kept', false), ('holdout_without_target_in', true), ('training_has_target', true),
    ('training_target_unchanged', false), ('holdout_without_target_out', true), ('same_feature_columns', true)) x(name, ok)""",
)
def e7(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    train, held = orders.where("o_orderstatus <> 'P'"), orders.where("o_orderstatus = 'P'").drop("o_orderstatus")
    made = train.select("o_orderkey", (F.col("o_totalprice") / 2).alias("half"), F.when(F.col("o_totalprice") > 100000, F.col("o_orderstatus")).alias("o_orderstatus"))
    shorter = held.where("o_totalprice > 50000").select("o_orderkey", (F.col("o_totalprice") / 2).alias("half"))
    return c.check_contract(train, made, held, shorter, "o_orderkey", "o_orderstatus").select("check", "ok")
