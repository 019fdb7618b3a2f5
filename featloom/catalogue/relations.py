"""Feature synthesis, routing and relation audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from featloom.catalogue.base import hash_sql, query, shaped, table
from featloom.operators import relate
from featloom.operators.split import duplicate_keys, random_split
from featloom.sources.registry import declared_references


def _named(df, names):
    """Short column names for `SUM(child.col)` style ones."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()])


def _skew(x: str) -> str:
    return f"CASE WHEN count({x}) >= 3 THEN CASE WHEN min({x}) = max({x}) THEN 0.0 ELSE skewness({x}) END END"


def _mode(source: str, key: str, value: str) -> str:
    return f"""(SELECT {key} AS k, {value} AS m FROM (SELECT {key}, {value}, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {value}) AS rn
      FROM {source} GROUP BY {key}, {value}) WHERE rn = 1)"""


def users(spark, d):
    """One row per nation-like id of users, some without events."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")


def set_of_users(spark, d):
    es = relate.EntitySet()
    es.add_entity("users", users(spark, d), "user_id")
    events = table(spark, d, "events").withColumn("big", F.col("value") > 10)
    es.add_entity("events", events, "event_id", text=["props"])
    return es.add_relation("users", "user_id", "events", "user_id")


@query(
    "c3_aggregates",
    f"""WITH g AS (SELECT user_id, count(*) AS n, sum(value) AS s, stddev_samp(value) AS sd, max(value) AS hi, min(value) AS lo, avg(value) AS m,
      {_skew('value')} AS sk, avg(CAST(value > 10 AS INTEGER)) AS pt, count(DISTINCT event_type) AS nu FROM events GROUP BY user_id)
    SELECT c.c_custkey AS user_id, coalesce(n, 0) AS "count", round(coalesce(s, 0), 4) AS "sum", round(sd, 4) AS std, round(hi, 4) AS "max", round(lo, 4) AS "min",
      round(m, 4) AS mean, round(sk, 4) AS skew, round(coalesce(pt, 0), 4) AS percent_true, nu AS num_unique, o.m AS mode
    FROM customer c LEFT JOIN g ON g.user_id = c.c_custkey LEFT JOIN {_mode('events', 'user_id', 'event_type')} o ON o.k = c.c_custkey""".replace("round(m, 4)", "round(g.m, 4)"),
)
def c3_aggregates(spark, d):
    matrix, _ = relate.synthesise(set_of_users(spark, d), "users", transform=[])
    names = {
        "user_id": "user_id", "COUNT(events)": "count", "SUM(events.value)": "sum", "STD(events.value)": "std",
        "MAX(events.value)": "max", "MIN(events.value)": "min", "MEAN(events.value)": "mean", "SKEW(events.value)": "skew",
        "PERCENT_TRUE(events.big)": "percent_true", "NUM_UNIQUE(events.event_type)": "num_unique", "MODE(events.event_type)": "mode",
    }
    return shaped(_named(matrix, names), 4)


@query(
    "c3_transforms",
    f"""WITH t AS (SELECT *, day(ts) AS dd, isodow(ts) - 1 AS wd, year(ts) AS yy, month(ts) AS mm FROM events)
    SELECT c.c_custkey AS user_id, a.m AS mode_day, b.m AS mode_weekday, y.m AS mode_year, o.m AS mode_month, round(g.chars, 4) AS mean_chars, CAST(g.words AS DOUBLE) AS max_words
    FROM customer c LEFT JOIN {_mode('t', 'user_id', 'dd')} a ON a.k = c.c_custkey LEFT JOIN {_mode('t', 'user_id', 'wd')} b ON b.k = c.c_custkey
    LEFT JOIN {_mode('t', 'user_id', 'yy')} y ON y.k = c.c_custkey LEFT JOIN {_mode('t', 'user_id', 'mm')} o ON o.k = c.c_custkey
    LEFT JOIN (SELECT user_id, avg(length(props)) AS chars, max(len(list_filter(string_split_regex(props, '\\s+'), lambda x: x <> ''))) AS words FROM events GROUP BY user_id) g ON g.user_id = c.c_custkey""",
)
def c3_transforms(spark, d):
    matrix, _ = relate.synthesise(set_of_users(spark, d), "users", agg=["mode", "mean", "max"])
    names = {
        "user_id": "user_id", "MODE(events.DAY(ts))": "mode_day", "MODE(events.WEEKDAY(ts))": "mode_weekday",
        "MODE(events.YEAR(ts))": "mode_year", "MODE(events.MONTH(ts))": "mode_month",
        "MEAN(events.NUM_CHARACTERS(props))": "mean_chars", "MAX(events.NUM_WORDS(props))": "max_words",
    }
    return shaped(_named(matrix, names), 4)


def trade_set(spark, d, lines=True):
    es = relate.EntitySet()
    es.add_entity("region", table(spark, d, "region"), "r_regionkey")
    es.add_entity("nation", table(spark, d, "nation"), "n_nationkey")
    es.add_entity("customer", table(spark, d, "customer"), "c_custkey")
    es.add_entity("orders", table(spark, d, "orders"), "o_orderkey")
    es.add_relation("region", "r_regionkey", "nation", "n_regionkey")
    es.add_relation("nation", "n_nationkey", "customer", "c_nationkey")
    es.add_relation("customer", "c_custkey", "orders", "o_custkey")
    if lines:
        # the lines have no key of their own and are only ever children
        items = table(spark, d, "lineitem").withColumn("line", F.monotonically_increasing_id())
        es.add_entity("lineitem", items, "line", check_key=False)
        es.add_relation("orders", "o_orderkey", "lineitem", "l_orderkey")
    return es


@query(
    "c3_stacked",
    """WITH l AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q, max(l_extendedprice) AS p FROM lineitem GROUP BY l_orderkey),
    o AS (SELECT o_orderkey, o_custkey, o_totalprice, coalesce(n, 0) AS n, coalesce(q, 0) AS q, p FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
    g AS (SELECT o_custkey, avg(n) AS mean_count, max(n) AS max_count, avg(q) AS mean_sum, sum(p) AS sum_max, count(*) AS orders FROM o GROUP BY o_custkey),
    deep AS (SELECT o_custkey, count(*) AS lines, sum(l_quantity) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey)
    SELECT c_custkey, coalesce(orders, 0) AS orders, coalesce(lines, 0) AS lines, round(coalesce(quantity, 0), 2) AS quantity, round(mean_count, 4) AS mean_count,
      CAST(max_count AS DOUBLE) AS max_count, round(mean_sum, 4) AS mean_sum, round(coalesce(sum_max, 0), 2) AS sum_max
    FROM customer LEFT JOIN g ON g.o_custkey = c_custkey LEFT JOIN deep ON deep.o_custkey = c_custkey""",
)
def c3_stacked(spark, d):
    features = relate.feature_definitions(trade_set(spark, d), "customer", agg=["sum", "mean", "max", "count"], transform=[])
    names = {
        "COUNT(orders)": "orders", "COUNT(lineitem)": "lines", "SUM(lineitem.l_quantity)": "quantity",
        "MEAN(orders.COUNT(lineitem))": "mean_count", "MAX(orders.COUNT(lineitem))": "max_count",
        "MEAN(orders.SUM(lineitem.l_quantity))": "mean_sum", "SUM(orders.MAX(lineitem.l_extendedprice))": "sum_max",
    }
    matrix = relate.compute_features(trade_set(spark, d), [f for f in features if f.name in names])
    out = _named(matrix, {"c_custkey": "c_custkey", **names})
    rounded = out.select(
        "c_custkey", "orders", "lines", F.round("quantity", 2).alias("quantity"), F.round("mean_count", 4).alias("mean_count"),
        "max_count", F.round("mean_sum", 4).alias("mean_sum"), F.round("sum_max", 2).alias("sum_max"),
    )
    return rounded


@query(
    "c3_direct",
    """SELECT c_custkey, n_name, r_name, k AS customers, round(b, 4) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
    JOIN (SELECT c_nationkey AS nk, count(*) AS k, avg(c_acctbal) AS b FROM customer GROUP BY c_nationkey) ON nk = c_nationkey""",
)
def c3_direct(spark, d):
    matrix, _ = relate.synthesise(trade_set(spark, d, lines=False), "customer", agg=["count", "mean"], transform=[])
    names = {
        "c_custkey": "c_custkey", "nation.n_name": "n_name", "nation.region.r_name": "r_name",
        "nation.COUNT(customer)": "customers", "nation.MEAN(customer.c_acctbal)": "balance",
    }
    return shaped(_named(matrix, names), 4)


@query(
    "c4_frozen_definitions",
    f"""WITH h AS (SELECT *, row_number() OVER (ORDER BY {hash_sql('c_custkey', 7)}, c_custkey) AS rn, count(*) OVER () AS n FROM customer),
    held AS (SELECT * FROM h WHERE rn <= ceil(n * 0.2))
    SELECT c_custkey, c_mktsegment, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders,
      round(coalesce((SELECT sum(o_totalprice) FROM orders WHERE o_custkey = c_custkey), 0), 2) AS total FROM held""",
)
def c4(spark, d):
    customers, orders = table(spark, d, "customer"), table(spark, d, "orders")
    train, held = random_split(customers, "c_custkey", 0.2, 7)

    def fused(part):
        es = relate.EntitySet().add_entity("customer", part, "c_custkey")
        es.add_entity("orders", relate.route_children(part, "c_custkey", orders, "o_custkey"), "o_orderkey")
        return es.add_relation("customer", "c_custkey", "orders", "o_custkey")

    definitions = relate.feature_definitions(fused(train), "customer", agg=["count", "sum"], transform=[])
    matrix = relate.compute_features(fused(held), definitions)
    names = {"c_custkey": "c_custkey", "c_mktsegment": "c_mktsegment", "COUNT(orders)": "orders", "SUM(orders.o_totalprice)": "total"}
    return shaped(_named(matrix, names), 2)


@query(
    "c6_fusion_merge",
    """WITH m AS (SELECT n_nationkey, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS k,
      (SELECT max(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey) AS hi, (SELECT count(DISTINCT c_mktsegment) FROM customer WHERE c_nationkey = n_nationkey) AS u FROM nation)
    SELECT n_nationkey::BIGINT AS n_nationkey, n_name, k AS "COUNT_customer", round(hi, 4) AS "MAX_customer_c_acctbal", u AS "NUM_UNIQUE_customer_c_mktsegment",
      (SELECT count(*) FROM nation) AS rows FROM m""",
)
def c6(spark, d):
    tables = {"nation": table(spark, d, "nation").drop("n_regionkey"), "customer": table(spark, d, "customer").drop("c_name")}
    fused, info = relate.fusion_merge(
        tables, {"nation": "n_nationkey", "customer": "c_custkey"}, ["nation,n_nationkey;customer,c_nationkey"], "nation",
        agg=["count", "max", "num_unique"], transform=[],
    )
    return shaped(fused.withColumn("rows", F.lit(info.first()["rows"])), 4)


_SAMPLE = f"""(SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {hash_sql('c_custkey', 42)}, c_custkey) AS rn, count(*) OVER () AS n FROM customer) WHERE rn <= round_even(n * 0.3, 0))"""


@query(
    "c7_slice_tables",
    f"""SELECT 'customer' AS part, c_custkey AS k FROM {_SAMPLE} UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM {_SAMPLE})""",
)
def c7(spark, d):
    customers, orders = table(spark, d, "customer"), table(spark, d, "orders")
    root, children = relate.slice_tables(customers.unionByName(customers), "c_custkey", {"orders": (orders, "o_custkey")}, 0.3)
    return root.select(F.lit("customer").alias("part"), F.col("c_custkey").alias("k")).unionByName(
        children["orders"].select(F.lit("orders").alias("part"), F.col("o_orderkey").alias("k"))
    )


@query(
    "c8_route_children",
    """SELECT 'train' AS part, event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    UNION ALL SELECT 'test', event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""",
)
def c8(spark, d):
    customers, events = table(spark, d, "customer"), table(spark, d, "events")
    parts = {"train": F.col("c_mktsegment") == "BUILDING", "test": F.col("c_mktsegment") != "BUILDING"}
    routed = [
        relate.route_children(customers.where(c), "c_custkey", events, "user_id").select(F.lit(n).alias("part"), "event_id") for n, c in parts.items()
    ]
    return routed[0].unionByName(routed[1])


def _audit_sql(name: str, child: str, fk: str, parent: str, key: str) -> str:
    return f"""SELECT '{name}' AS relation, (SELECT count(*) FROM {child}) AS rows,
    (SELECT count(DISTINCT {fk}) FROM {child} WHERE {fk} NOT IN (SELECT {key} FROM {parent})) AS orphan_keys,
    (SELECT count(DISTINCT {fk}) FROM {child} WHERE {fk} IN (SELECT {key} FROM {parent})) AS matched_parent_keys,
    (SELECT max(k) FROM (SELECT count(*) AS k FROM {child} WHERE {fk} IS NOT NULL GROUP BY {fk})) AS max_rows_per_parent,
    (SELECT count(*) FROM {parent}) AS parent_rows, (SELECT count(DISTINCT {key}) FROM {parent}) AS parent_unique_keys"""


_PARENTS = "(SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')"


@query("c9_audit_relations", _audit_sql("orders", "orders", "o_custkey", _PARENTS, "c_custkey") + " UNION ALL " + _audit_sql("events", "events", "user_id", _PARENTS, "c_custkey"))
def c9(spark, d):
    parents = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'")
    children = {"orders": (table(spark, d, "orders"), "o_custkey"), "events": (table(spark, d, "events"), "user_id")}
    return shaped(relate.audit_relations(parents, children, "c_custkey"))


@query(
    "c10_declared_references",
    "SELECT DISTINCT CAST(c_custkey + x AS VARCHAR) AS id FROM customer, (VALUES (0), (7)) v(x) WHERE c_custkey + x NOT IN (SELECT c_custkey FROM customer)",
)
def c10(spark, d):
    customers = table(spark, d, "customer")
    key = F.col("c_custkey")
    listed = customers.select(F.concat_ws(",", key.cast("string"), (key + 7).cast("string")).alias("ids"))
    return declared_references(listed, "ids", customers, "c_custkey")


@query("d8_duplicate_keys", "SELECT l_orderkey AS k, count(*) AS rows FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def d8(spark, d):
    return duplicate_keys(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "k"), "k")
