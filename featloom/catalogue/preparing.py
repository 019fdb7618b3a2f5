"""Fitted and unfitted preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from featloom.catalogue.base import hash_sql, query, shaped, table
from featloom.catalogue.rows import PRICED, priced
from featloom.operators import prepare
from featloom.operators.sampling import nearest, oversample
from featloom.operators.split import random_split
from featloom.plans.plan import Plan


def _unfitted(name: str, category: str, method: str, column: str, sql: str | None, digits: int = 6, **options):
    @query(name, sql)
    def run(spark, d):
        done = prepare.apply_method(priced(spark, d), category, method, column, **options)
        kept = [c for c in done.columns if c == "p_partkey" or c.startswith(column)]
        return shaped(done.select(*[f"`{c}`" for c in kept]), digits)


_unfitted("h1_impute_mean", "missing_values", "MEAN", "price", f"SELECT p_partkey, round(coalesce(price, (SELECT avg(price) FROM {PRICED})), 6) AS price FROM {PRICED}")
_unfitted("h2_impute_median", "missing_values", "MEDIAN", "price", f"SELECT p_partkey, round(coalesce(price, (SELECT median(price) FROM {PRICED})), 6) AS price FROM {PRICED}")
_unfitted(
    "h3_impute_mode", "missing_values", "MODE", "kind",
    f"SELECT p_partkey, coalesce(kind, (SELECT kind FROM {PRICED} WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)) AS kind FROM {PRICED}",
)
_unfitted("h4_standardize", "transformation", "STANDARDIZE", "price", f"SELECT p_partkey, round((price - m) / s, 6) AS price FROM {PRICED}, (SELECT avg(price) AS m, stddev_pop(price) AS s FROM {PRICED})")
_unfitted("h5_min_max_scale", "transformation", "MIN_MAX_SCALE", "price", f"SELECT p_partkey, round((price - lo) / (hi - lo), 6) AS price FROM {PRICED}, (SELECT min(price) AS lo, max(price) AS hi FROM {PRICED})")
_unfitted("h6_binarize", "transformation", "BINARIZE", "size", f"SELECT p_partkey, CAST(size > 0 AS INTEGER)::DOUBLE AS size FROM {PRICED}")
_unfitted("h7_normalize", "transformation", "NORMALIZE", "size", f"SELECT p_partkey, sign(size)::DOUBLE AS size FROM {PRICED}")


@query("h7_normalize_rows", f"SELECT p_partkey, round(size / sqrt(size * size + price * price), 6) AS size, round(price / sqrt(size * size + price * price), 6) AS price FROM {PRICED}")
def h7_rows(spark, d):
    df = priced(spark, d)
    return shaped(df.select("p_partkey", *prepare.l2_normalise(["size", "price"])))


_unfitted(
    "h8_uniform_discretize", "transformation", "UNIFORM_DISCRETIZE", "price",
    f"SELECT p_partkey, CAST((price >= lo + w) AS INTEGER) + CAST((price >= lo + 2 * w) AS INTEGER) + CAST((price >= lo + 3 * w) AS INTEGER) + CAST((price >= lo + 4 * w) AS BIGINT) AS price_bin "
    f"FROM {PRICED}, (SELECT min(price) AS lo, (max(price) - min(price)) / 5 AS w FROM {PRICED})",
)


@query(
    "h8_quantile_one_hot",
    f"""SELECT p_partkey, CASE WHEN price IS NOT NULL THEN CAST(price < q[2] AS INTEGER)::DOUBLE END AS price_bin_0, CASE WHEN price IS NOT NULL THEN CAST(price >= q[2] AND price < q[3] AS INTEGER)::DOUBLE END AS price_bin_1,
    CASE WHEN price IS NOT NULL THEN CAST(price >= q[3] AS INTEGER)::DOUBLE END AS price_bin_2 FROM {PRICED}, (SELECT quantile_cont(price, [0, 1.0 / 3, 2.0 / 3, 1]) AS q FROM {PRICED})""",
)
def h8_one_hot(spark, d):
    return prepare.discretise(priced(spark, d).select("p_partkey", "price"), "price", "quantile", 3, one_hot=True)


_KINDS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _kinds_sql() -> str:
    return "SELECT p_partkey, " + ", ".join(f"CAST(coalesce(kind = '{k}', false) AS INTEGER)::DOUBLE AS \"kind_{k}\"" for k in _KINDS) + f" FROM {PRICED}"


@query("h9_one_hot_encode", _kinds_sql())
def h9(spark, d):
    df = priced(spark, d).select("p_partkey", "kind")
    made = prepare.apply_method(df, "encoding", "ONE_HOT_ENCODE", "kind")
    return prepare.freeze_schema(made, ["p_partkey", *[f"kind_{k}" for k in _KINDS]])


_unfitted(
    "h10_string_index", "encoding", "STRING_INDEX", "kind",
    f"""SELECT p_partkey, i AS kind FROM {PRICED} LEFT JOIN (SELECT kind AS v, row_number() OVER (ORDER BY count(*) DESC, kind) - 1 AS i FROM {PRICED} WHERE kind IS NOT NULL GROUP BY kind) ON v = kind""",
)


@query(
    "h10_string_index_many",
    "SELECT event_id, i AS props FROM events JOIN (SELECT props AS v, row_number() OVER (ORDER BY count(*) DESC, props) - 1 AS i FROM events GROUP BY props) ON v = props",
)
def h10_many(spark, d):
    events = table(spark, d, "events").select("event_id", "props")
    # the ranks are counted range by range, as for a mapping that exceeds one task
    mapping = prepare.frequency_index(events, "props", limit=30)
    return shaped(prepare.string_index(events, "props", mapping))


@query("h11_pca")
def h11(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return prepare.pca_components(lines, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 3, prefix="line")


_PCA = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "h11_row_norms",
    "WITH m AS (SELECT " + ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(_PCA)) + " FROM lineitem)"
    " SELECT l_orderkey, l_linenumber, round(sqrt(" + " + ".join(f"pow(({c} - m{i}) / s{i}, 2)" for i, c in enumerate(_PCA)) + "), 5) AS norm FROM lineitem, m",
)
def h11_norms(spark, d):
    # all components together keep every row's length, which no vectors but orthonormal ones do
    found = prepare.pca_components(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_PCA), _PCA, 4, prefix="line")
    parts = [F.pow(F.col(f"line_pca_component_{k}"), 2) for k in range(1, 5)]
    return shaped(found.select("l_orderkey", "l_linenumber", F.sqrt(sum(parts[1:], parts[0])).alias("norm")), 5)


@query("h12_discretise_target", "SELECT o_orderkey, CASE WHEN o_totalprice <= q[2] THEN 0 WHEN o_totalprice <= q[3] THEN 1 ELSE 2 END::BIGINT AS o_totalprice FROM orders, (SELECT quantile_cont(o_totalprice, [0, 0.5, 0.9, 1]) AS q FROM orders)")
def h12(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return shaped(prepare.discretise_target(orders, "o_totalprice", [0, 0.5, 0.9, 1]))


@query("h12_discretise_by_value", "SELECT o_orderkey, CASE WHEN o_totalprice BETWEEN 0 AND 100000 THEN 'low' WHEN o_totalprice <= 300000 THEN 'high' END AS o_totalprice FROM orders")
def h12_value(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return prepare.discretise_target(orders, "o_totalprice", [0, 100000, 300000], ["low", "high"], method="value")


_SPLIT = f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY {hash_sql('p_partkey', 42)}, p_partkey) <= ceil(n * 0.2) AS held FROM (SELECT *, count(*) OVER () AS n FROM {PRICED}))"""


@query(
    "h13_target_bins",
    _SPLIT + """, q AS (SELECT quantile_cont(price, 0.75) AS e FROM s WHERE NOT held AND price IS NOT NULL)
    SELECT p_partkey, CAST(price > e AS BIGINT) AS price FROM s, q WHERE held AND price IS NOT NULL""",
)
def h13(spark, d):
    train, test = random_split(priced(spark, d), "p_partkey")
    train, test = (p.where("price is not null").select("p_partkey", "p_brand", "price") for p in (train, test))
    fitted = prepare.Preparation().fit(
        train, Plan.of("price", task_type="REGRESSION"), passthrough=["p_partkey"], target_quantiles=[0, 0.75, 1]
    )
    return shaped(fitted.transform(test).select("p_partkey", "price"))


PLAN = Plan.of(
    "p_brand",
    missing_values=[("size", ["NEGATIVE_AS_MISSING_VALUE", "MEDIAN"]), ("price", ["MEAN"]), ("kind", ["MODE"])],
    transformation=[("price", ["STANDARDIZE"]), ("size", ["MIN_MAX_SCALE"])],
    encoding=[("kind", ["ONE_HOT_ENCODE"])],
)

_FITTED = _SPLIT + """, c AS (SELECT p_partkey, held, p_brand, CASE WHEN size >= 0 THEN size END AS size, price, kind FROM s),
  f AS (SELECT median(size) AS size_m, avg(price) AS price_m FROM c WHERE NOT held),
  k AS (SELECT kind AS mode FROM c WHERE NOT held AND kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1),
  i AS (SELECT p_partkey, held, p_brand, coalesce(size, size_m) AS size, coalesce(price, price_m) AS price, coalesce(kind, mode) AS kind FROM c, f, k),
  g AS (SELECT min(size) AS lo, max(size) AS hi, avg(price) AS m, stddev_pop(price) AS sd FROM i WHERE NOT held)
  SELECT p_partkey, round((size - lo) / (hi - lo), 6) AS size, round((price - m) / sd, 6) AS price, """ + ", ".join(
    f"CAST(kind = '{k}' AS INTEGER)::DOUBLE AS \"kind_{k}\"" for k in _KINDS
) + ", p_brand FROM i, g"


@query("h14_fit_preparation", _FITTED + " WHERE NOT held")
def h14(spark, d):
    train, _ = random_split(priced(spark, d), "p_partkey")
    return shaped(prepare.Preparation().fit(train, PLAN, passthrough=["p_partkey"]).transform(train))


@query("h15_transform_holdout", _FITTED + " WHERE held")
def h15(spark, d):
    train, test = random_split(priced(spark, d), "p_partkey")
    return shaped(prepare.Preparation().fit(train, PLAN, passthrough=["p_partkey"]).transform(test))


@query("h19_replay_lenient", _FITTED.replace("round((price - m) / sd, 6) AS price", "0.0::DOUBLE AS price") + " WHERE held")
def h19(spark, d):
    train, test = random_split(priced(spark, d), "p_partkey")
    fitted = prepare.Preparation(strict=False).fit(train, PLAN, passthrough=["p_partkey"])
    return shaped(fitted.transform(test.drop("price")))


@query(
    "h16_sampling_inputs",
    f"""WITH t AS (SELECT *, CAST(p_partkey % 10 = 0 AS INTEGER) AS y FROM {PRICED}), m AS (SELECT median(size) AS sm, median(price) AS pm FROM t),
    k AS (SELECT kind AS mode FROM t WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)
    SELECT p_partkey, round(coalesce(size, sm), 6) AS size, round(coalesce(price, pm), 6) AS price, """
    + ", ".join(f"CAST(coalesce(kind, mode) = '{x}' AS INTEGER)::DOUBLE AS \"kind_{x}\"" for x in _KINDS) + ", CAST(y AS BIGINT) AS y FROM t, m, k",
)
def h16(spark, d):
    df = priced(spark, d).drop("p_brand").withColumn("y", (F.col("p_partkey") % 10 == 0).cast("int"))
    fitted = prepare.Preparation().fit(df, Plan.of("y", sampling=[("y", ["SMOTE"])]), passthrough=["p_partkey"])
    return shaped(fitted.transform(df))


_BALANCED = """WITH t AS (SELECT label = 3 AS y, count(*) AS n FROM embeddings GROUP BY label = 3) SELECT CAST(y AS BIGINT) AS y, (SELECT max(n) FROM t) AS rows FROM t"""


def _vectors(spark, d):
    item = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", (F.col("label") == 3).cast("int").alias("y"), *[item[i].cast("double").alias(f"x{i}") for i in range(64)])


@query("h17_smote", _BALANCED)
def h17(spark, d):
    balanced = oversample(_vectors(spark, d), "y", [f"x{i}" for i in range(64)], "SMOTE", key="vec_id")
    return shaped(balanced.groupBy("y").agg(F.count("*").alias("rows")))


@query("h17_borderline_smote")
def h17_border(spark, d):
    balanced = oversample(_vectors(spark, d), "y", [f"x{i}" for i in range(64)], "BORDERLINE_SMOTE", key="vec_id")
    return shaped(balanced.groupBy("y").agg(F.count("*").alias("rows")))


@query(
    "h17_nearest",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    p AS (SELECT a.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x)) AS place, list_distance(a.x, b.x) AS distance FROM v a, v b)
    SELECT id, place, round(distance, 5) AS distance FROM p WHERE place <= 4""",
)
def h17_nearest(spark, d):
    points = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    found = nearest(points, points, 4, chunk=500)
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))
    return shaped(found.select(F.col("id").cast("bigint").alias("id"), place.alias("place"), "distance"), 5)


_STEPS = Plan.of(
    "price",
    missing_values=[("price", ["MEAN"]), ("absent", ["MEAN"]), ("size", ["FORWARD_FILL"])],
    encoding=[("kind", ["STRING_INDEX"])],
    transformation=[("price", ["BINARIZE"]), ("p_brand", ["STANDARDIZE"])],
    extraction=[("p_brand", ["PCA"])],
)


@query(
    "h18_apply_plan",
    f"""SELECT p_partkey, CAST(coalesce(price, 1) > 0 AS INTEGER)::DOUBLE AS price, i AS kind FROM {PRICED}
    LEFT JOIN (SELECT kind AS v, row_number() OVER (ORDER BY count(*) DESC, kind) - 1 AS i FROM {PRICED} WHERE kind IS NOT NULL GROUP BY kind) ON v = kind""",
)
def h18(spark, d):
    done, _ = prepare.apply_plan(priced(spark, d), _STEPS)
    return shaped(done.select("p_partkey", "price", "kind"))


@query(
    "h18_history",
    """SELECT position::BIGINT AS position, step, method, col AS attribute, ok AND (SELECT count(*) FROM part) > 0 AS success FROM (VALUES (0, 'missing_values', 'MEAN', 'price', true),
    (1, 'missing_values', 'FORWARD_FILL', 'size', false), (2, 'feature_creation', 'STRING_INDEX', 'kind', true), (3, 'transformation', 'BINARIZE', 'price', true),
    (4, 'transformation', 'STANDARDIZE', 'p_brand', true), (5, 'feature_selection', 'PCA', 'p_brand', false)) v(position, step, method, col, ok)""",
)
def h18_history(spark, d):
    _, history = prepare.apply_plan(priced(spark, d), _STEPS)
    return shaped(history.select("position", "step", "method", F.col("column").alias("attribute"), "success"))


_BASE = _SPLIT + """, f AS (SELECT median(price) AS pm, median(size) AS sm FROM s WHERE NOT held),
  k AS (SELECT kind AS mode FROM s WHERE NOT held AND kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1),
  i AS (SELECT p_partkey, held, coalesce(size, sm) AS size, coalesce(price, pm) AS price, coalesce(kind, mode) AS kind FROM s, f, k),
  g AS (SELECT avg(size) AS s_m, stddev_pop(size) AS s_s, avg(price) AS p_m, stddev_pop(price) AS p_s FROM i WHERE NOT held)
  SELECT p_partkey, round((size - s_m) / s_s, 6) AS "numeric__size", round((price - p_m) / p_s, 6) AS "numeric__price", """ + ", ".join(
    f"CAST(kind = '{k}' AS INTEGER)::DOUBLE AS \"categorical__kind_{k}\"" for k in _KINDS
) + ", (p_partkey % 2) AS y FROM i, g"


def _base_parts(spark, d):
    df = priced(spark, d).drop("p_brand").withColumn("y", F.col("p_partkey") % 2)
    return random_split(df, "p_partkey")


@query("h20_baseline", _BASE + " WHERE held")
def h20(spark, d):
    train, test = _base_parts(spark, d)
    return shaped(prepare.fit_baseline(train, "y", ["p_partkey"]).transform(test))


@query("h21_finalise_numeric", _BASE)
def h21(spark, d):
    train, test = prepare.finalise_numeric(*_base_parts(spark, d), "y", ["p_partkey"])
    return shaped(train.unionByName(test))


def _rank_sql(c: str) -> str:
    return f"(SELECT {c} AS v, row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS i FROM part GROUP BY {c})"


@query(
    "h22_category_mapping",
    f"SELECT p_partkey, coalesce(a.i, -1) AS p_brand, b.i AS p_type FROM (SELECT p_partkey, p_type, CASE WHEN p_partkey % 9 = 0 THEN 'new' ELSE p_brand END AS br FROM part) LEFT JOIN {_rank_sql('p_brand')} a ON a.v = br LEFT JOIN {_rank_sql('p_type')} b ON b.v = p_type",
)
def h22(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    mappings = prepare.category_mappings(part)
    later = part.withColumn("p_brand", F.when(F.col("p_partkey") % 9 == 0, "new").otherwise(F.col("p_brand")))
    return shaped(prepare.encode_categories(later, mappings))


@query(
    "h23_dummies",
    f"SELECT p_partkey, round(coalesce(price, round_even((SELECT avg(price) FROM {PRICED}), 0)), 4) AS price, " + ", ".join(f"CAST(coalesce(kind = '{k}', false) AS INTEGER)::DOUBLE AS \"kind_{k}\"" for k in _KINDS[1:]) + f" FROM {PRICED}",
)
def h23(spark, d):
    return shaped(prepare.dummies(priced(spark, d).select("p_partkey", "price", "kind"), ["kind"], fill_rounded_mean=True), 4)


@query("h24_classification_target", "SELECT (SELECT count(DISTINCT quality) = 2 AND min(quality) = 0 AND max(quality) = 1 FROM labels) AS quality, (SELECT count(DISTINCT value) = 2 FROM events) AS value, true AS text")
def h24(spark, d):
    labels, events = table(spark, d, "labels"), table(spark, d, "events")
    row = (
        prepare.is_classification_target(labels, "quality"), prepare.is_classification_target(events, "value"),
        prepare.is_classification_target(events, "event_type"),
    )
    return spark.createDataFrame([row], "quality boolean, value boolean, text boolean")
