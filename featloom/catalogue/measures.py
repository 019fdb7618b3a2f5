"""One query per table measure, over lines with injected gaps."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from featloom.catalogue.base import query, shaped, table
from featloom.operators import profile

NUM = ["quantity", "price", "discount", "tax", "linenumber"]
CAT = ["status", "band"]
TARGET = "flag"
FAMILIES = {**{c: "numeric" for c in NUM}, **{c: "categorical" for c in [*CAT, TARGET]}}


def lines(spark, d):
    quantity, number = F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        F.when(number != 7, quantity).alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.when(quantity != 50, F.col("l_discount")).alias("discount"),
        F.col("l_tax").alias("tax"),
        number.alias("linenumber"),
        F.when(number != 3, F.col("l_linestatus")).alias("status"),
        F.concat(F.lit("b"), number.cast("string")).alias("band"),
        F.col("l_returnflag").alias(TARGET),
    )


LINES = """WITH t AS (SELECT CASE WHEN l_linenumber <> 7 THEN l_quantity END AS quantity, l_extendedprice AS price,
  CASE WHEN l_quantity <> 50 THEN l_discount END AS discount, l_tax AS tax, l_linenumber AS linenumber,
  CASE WHEN l_linenumber <> 3 THEN l_linestatus END AS status, 'b' || l_linenumber AS band, l_returnflag AS flag FROM lineitem)
"""


def _register(name: str, measure: str, sql: str | None, digits: int = 6) -> None:
    @query(name, None if sql is None else LINES + sql)
    def run(spark, d):
        # the shape measures infer the column families from the data
        families = None if measure in ("CAT_TO_NUM", "NUM_TO_CAT", "NR_ATTR", "NR_CAT", "NR_NUM") else FAMILIES
        got = profile.measures(lines(spark, d), TARGET, [measure], families=families)
        return shaped(got.withColumnRenamed("column", "attribute"), digits)


def _scalar(measure: str, expr: str, digits: int = 6, source: str = "t") -> str:
    return f"SELECT '{measure}' AS measure, CAST(NULL AS VARCHAR) AS attribute, round(CAST({expr} AS DOUBLE), {digits}) AS value FROM {source}"


def _each(measure: str, expr: str, digits: int = 6, columns=NUM, source: str = "t") -> str:
    rows = [f"SELECT '{measure}' AS measure, '{c}' AS attribute, round(CAST({expr.replace('$x', c)} AS DOUBLE), {digits}) AS value FROM {source.replace('$x', c)}" for c in columns]
    return " UNION ALL ".join(rows)


def _null_sum(columns) -> str:
    return " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in columns)


_ATTRS = [*NUM, *CAT]
_register("m1_attr_to_inst", "ATTR_TO_INST", _scalar("ATTR_TO_INST", "7 / count(*)"))
_register("m2_inst_to_attr", "INST_TO_ATTR", _scalar("INST_TO_ATTR", "count(*) / 7"))
_register("m3_cat_to_num", "CAT_TO_NUM", _scalar("CAT_TO_NUM", "max(2) / 5.0"))
_register("m4_num_to_cat", "NUM_TO_CAT", _scalar("NUM_TO_CAT", "max(5) / 2.0"))
_register("m5_class_to_attr", "CLASS_TO_ATTR", _scalar("CLASS_TO_ATTR", "count(DISTINCT flag) / 7"))
_register("m6_inst_to_class", "INST_TO_CLASS", _scalar("INST_TO_CLASS", "count(*) / count(DISTINCT flag)"))
_register(
    "m7_freq_class", "FREQ_CLASS",
    "SELECT 'FREQ_CLASS' AS measure, flag AS attribute, round(count(*) / (SELECT count(flag) FROM t), 6) AS value FROM t WHERE flag IS NOT NULL GROUP BY flag",
)
_register("m8_nr_attr", "NR_ATTR", _scalar("NR_ATTR", "max(7)"))
_register("m9_nr_attr_missing", "NR_ATTR_MISSING", _scalar("NR_ATTR_MISSING", " + ".join(f"max(CAST({c} IS NULL AS INTEGER))" for c in _ATTRS)))
_register("m10_nr_bin", "NR_BIN", _scalar("NR_BIN", " + ".join(f"CAST(count(DISTINCT {c}) = 2 AS INTEGER)" for c in _ATTRS)))
_register("m11_nr_cat", "NR_CAT", _scalar("NR_CAT", "max(2)"))
_register("m12_nr_class", "NR_CLASS", _scalar("NR_CLASS", "count(DISTINCT flag)"))
_register("m13_nr_inst", "NR_INST", _scalar("NR_INST", "count(*)"))
_register("m14_nr_inst_missing", "NR_INST_MISSING", _scalar("NR_INST_MISSING", f"count(*) FILTER (WHERE {_null_sum([*_ATTRS, TARGET])} > 0)"))
_register("m15_nr_missing", "NR_MISSING", _scalar("NR_MISSING", f"sum({_null_sum([*_ATTRS, TARGET])})"))
_register("m16_nr_num", "NR_NUM", _scalar("NR_NUM", "max(5)"))
_register("m17_can_cor", "CAN_COR", None)


def _pairs(measure: str, expr: str, digits: int) -> str:
    return " UNION ALL ".join(
        f"SELECT '{measure}' AS measure, '{a}|{b}' AS attribute, round(abs({expr.replace('$a', a).replace('$b', b)}), {digits}) AS value FROM t"
        for a, b in itertools.combinations(NUM, 2)
    )


_register("m18_cor", "COR", _pairs("COR", "corr($a, $b)", 6))
_register("m19_cov", "COV", _pairs("COV", "covar_samp($a, $b)", 3), 3)
_register("m20_nr_disc", "NR_DISC", _scalar("NR_DISC", "greatest(0, least(count(DISTINCT flag) - 1, 5))"))
_register("m21_eigenvalues", "EIGHENVALUES", None)
_register("m22_g_mean", "G_MEAN", _each("G_MEAN", "exp(avg(ln($x)) FILTER (WHERE $x > 0))", 4).replace("ln(discount)", "ln(nullif(discount, 0))").replace("ln(tax)", "ln(nullif(tax, 0))"), 4)
_register("m23_h_mean", "H_MEAN", _each("H_MEAN", "(count($x) FILTER (WHERE $x > 0)) / sum(1 / nullif($x, 0)) FILTER (WHERE $x > 0)", 4), 4)
_register("m24_iqr", "IQR", _each("IQR", "quantile_cont(CAST($x AS DOUBLE), 0.75) - quantile_cont(CAST($x AS DOUBLE), 0.25)"))
_register("m25_kurtosis", "KURTOSIS", _each("KURTOSIS", "kurtosis_pop($x)"))
_register("m26_mad", "MAD", _each("MAD", "mad(CAST($x AS DOUBLE))"))
_register("m27_max", "MAX", _each("MAX", "max($x)"))
_register("m28_mean", "MEAN", _each("MEAN", "avg($x)"))
_register("m29_median", "MEDIAN", _each("MEDIAN", "median(CAST($x AS DOUBLE))"))
_register("m30_min", "MIN", _each("MIN", "min($x)"))
_register(
    "m31_nr_cor_attr", "NR_COR_ATTR",
    _scalar("NR_COR_ATTR", "(" + " + ".join(f"CAST(abs(corr({a}, {b})) > 0.8 AS INTEGER)" for a, b in itertools.combinations(NUM, 2)) + ") / 10.0"),
)


def _normal_sql(c: str) -> str:
    """D'Agostino-Pearson p > 0.05 from the moments of a column."""
    return f"""(SELECT CAST(n > 8 AND exp(-(z1 * z1 + z2 * z2) / 2) > 0.05 AS INTEGER) FROM (SELECT n, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1,
    ((1 - 2 / (9 * a)) - sign((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4)))) * pow(abs((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4)))), 1 / 3.0)) / sqrt(2 / (9 * a)) AS z2
    FROM (SELECT *, -1 + sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) AS w2,
      6 + 8 / rb * (2 / rb + sqrt(1 + 4 / (rb * rb))) AS a FROM (SELECT n, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
      (g2 + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
      6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS rb
      FROM (SELECT CAST(count({c}) AS DOUBLE) AS n, kurtosis_pop({c}) AS g2, (avg(pow({c} - mu, 3))) / pow(stddev_pop({c}), 3) AS g1 FROM t, (SELECT avg({c}) AS mu FROM t))))))"""


_register("m32_nr_norm", "NR_NORM", "SELECT 'NR_NORM' AS measure, CAST(NULL AS VARCHAR) AS attribute, CAST(" + " + ".join(_normal_sql(c) for c in NUM) + " AS DOUBLE) AS value")


def _outlier_sql(c: str) -> str:
    return f"""(SELECT CAST(max(CAST({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) AS INTEGER)) AS INTEGER) FROM t,
    (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM t))"""


_register("m33_nr_outliers", "NR_OUTLIERS", "SELECT 'NR_OUTLIERS' AS measure, CAST(NULL AS VARCHAR) AS attribute, CAST(" + " + ".join(_outlier_sql(c) for c in NUM) + " AS DOUBLE) AS value")
_register("m34_range", "RANGE", _each("RANGE", "max($x) - min($x)"))
_register("m35_sd", "SD", _each("SD", "stddev_samp($x)"))
_register("m36_var", "VAR", _each("VAR", "var_samp($x)", 3), 3)
_register("m37_sd_ratio", "SD_RATIO", None)
_register(
    "m38_skewness", "SKEWNESS",
    _each("SKEWNESS", "avg(pow($x - mu, 3)) / pow(stddev_pop($x), 3)", source="t, (SELECT avg($x) AS mu FROM t)"),
)
_register(
    "m39_t_mean", "T_MEAN",
    _each("T_MEAN", "avg($x)", source="(SELECT $x, row_number() OVER (ORDER BY $x) AS rn, count(*) OVER () AS n FROM t WHERE $x IS NOT NULL) WHERE rn > floor(0.1 * n) AND rn <= n - floor(0.1 * n)"),
)
_register("m40_w_lambda", "W_LAMBDA", None)


# two columns have closed forms: quantity and tax, by flag
_TWO = LINES + """, g AS (SELECT flag, CAST(count(*) AS DOUBLE) AS n, sum(coalesce(quantity, 0)) AS a, sum(coalesce(tax, 0)) AS b, sum(pow(coalesce(quantity, 0), 2)) AS aa,
  sum(coalesce(quantity, 0) * coalesce(tax, 0)) AS ab, sum(pow(coalesce(tax, 0), 2)) AS bb FROM t WHERE flag IS NOT NULL GROUP BY flag),
c AS (SELECT flag, n, aa - a * a / n AS p, ab - a * b / n AS q, bb - b * b / n AS r FROM g),
w AS (SELECT sum(p) AS p, sum(q) AS q, sum(r) AS r FROM c),
s AS (SELECT sum(aa) - sum(a) * sum(a) / sum(n) AS p, sum(ab) - sum(a) * sum(b) / sum(n) AS q, sum(bb) - sum(b) * sum(b) / sum(n) AS r FROM g),
k AS (SELECT (w.p * w.r - w.q * w.q) / (s.p * s.r - s.q * s.q) AS ratio,
  ((s.p - w.p) * w.r - 2 * (s.q - w.q) * w.q + (s.r - w.r) * w.p) / (w.p * w.r - w.q * w.q) AS tr,
  ((s.p - w.p) * (s.r - w.r) - pow(s.q - w.q, 2)) / (w.p * w.r - w.q * w.q) AS det FROM w, s),
e AS (SELECT flag, (p + r + m * sqrt(pow(p - r, 2) + 4 * q * q)) / 2 / (n - 1) AS v FROM c, (VALUES (1), (-1)) x(m) WHERE n > 1)
"""
_HEAD = "SELECT '$' AS measure, "


def _two(name: str, measure: str, sql: str, digits: int = 6) -> None:
    @query(name, _TWO + sql.replace("$", measure))
    def run(spark, d):
        pair = lines(spark, d).select("quantity", "tax", TARGET)
        families = {c: FAMILIES[c] for c in pair.columns}
        got = profile.measures(pair, TARGET, [measure], families=families)
        return shaped(got.withColumnRenamed("column", "attribute"), digits)


_two("m40_two_columns", "W_LAMBDA", _HEAD + "CAST(NULL AS VARCHAR) AS attribute, round(ratio, 6) AS value FROM k")
_two("m37_two_columns", "SD_RATIO", _HEAD + "CAST(NULL AS VARCHAR) AS attribute, round(max(v) / min(v), 1) AS value FROM e WHERE v > 0", 1)
_two(
    "m17_two_columns", "CAN_COR",
    _HEAD + "attribute, round(sqrt(x / (1 + x)), 6) AS value FROM (SELECT CASE WHEN m = 1 THEN '0' ELSE '1' END AS attribute, greatest(0, (tr + m * sqrt(tr * tr - 4 * det)) / 2) AS x FROM k, (VALUES (1), (-1)) v(m))",
)
_two(
    "m21_two_columns", "EIGHENVALUES",
    _HEAD + """CASE WHEN m = 1 THEN '0' ELSE '1' END AS attribute, round((p + r + m * sqrt(pow(p - r, 2) + 4 * q * q)) / 2, 6) AS value
    FROM (SELECT var_samp(quantity) AS p, covar_samp(quantity, tax) AS q, var_samp(tax) AS r FROM t), (VALUES (1), (-1)) v(m)""",
)


@query(
    "m21_invariants",
    LINES + "SELECT round(" + " + ".join(f"var_samp({c})" for c in NUM) + ", 2) AS trace, round(sqrt("
    + " + ".join(f"pow(covar_samp({a}, {b}), 2)" for a in NUM for b in NUM) + "), 2) AS norm FROM t",
)
def m21_invariants(spark, d):
    found = profile.measures(lines(spark, d), TARGET, ["EIGHENVALUES"], families=FAMILIES)
    return shaped(found.agg(F.sum("value").alias("trace"), F.sqrt(F.sum(F.pow("value", F.lit(2)))).alias("norm")), 2)


def _entropy(keys: str, where: str = "true") -> str:
    return f"(SELECT -sum(p * log2(p + 1e-10)) FROM (SELECT count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM t WHERE {where}) AS p FROM t WHERE {where} GROUP BY {keys}))"


def _info(measure: str, build, digits: int = 6) -> str:
    return " UNION ALL ".join(f"SELECT '{measure}' AS measure, '{c}' AS attribute, round({build(c)}, {digits}) AS value" for c in CAT)


def _joint(c: str) -> str:
    return _entropy(f"{c}, flag", f"{c} IS NOT NULL AND flag IS NOT NULL")


def _attr(c: str) -> str:
    return _entropy(c, f"{c} IS NOT NULL AND flag IS NOT NULL")


def _class(c: str) -> str:
    return _entropy("flag", f"{c} IS NOT NULL AND flag IS NOT NULL")


_ALL_CLASS = _entropy("flag", "flag IS NOT NULL")


@query(
    "m41_entropy",
    LINES + f"SELECT 'band' AS attribute, round({_entropy('band', 'band IS NOT NULL')}, 6) AS entropy",
)
def m41(spark, d):
    return shaped(profile.column_entropies(lines(spark, d), ["band"]).withColumnRenamed("column", "attribute"))


_register("m42_attr_ent", "ATTR_ENT", _info("ATTR_ENT", lambda c: _entropy(c, f"{c} IS NOT NULL")))
_register("m43_class_ent", "CLASS_ENT", f"SELECT 'CLASS_ENT' AS measure, CAST(NULL AS VARCHAR) AS attribute, round({_ALL_CLASS}, 6) AS value")
_register(
    "m44_eq_num_attr", "EQ_NUM_ATTR",
    "SELECT 'EQ_NUM_ATTR' AS measure, CAST(NULL AS VARCHAR) AS attribute, round((" + " + ".join(f"{_attr(c)} + {_class(c)} - {_joint(c)}" for c in CAT) + f") / {_ALL_CLASS}, 6) AS value",
)
_register("m45_joint_ent", "JOINT_ENT", _info("JOINT_ENT", _joint))
_register("m46_mut_inf", "MUT_INF", _info("MUT_INF", lambda c: f"greatest(0.0, {_attr(c)} + {_class(c)} - {_joint(c)})"))
_register(
    "m47_ns_ratio", "NS_RATIO",
    "SELECT 'NS_RATIO' AS measure, CAST(NULL AS VARCHAR) AS attribute, round(greatest(0.0, (" + " + ".join(f"({_joint(c)} - {_attr(c)})" for c in CAT) + f") / 2 / {_ALL_CLASS}), 6) AS value",
)


@query("m48_robust_entropy", "SELECT round(-sum(p * ln(p)) / ln(3), 6) AS entropy FROM (SELECT count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM events) AS p FROM events GROUP BY event_type)")
def m48(spark, d):
    return shaped(profile.robust_entropy(table(spark, d, "events"), "event_type", 3))


@query(
    "m49_detect_outliers",
    """SELECT event_id, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS outlier FROM events,
    (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)""",
)
def m49(spark, d):
    return profile.detect_outliers(table(spark, d, "events").select("event_id", "value"), "value").select("event_id", "outlier")


@query(
    "m50_normalise",
    """SELECT s_suppkey, round((s_acctbal - lo) / (hi - lo), 6) AS s_acctbal, 0.0::DOUBLE AS constant FROM supplier, (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier)""",
)
def m50(spark, d):
    frame = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.lit(3.0).alias("constant"))
    return shaped(profile.min_max_normalise(frame, ["s_acctbal", "constant"]))


@query("m51_safe_divide", "SELECT l_linenumber::BIGINT AS n, round(sum(CASE WHEN l_tax = 0 THEN -1 ELSE l_discount / l_tax END), 4) AS ratio FROM lineitem GROUP BY l_linenumber")
def m51(spark, d):
    from featloom.core import safe_divide

    ratio = safe_divide(F.col("l_discount"), F.col("l_tax"), -1.0)
    return shaped(table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("n")).agg(F.sum(ratio).alias("ratio")), 4)
