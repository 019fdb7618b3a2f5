"""Plan texts derived from the parts: parse, explode, mask, validate."""

from __future__ import annotations

from pyspark.sql import functions as F

from featloom.catalogue.base import query, shaped, table
from featloom.catalogue.rows import priced
from featloom.core import spread
from featloom.plans import parse

_HEAD = '{"data_quality_report": {"overall_quality": "good", "summary": "s", "issues": [], "strengths": []}, "modeling_approaches": [{"task_type": "'
_MIDDLE = (
    '", "recommended_algorithm": {"name": "n", "reason": "r", "params": {"depth": 3}}, "evaluation_metrics": ["f1"], '
    '"cross_validation": {"method": "k_fold", "folds": 5, "stratified": true}, "data_cleaning": {"missing_values": [{"column": "'
)
#: Parts of one task: each becomes a text of some hundred characters that is parsed twice.
PART_ROWS = 10_000
_TAIL = '], "extraction": []}, "test_size": 0.2, "validation_size": 0.1}]}'


def plan_texts(spark, d):
    """One text per part: plain, tagged, broken, misnamed, junk or doubled."""
    part = spread(table(spark, d, "part"), PART_ROWS)
    kind = F.col("p_partkey") % 6
    column = F.element_at(F.array(*[F.lit(c) for c in ("size", "kind", "absent", "p_partkey", "price")]), (F.col("p_size") % 5 + 1).cast("int"))
    task = F.when(F.col("p_partkey") % 11 == 0, "Regression").otherwise("classification")
    target = F.when(F.col("p_partkey") % 7 == 0, "price").otherwise("kind")
    scale = F.when(F.col("p_size") % 2 == 0, '{"column": "price", "methods": ["standardize"]}').otherwise("")
    body = F.concat(
        F.lit(_HEAD), task, F.lit('", "target": "'), target, F.lit(_MIDDLE), column,
        F.lit('", "methods": ["median", "mean"]}], "sampling": [{"column": "'), column,
        F.lit('", "methods": ["SMOTE"]}]}, "feature_engineering": {"encoding": [{"column": "kind", "methods": ["one_hot_encode"]}], "transformation": ['),
        scale, F.lit(_TAIL),
    )
    tagged = F.concat(F.lit("Here it is\n<json>\n"), body, F.lit("\n</json>\ndone"))
    text = (
        F.when(kind == 0, body).when(kind == 1, tagged)
        .when(kind == 2, F.concat(F.lit("plan: "), F.regexp_replace(body, r"\]\}$", "],}"), F.lit(" end")))
        .when(kind == 3, F.regexp_replace(body, '"median"', '"guess"')).when(kind == 4, F.concat(F.lit("no plan for "), "p_brand"))
        .otherwise(F.concat(F.lit("<json>\n{}\n</json>\n"), tagged))
    )
    return part.select("p_partkey", text.alias("text"))


def _plans(spark, d):
    # parsed once, read by several branches
    return parse.parse_plans(plan_texts(spark, d)).drop("text").persist()


_CHOSEN = """WITH t AS (SELECT p_partkey, p_size, CASE p_size % 5 WHEN 0 THEN 'size' WHEN 1 THEN 'kind' WHEN 2 THEN 'absent' WHEN 3 THEN 'p_partkey' ELSE 'price' END AS c,
  CASE WHEN p_partkey % 11 = 0 THEN 'REGRESSION' ELSE 'CLASSIFICATION' END AS task_type, CASE WHEN p_partkey % 7 = 0 THEN 'price' ELSE 'kind' END AS target
  FROM part WHERE p_partkey % 6 NOT IN (3, 4)),
o AS (SELECT p_partkey, 0 AS position, 'missing_values' AS category, c AS attribute, 'MEDIAN' AS method FROM t
  UNION ALL SELECT p_partkey, 1, 'missing_values', c, 'MEAN' FROM t UNION ALL SELECT p_partkey, 2, 'sampling', c, 'SMOTE' FROM t
  UNION ALL SELECT p_partkey, 3, 'transformation', 'price', 'STANDARDIZE' FROM t WHERE p_size % 2 = 0
  UNION ALL SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 4 ELSE 3 END, 'encoding', 'kind', 'ONE_HOT_ENCODE' FROM t)
"""


@query("p1_parse_plans", "SELECT p.p_partkey, t.p_partkey IS NOT NULL AS parsed, task_type, target FROM part p LEFT JOIN (" + _CHOSEN.replace("WITH t AS (", "").split("),\no AS")[0] + ") t ON t.p_partkey = p.p_partkey")
def p1(spark, d):
    plans = _plans(spark, d)
    heads = parse.plan_heads(plans, "p_partkey")
    return plans.select("p_partkey", F.col("plan").isNotNull().alias("parsed")).join(heads, "p_partkey", "left")


@query("p2_explode_plan", _CHOSEN + "SELECT p_partkey, position::BIGINT AS position, category, attribute, method FROM o")
def p2(spark, d):
    ops = parse.explode_plan(_plans(spark, d), "p_partkey")
    return shaped(ops.select("p_partkey", "position", "category", F.col("column").alias("attribute"), "method"))


@query("p3_filter_methods", _CHOSEN + "SELECT p_partkey, position::BIGINT AS position, method FROM o WHERE NOT (position = 0 AND p_partkey % 2 = 0)")
def p3(spark, d):
    plans = _plans(spark, d)
    masks = plans.where("p_partkey % 2 = 0").select(
        "p_partkey", F.lit("missing_values").alias("category"), F.lit(0).alias("step"), F.array(F.lit(False), F.lit(True)).alias("mask")
    )
    kept = parse.filter_methods(parse.explode_plan(plans, "p_partkey"), masks, "p_partkey")
    return shaped(kept.select("p_partkey", "position", "method"))


_CONTEXT = parse.ValidationContext(
    "kind", "CLASSIFICATION", protected=frozenset(["price"]), ids=frozenset(["p_partkey"]), sentinels={"size": -1}
)


@query(
    "p4_validate_plans",
    _CHOSEN + """, cat(attribute, num) AS (VALUES ('p_partkey', true), ('p_brand', false), ('size', true), ('price', true), ('kind', false)),
    j AS (SELECT o.*, cat.attribute IS NOT NULL AS known, num FROM o LEFT JOIN cat USING (attribute))
    SELECT p_partkey AS plan, 'task_mismatch' AS reason_code, CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS attribute, CAST(NULL AS VARCHAR) AS method FROM t WHERE task_type <> 'CLASSIFICATION'
    UNION ALL SELECT p_partkey, 'target_mismatch', NULL, target, NULL FROM t WHERE target <> 'kind'
    UNION ALL SELECT p_partkey, 'missing_column', category, attribute, method FROM j WHERE NOT known
    UNION ALL SELECT p_partkey, 'target_transformation', category, attribute, method FROM j WHERE known AND attribute = 'kind' AND category <> 'sampling'
    UNION ALL SELECT p_partkey, 'protected_column', category, attribute, method FROM j WHERE attribute = 'price' AND category <> 'sampling'
    UNION ALL SELECT p_partkey, 'id_column', category, attribute, method FROM j WHERE attribute = 'p_partkey' AND category <> 'sampling'
    UNION ALL SELECT p_partkey, 'sentinel_protected', category, attribute, method FROM j WHERE attribute = 'size' AND category <> 'sampling'
    UNION ALL SELECT p_partkey, 'sampling_target_mismatch', category, attribute, method FROM j WHERE known AND category = 'sampling' AND attribute <> 'kind'
    UNION ALL SELECT p_partkey, 'numeric_operation_on_non_numeric', category, attribute, method FROM j WHERE known AND NOT num AND method IN ('MEAN', 'MEDIAN', 'STANDARDIZE')
    UNION ALL SELECT p_partkey, 'conflicting_operation', category, attribute, NULL FROM o GROUP BY p_partkey, category, attribute HAVING count(DISTINCT method) > 1""",
)
def p4(spark, d):
    plans = _plans(spark, d)
    issues = parse.validate_plans(
        parse.explode_plan(plans, "p_partkey"), parse.plan_heads(plans, "p_partkey"), parse.column_catalogue(priced(spark, d)), _CONTEXT, "p_partkey"
    )
    return issues.withColumnRenamed("column", "attribute")
