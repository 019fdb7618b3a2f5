"""Plan texts as data: parse, explode, mask and validate many plans at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.core import col, is_numeric, rows_frame
from featloom.plans.plan import (
    CATEGORIES,
    METHODS,
    METRICS,
    OVERALL_QUALITY,
    QUALITY_TYPES,
    TASK_TYPES,
    VALIDATION_METHODS,
    Plan,
    Step,
)

_STEP = "array<struct<column: string, methods: array<string>>>"
# fixed values: the fields of a plan document
PLAN_SCHEMA = (
    "struct<data_quality_report: struct<overall_quality: string, summary: string, "
    "issues: array<struct<type: string, columns: array<string>, description: string>>, "
    "strengths: array<struct<type: string, description: string>>>, "
    "modeling_approaches: array<struct<task_type: string, target: string, "
    "recommended_algorithm: struct<name: string, reason: string, params: map<string,string>>, "
    "evaluation_metrics: array<string>, "
    "cross_validation: struct<method: string, folds: int, stratified: boolean>, "
    f"data_cleaning: struct<missing_values: {_STEP}, sampling: {_STEP}>, "
    f"feature_engineering: struct<encoding: {_STEP}, transformation: {_STEP}, extraction: {_STEP}>, "
    "test_size: double, validation_size: double>>>"
)
_CORRUPT = "_corrupt_record"
_TAGGED = r"(?s)<json>\n(.*?)\n</json>"


def clean_json_text(text: Column) -> Column:
    """Cut from the first `{` to the last `}` and drop trailing commas."""
    cut = F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), text)
    return F.regexp_replace(F.regexp_replace(cut, r",\s*\}", "}"), r",\s*\]", "]")


def _all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _named(value: Column, names: Sequence[str]) -> Column:
    return F.coalesce(F.upper(value).isin(list(names)), F.lit(False))


def _each(array: Column, test) -> Column:
    """Array present, without nulls, every element passing."""
    return array.isNotNull() & F.coalesce(F.forall(array, lambda x: x.isNotNull() & test(x)), F.lit(False))


def _valid_steps(steps: Column, category: str) -> Column:
    return _each(steps, lambda s: s["column"].isNotNull() & _each(s["methods"], lambda m: _named(m, METHODS[category])))


def _valid(doc: Column) -> Column:
    """All required fields present and all names known, ignoring case."""
    report = doc["data_quality_report"]

    def approach(a: Column) -> Column:
        algorithm, cv = a["recommended_algorithm"], a["cross_validation"]
        cleaning, features = a["data_cleaning"], a["feature_engineering"]
        return _all_of(
            [
                _named(a["task_type"], TASK_TYPES),
                a["target"].isNotNull(),
                algorithm["name"].isNotNull() & algorithm["reason"].isNotNull() & algorithm["params"].isNotNull(),
                _each(a["evaluation_metrics"], lambda m: _named(m, METRICS)),
                _named(cv["method"], VALIDATION_METHODS) & cv["folds"].isNotNull() & cv["stratified"].isNotNull(),
                _valid_steps(cleaning["missing_values"], "missing_values"),
                _valid_steps(cleaning["sampling"], "sampling"),
                _valid_steps(features["encoding"], "encoding"),
                _valid_steps(features["transformation"], "transformation"),
                _valid_steps(features["extraction"], "extraction"),
                a["test_size"].isNotNull() & a["validation_size"].isNotNull(),
            ]
        )

    return _all_of(
        [
            doc[_CORRUPT].isNull(),
            _named(report["overall_quality"], OVERALL_QUALITY) & report["summary"].isNotNull(),
            _each(
                report["issues"],
                lambda i: _named(i["type"], QUALITY_TYPES) & _each(i["columns"], lambda c: c.isNotNull()) & i["description"].isNotNull(),
            ),
            _each(report["strengths"], lambda s: _named(s["type"], QUALITY_TYPES) & s["description"].isNotNull()),
            _each(doc["modeling_approaches"], approach),
        ]
    )


def parse_plans(df: DataFrame, text: str = "text") -> DataFrame:
    """Add `plan`: the first valid document of each text, or NULL.

    Documents stand between tag lines, else the whole text is one. A document
    that is no JSON is retried once after cleaning.
    """
    schema = PLAN_SCHEMA[:-1] + f", {_CORRUPT}: string>"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    tagged = F.regexp_extract_all(col(text), F.lit(_TAGGED), F.lit(1))
    texts = F.when(F.size(tagged) > 0, tagged).otherwise(F.array(col(text)))

    def attempt(t: Column) -> Column:
        doc = F.transform(F.array(t), lambda x: F.from_json(x, schema, options))
        return F.get(F.filter(doc, lambda x: F.coalesce(_valid(x), F.lit(False))), 0)

    def parsed(t: Column) -> Column:
        # the cleaned text is only parsed when the first attempt fails
        return F.coalesce(attempt(t), attempt(clean_json_text(t)))

    found = F.get(F.filter(F.transform(texts, parsed), lambda d: d.isNotNull()), 0)
    with_plan = df.withColumn("plan", found)
    return with_plan.withColumn("plan", F.when(F.col("plan").isNotNull(), F.col("plan").dropFields(_CORRUPT)))


def explode_plan(df: DataFrame, plan_id: str, approach: int = 0, plan: str = "plan") -> DataFrame:
    """Operations of each plan in fixed category order, one row per method."""
    chosen = F.get(F.col(f"{plan}.modeling_approaches"), approach)
    groups = {
        "missing_values": ("data_cleaning", "missing_values"),
        "sampling": ("data_cleaning", "sampling"),
        "transformation": ("feature_engineering", "transformation"),
        "encoding": ("feature_engineering", "encoding"),
        "extraction": ("feature_engineering", "extraction"),
    }

    def rows(category: str) -> Column:
        part, name = groups[category]
        steps = F.col("_approach")[part][name]
        return F.flatten(
            F.transform(
                steps,
                lambda s, i: F.transform(
                    s["methods"],
                    lambda m, j: F.struct(
                        F.lit(category).alias("category"),
                        i.alias("step"),
                        j.alias("choice"),
                        F.size(s["methods"]).alias("choices"),
                        s["column"].alias("column"),
                        F.upper(m).alias("method"),
                    ),
                ),
            )
        )

    everything = F.concat(*[rows(c) for c in CATEGORIES])
    base = df.select(col(plan_id).alias(plan_id), chosen.alias("_approach")).where("_approach is not null")
    exploded = base.select(plan_id, F.posexplode(everything).alias("position", "_o"))
    return exploded.select(plan_id, "position", "_o.*")


def plan_heads(df: DataFrame, plan_id: str, approach: int = 0, plan: str = "plan") -> DataFrame:
    """(plan, task_type, target) of the chosen approach."""
    chosen = F.get(F.col(f"{plan}.modeling_approaches"), approach)
    heads = df.select(col(plan_id).alias(plan_id), chosen.alias("_a")).where("_a is not null")
    return heads.select(plan_id, F.upper("_a.task_type").alias("task_type"), F.col("_a.target").alias("target"))


def filter_methods(operations: DataFrame, masks: DataFrame, plan_id: str) -> DataFrame:
    """Keep masked methods; `masks` has (plan, category, step, mask array).

    Steps without a mask stay whole; a mask of another length is an error.
    """
    keys = [plan_id, "category", "step"]
    joined = operations.join(masks.select(*[col(k) for k in keys], "mask"), keys, "left")
    wrong = F.col("mask").isNotNull() & (F.size("mask") != F.col("choices"))
    message = F.format_string(
        "%s[%d] has %d selections for %d methods", F.col("category"), F.col("step"), F.size("mask"), F.col("choices")
    )
    keep = F.when(wrong, F.raise_error(message).cast("boolean")).otherwise(
        F.coalesce(F.get(F.col("mask"), F.col("choice")), F.lit(True))
    )
    return joined.where(keep).select(*[col(c) for c in operations.columns])


# -------------------------------------------------------------- validation
@dataclass(frozen=True)
class ValidationContext:
    target: str
    task_type: str
    protected: frozenset[str] = frozenset()
    ids: frozenset[str] = frozenset()
    sentinels: Mapping[str, object] = field(default_factory=dict)


# fixed values: methods that need a numeric column
NUMERIC_METHODS = ["MEAN", "MEDIAN"] + METHODS["transformation"]

ISSUES = ["plan", "reason_code", "category", "column", "method"]


def column_catalogue(df: DataFrame) -> DataFrame:
    """(column, numeric) of a training frame's schema."""
    rows = [(f.name, is_numeric(f.dataType)) for f in df.schema.fields]
    return rows_frame(df.sparkSession, rows, "column string, numeric boolean")


def validate_plans(
    operations: DataFrame, heads: DataFrame, catalogue: DataFrame, context: ValidationContext, plan_id: str
) -> DataFrame:
    """All distinct issues (plan, reason_code, category, column, method).

    The methods of a (plan, category, column) meet in one row, so the
    operations are read and shuffled once.
    """
    none = F.lit(None).cast("string")
    c, cat = F.col("column"), F.col("category")
    grouped = operations.groupBy(col(plan_id).alias("plan"), "category", "column").agg(F.collect_list("method").alias("_methods"))
    # one row per table column
    known = F.broadcast(catalogue.select(F.col("column").alias("_c"), "numeric"))
    joined = grouped.join(known, c == F.col("_c"), "left")
    present, sampling = F.col("_c").isNotNull(), cat == "sampling"
    regression = F.lit(context.task_type.upper() == "REGRESSION")

    def among(names) -> Column:
        return c.isin(sorted(names)) if names else F.lit(False)

    checks = {
        "missing_column": ~present,
        "target_transformation": present & ~sampling & (c == context.target),
        "protected_column": present & ~sampling & among(context.protected),
        "id_column": present & ~sampling & among(context.ids),
        "sentinel_protected": present & ~sampling & among(context.sentinels),
        "sampling_target_mismatch": present & sampling & (c != context.target),
        "sampling_regression": present & sampling & regression,
        "unsupported_extraction": present & (cat == "extraction"),
    }
    scaling = present & cat.isin("missing_values", "transformation") & ~F.coalesce(F.col("numeric"), F.lit(True))

    def issue(test: Column, code: Column | str, method: Column) -> Column:
        name = F.lit(code) if isinstance(code, str) else code
        return F.when(test, F.struct(name.alias("code"), method.alias("method")))

    def of_method(m: Column) -> Column:
        repeats = F.size(F.filter("_methods", lambda x: x == m)) > 1
        found = [issue(test, code, m) for code, test in checks.items()]
        found.append(issue(scaling & m.isin(NUMERIC_METHODS), "numeric_operation_on_non_numeric", m))
        found.append(issue(repeats, "repeated_operation", m))
        return F.array_compact(F.array(*found))

    distinct = F.array_distinct("_methods")
    several = F.when(F.size(distinct) > 1, "conflicting_operation").otherwise("repeated_operation")
    of_column = F.array_compact(F.array(issue(F.size("_methods") > 1, several, none)))
    issues = F.concat(F.flatten(F.transform(distinct, of_method)), of_column)
    per_step = joined.select("plan", "category", "column", F.explode(issues).alias("_i")).select(
        "plan", F.col("_i.code").alias("reason_code"), "category", "column", F.col("_i.method").alias("method")
    )
    types = {r["column"]: r["numeric"] for r in catalogue.collect()}
    bad_type = context.task_type.upper() == "REGRESSION" and types.get(context.target) is False
    target = F.col("target")
    head_codes = F.array_compact(
        F.array(
            F.when(F.col("task_type") != context.task_type.upper(), F.struct(F.lit("task_mismatch").alias("code"), none.alias("column"))),
            F.when(
                (target != context.target) | F.lit(bad_type),
                F.struct(F.lit("target_mismatch").alias("code"), target.alias("column")),
            ),
        )
    )
    per_plan = heads.select(col(plan_id).alias("plan"), F.explode(head_codes).alias("x")).select(
        "plan", F.col("x.code").alias("reason_code"), none.alias("category"), F.col("x.column").alias("column"), none.alias("method")
    )
    return per_plan.unionByName(per_step)


# --------------------------------------------------------------- one plan
def plan_from_text(spark: SparkSession, text: str, approach: int = 0) -> Plan:
    """The parsed plan of one text; an unusable text is an error."""
    parsed = parse_plans(rows_frame(spark, [("p", text)], "id string, text string"))
    row = parsed.where("plan is not null").select("plan.modeling_approaches").first()
    if row is None or len(row["modeling_approaches"]) <= approach:
        raise ValueError("plan text parsing error")
    a = row["modeling_approaches"][approach]

    def steps(items) -> tuple[Step, ...]:
        return tuple(Step(s["column"], tuple(m.upper() for m in s["methods"])) for s in items)

    return Plan(
        a["target"], a["task_type"].upper(),
        steps(a["data_cleaning"]["missing_values"]), steps(a["data_cleaning"]["sampling"]),
        steps(a["feature_engineering"]["transformation"]), steps(a["feature_engineering"]["encoding"]),
        steps(a["feature_engineering"]["extraction"]),
    )
