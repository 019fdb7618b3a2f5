"""Dataset fingerprints and the keyed dataset register."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featloom.core import col


def row_digest(df: DataFrame) -> Column:
    """MD5 of a row's values; every value is preceded by its length and NULL is a dash, so no two rows read alike."""
    text = lambda c: col(c).cast("string")
    parts = [F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in df.columns]
    return F.md5(F.concat(*parts))


def _digest_number(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("long")


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content fingerprint, combined map-side in one pass.

    Two digest halves are XORed and summed (as decimal, which cannot overflow),
    so equal multisets of rows agree and repeated rows do not cancel out.
    """
    digest = row_digest(df)
    numbers = df.select(_digest_number(digest, 1).alias("a"), _digest_number(digest, 17).alias("b"))
    sums = numbers.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.bit_xor("a"), F.lit(0)).alias("xor_a"),
        F.coalesce(F.sum(F.col("b").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum_b"),
    )
    text = F.concat_ws("|", F.col("rows").cast("string"), F.col("xor_a").cast("string"), "sum_b")
    return sums.select("rows", F.upper(F.md5(text)).alias("md5"))


def ordered_fingerprint(df: DataFrame, order_by: str) -> DataFrame:
    """Fingerprint that also changes when rows swap their `order_by` value."""
    return fingerprint(df.select(col(order_by).alias("_position"), *[col(c) for c in df.columns if c != order_by]))


def sanitise_names(df: DataFrame) -> DataFrame:
    """`(` and `.` become `_`, `)` is removed; a collision is an error."""
    names = [c.replace("(", "_").replace(")", "").replace(".", "_") for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("sanitised column names collide")
    return df.toDF(*names)


def type_label(data_type: T.DataType) -> str:
    if isinstance(data_type, T.IntegralType):
        return "int"
    if isinstance(data_type, T.NumericType):
        return "float"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "string"


def dataset_info(df: DataFrame) -> DataFrame:
    """Catalogue row: fingerprint, shape, sanitised names and mapped types."""
    named = sanitise_names(df)
    return fingerprint(named).select(
        "md5",
        "rows",
        F.lit(len(named.columns)).alias("cols"),
        F.lit(",".join(named.columns)).alias("col_names"),
        F.lit(",".join(type_label(f.dataType) for f in named.schema.fields)).alias("col_types"),
    )


def keyed_upsert(
    base: DataFrame, updates: DataFrame, keys: Sequence[str], latest_by: str | None = None
) -> DataFrame:
    """Replace matched keys, insert new ones; null is a key like any other.

    Of several updates of one key the one with the greatest `latest_by` wins, then the one with the greatest other values
    in column order; null is the least value.
    """
    keys = list(keys)
    rest = [c for c in updates.columns if c not in keys]
    ids = [col(k) for k in keys]
    if rest:
        # an aggregate, not a window: a hot key is reduced before the shuffle
        ordered = sorted(rest, key=lambda c: c != latest_by)
        newest = F.max(F.struct(*[col(c).alias(c) for c in ordered])).alias("_new")
        updates = updates.groupBy(*ids).agg(newest).select(*ids, "_new.*")
    else:
        updates = updates.dropDuplicates(keys)
    names = [f"_key{i}" for i in range(len(keys))]
    known = updates.select(*[c.alias(n) for c, n in zip(ids, names, strict=True)])
    same = [c.eqNullSafe(F.col(n)) for c, n in zip(ids, names, strict=True)]
    kept = base.join(known, same, "left_anti")
    return kept.unionByName(updates.select(*[col(c) for c in base.columns]))


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None) -> None:
    """Replace a relational table with the frame."""
    df.write.jdbc(url, table, mode="overwrite", properties=properties or {})


def declared_references(df: DataFrame, ids: str, catalogue: DataFrame, key: str) -> DataFrame:
    """Ids listed in a comma-separated column that have no catalogue row."""
    listed = df.select(F.explode(F.split(col(ids), ",")).alias("id")).select(F.trim("id").alias("id")).distinct()
    known = catalogue.select(col(key).cast("string").alias("id"))
    return listed.join(known, "id", "left_anti")


