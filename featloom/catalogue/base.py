"""Register of runnable queries with their independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featloom.core import col

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; `sql` is its equivalent over the same tables."""

    def decorate(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return decorate


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shaped(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and integers widened, for comparison with SQL results."""
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits)
            c = F.when(c == 0, F.lit(0.0)).otherwise(c)
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(out)


def hash_sql(key: str, seed: object) -> str:
    """The shuffle position of a row, in SQL."""
    return f"('0x' || substr(md5(concat_ws('|', cast({key} AS VARCHAR), '{seed}')), 1, 15))::BIGINT"
