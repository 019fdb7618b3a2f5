"""Shared column helpers, size-checked broadcasts and checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = "numeric"
CATEGORICAL = "categorical"
DATETIME = "datetime"

# A side is broadcast, or pulled to the driver, only below this many rows.
SMALL_SIDE_ROWS = 100_000


def quoted(name: str) -> str:
    """Backtick a column name, so that `SUM(child.x)` is one column."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_datetime(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if f.name not in skip and is_numeric(f.dataType)]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if f.name not in skip and isinstance(f.dataType, (T.StringType, T.BooleanType))
    ]


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"the frame has no column {', '.join(map(repr, missing))}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """One missing notion: NaN becomes NULL and decimals become doubles."""
    fields = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        fields.append(c.alias(f.name))
    return df.select(fields)


def clean(c: Column) -> Column:
    """Double with NaN mapped to NULL."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def safe_divide(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b, or `default` when b is zero."""
    ratio = F.try_divide(a.cast("double"), b.cast("double"))
    return ratio if default is None else F.coalesce(ratio, F.lit(float(default)))


def small_rows(df: DataFrame, limit: int = SMALL_SIDE_ROWS) -> list | None:
    """The rows of `df` if there are at most `limit` of them, else None."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def checked_broadcast(df: DataFrame, limit: int = SMALL_SIDE_ROWS) -> DataFrame:
    """Broadcast `df` when its row count is proven small, else leave the join to AQE."""
    rows = small_rows(df, limit)
    if rows is None:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def spread(df: DataFrame, rows: int) -> DataFrame:
    """`df` dealt evenly over tasks of about `rows` rows, for work per row that the size of the input does not show."""
    return df.repartition(max(1, -(-df.count() // rows)))


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the session names; a local session without one gets its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is not None:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    shared = tempfile.mkdtemp(prefix="featloom-")
    spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; what lies there is removed when the application ends."""
    root = "/".join([shared_folder(spark).rstrip("/"), "featloom", spark.sparkContext.applicationId])
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        store.mkdirs(folder)
        store.deleteOnExit(folder)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written below the shared folder as Parquet and read again: what is read many times is computed once, and read by column."""
    if any(isinstance(f.dataType, T.NullType) for f in df.schema.fields):
        return checkpointed(df)
    path, spark = scratch_path(df.sparkSession, name), df.sparkSession
    # column names of any kind, and names that differ by case only
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    plain.write.parquet(path)
    return spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)


def rows_frame(spark: SparkSession, rows: Sequence, schema: str) -> DataFrame:
    """Frame over a few driver-side scalars (fit results, metric rows)."""
    return spark.createDataFrame(list(rows), schema)


def beside(df: DataFrame, other: DataFrame) -> DataFrame:
    """Add the columns of the single-row frame `other` as literals."""
    row = other.first()
    return df.select("*", *[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in other.schema.fields])
