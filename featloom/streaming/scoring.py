"""Scoring of submitted rows: the stored model applied to a stream."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from featloom.operators.model import predict
from featloom.operators.prepare import FittedPreparation


def read_submissions(spark: SparkSession, path: str, schema: StructType, file_format: str = "parquet", **options) -> DataFrame:
    """Rows arriving as files; the schema is fixed."""
    return spark.readStream.format(file_format).schema(schema).options(**options).load(path)


def score_stream(stream: DataFrame, fitted: FittedPreparation, model: Model) -> DataFrame:
    """Prepared and scored rows; a pure projection, so no state is kept."""
    return predict(model, fitted.transform(stream), fitted.output_columns)


def write_scores(scored: DataFrame, path: str, checkpoint: str, file_format: str = "parquet", once: bool = True) -> StreamingQuery:
    """Append scored rows exactly once, tracked in the checkpoint folder."""
    writer = scored.writeStream.outputMode("append").format(file_format).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
