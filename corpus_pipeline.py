"""Five stages from raw documents to a weighted training sample.

Each stage takes and returns a frame with the columns of `documents`; it is written as Parquet and read again for the
next one. Texts that a stage cuts get their new length in `n_chars`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.llm.base import stored, table
from featloom.llm.decontaminate import decontaminated
from featloom.llm.language import accepted
from featloom.llm.mixture import TARGETS, mixed_sample
from featloom.llm.neardup import without_near_duplicates
from featloom.llm.passages import without_repeats


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or whose language is doubtful at both steps, go; a null language is filled in."""
    return accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 0.8 of their runs of five words the one with the smallest id stays."""
    return without_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occurred in an earlier document are cut out."""
    return _measured(without_repeats(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are contaminated go; benchmark passages are cut out of the others."""
    return _measured(decontaminated(docs, table(spark, sf_dir, "benchmark")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and topics meet their target weights; unlisted languages keep a share."""
    return mixed_sample(docs, targets=TARGETS)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("mixing", mixing),
]

#: Language identification and near duplicates are no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
