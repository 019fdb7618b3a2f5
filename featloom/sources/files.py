"""File sources and sinks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from posixpath import join as path_join
from urllib.parse import unquote

import pandas as pd
from pyarrow import fs as pa_fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featloom.core import col, rows_frame

_BOM = "﻿"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with header; types are inferred unless a schema is given."""
    reader = spark.read.option("header", True).option("multiLine", False)
    try:
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"file not found at: {path}") from error
        raise
    return df.toDF(*[c.removeprefix(_BOM) for c in df.columns])


def read_csv_from_dir(spark: SparkSession, directory: str, filename: str) -> DataFrame:
    return read_csv(spark, path_join(directory, filename))


def load_frames(spark: SparkSession, directory: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Related CSV tables by name."""
    return {name: read_csv_from_dir(spark, directory, f"{name}.csv") for name in names}


def write_csv(df: DataFrame, path: str) -> None:
    """CSV sink with header; Spark creates the directory."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_json(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines (manifests, metric rows, event lines)."""
    df.write.mode("append").json(path)


def read_dataset(
    spark: SparkSession, path: str, limit: int = 0, order_by: Sequence[str] = (), columns: Sequence[str] = ()
) -> DataFrame:
    """Stored table; `limit` > 0 returns a preview in a repeatable order."""
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*[col(c) for c in columns])
    if limit > 0:
        df = preview(df, limit, order_by)
    return df


def preview(df: DataFrame, limit: int, order_by: Sequence[str] = ()) -> DataFrame:
    ordered = df.orderBy(*[col(c) for c in order_by]) if order_by else df
    return ordered.limit(limit)


def dataset_columns(df: DataFrame) -> DataFrame:
    """Name and type of every column, in order."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return rows_frame(df.sparkSession, rows, "position int, name string, type string")


# fixed values: fields of a run record and of one condition in it
RUN_RECORD = (
    "split_seed long, repetition long, status string, conditions map<string, struct<"
    "status: string, stage: string, reason: string, phase: string, error: string, "
    "accuracy: double, f1: double, auroc: double, pr_auc: double, operations: array<string>>>"
)


def read_run_records(spark: SparkSession, root: str, glob: str = "seed_*/run_*/result.json", lines: bool = False) -> DataFrame:
    """All run records below `root`: one document per file, or JSON lines."""
    return spark.read.schema(RUN_RECORD).option("multiLine", not lines).json(path_join(root, glob))


# files up to this size are hashed by the built-in function, larger ones are read in pieces
WHOLE_BYTES = 256 << 20
_READ_BYTES = 8 << 20


def _listed(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Files below `path` by name and size; no content is read.

    Scans skip empty files, so these are taken from the names that Spark listed for the scan.
    """
    scan = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")
    names = [(re.sub("^file:/+", "file:/", unquote(uri)),) for uri in scan.inputFiles()]
    empty = rows_frame(spark, names, "path string").join(scan, "path", "left_anti")
    return scan.unionByName(empty.select("path", F.lit(0).cast("long").alias("length")))


def _opened(path: str):
    """A file open for random reads on an executor: local paths, and schemes that pyarrow knows."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return pa_fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    store, place = pa_fs.FileSystem.from_uri(path)
    return store.open_input_file(place)


def _name() -> Column:
    return F.element_at(F.split("path", "/"), -1)


def file_digests(spark: SparkSession, path: str, pattern: str = "*", whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """SHA-256 of every file below `path`.

    A file above `whole_bytes` is streamed through one task in pieces of 8 MB, since this digest is sequential by
    definition; `file_trees` spreads a file over tasks. Schemes that pyarrow doesn't know fail for such files.
    """

    def streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for place, length in zip(batch["path"], batch["length"], strict=True):
                digest = hashlib.sha256()
                with _opened(place) as source:
                    while piece := source.read(_READ_BYTES):
                        digest.update(piece)
                yield pd.DataFrame({"path": [place], "length": [length], "sha256": [digest.hexdigest()]})

    stored = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    small = stored.where(F.col("length") <= whole_bytes).select("path", "length", F.sha2("content", 256).alias("sha256"))
    rest = _listed(spark, path, pattern).where((F.col("length") > whole_bytes) | (F.col("length") == 0))
    large = rest.repartition("path").mapInPandas(streamed, "path string, length long, sha256 string")
    return small.unionByName(large).select(_name().alias("file"), F.col("length").alias("bytes"), "sha256")


def chunk_digests(spark: SparkSession, path: str, pattern: str = "*", chunk_bytes: int = 64 << 20) -> DataFrame:
    """SHA-256 of every chunk of every file: (path, bytes, chunk, sha256). An empty file has one empty chunk.

    Tasks read byte ranges, so one large file is read by many of them; a task holds 8 MB of it at a time.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for place, chunk in zip(batch["path"], batch["chunk"], strict=True):
                digest, left = hashlib.sha256(), chunk_bytes
                with _opened(place) as source:
                    source.seek(chunk * chunk_bytes)
                    while left and (piece := source.read(min(left, _READ_BYTES))):
                        digest.update(piece)
                        left -= len(piece)
                found.append(digest.hexdigest())
            yield batch.assign(sha256=found)

    last = F.greatest(F.lit(0), F.floor((F.col("length") - 1) / chunk_bytes)).cast("long")
    chunks = _listed(spark, path, pattern).select("path", F.col("length").alias("bytes"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    spread = chunks.repartition(F.col("path"), F.col("chunk"))
    return spread.mapInPandas(read, "path string, bytes long, chunk long, sha256 string")


def tree_level(nodes: DataFrame, fan_out: int) -> DataFrame:
    """Parents of (path, bytes, chunk, sha256): the digest of `fan_out` neighbouring nodes' digests."""
    children = F.array_sort(F.collect_list(F.struct("chunk", "sha256")))
    grouped = nodes.groupBy("path", "bytes", F.floor(F.col("chunk") / fan_out).alias("parent")).agg(children.alias("c"))
    joined = F.array_join(F.transform("c", lambda x: x["sha256"]), "")
    return grouped.select("path", "bytes", F.col("parent").alias("chunk"), F.sha2(joined.cast("binary"), 256).alias("sha256"))


def file_trees(
    spark: SparkSession, path: str, pattern: str = "*", chunk_bytes: int = 64 << 20, fan_out: int = 1024
) -> DataFrame:
    """Root of a Merkle tree over the chunks of every file: (file, bytes, root).

    A node is the SHA-256 of its children's hexadecimal digests one after the other, `fan_out` children at most; a file
    of one chunk has that chunk's digest as root. No group holds more than `fan_out` digests, whatever a file's size.
    """
    longest = _listed(spark, path, pattern).agg(F.max("length")).first()[0] or 0
    nodes, width = chunk_digests(spark, path, pattern, chunk_bytes), -(-longest // chunk_bytes)
    while width > 1:
        level = tree_level(nodes, fan_out)
        # files of one chunk have no level above it
        nodes = level.where(F.col("bytes") > chunk_bytes).unionByName(nodes.where(F.col("bytes") <= chunk_bytes))
        width = -(-width // fan_out)
    return nodes.select(_name().alias("file"), "bytes", F.col("sha256").alias("root"))


def changed_chunks(now: DataFrame, before: DataFrame) -> DataFrame:
    """Chunks of `now` that are new or differ from those of `before`, and chunks that are gone: (path, chunk, change)."""
    old = before.select("path", "chunk", F.col("sha256").alias("old"))
    joined = now.select("path", "chunk", "sha256").join(old, ["path", "chunk"], "full")
    change = F.when(F.col("old").isNull(), "new").when(F.col("sha256").isNull(), "gone").when(F.col("old") != F.col("sha256"), "changed")
    return joined.select("path", "chunk", change.alias("change")).where("change is not null")


def validate_files(digests: DataFrame, manifest: DataFrame) -> DataFrame:
    """Failures of a (file, sha256) manifest: `missing:file` and `hash:file`."""
    expected = manifest.select("file", F.lower("sha256").alias("expected"))
    joined = expected.join(digests.select("file", "sha256"), "file", "left")
    failure = F.when(F.col("sha256").isNull(), F.concat(F.lit("missing:"), "file")).when(
        F.col("sha256") != F.col("expected"), F.concat(F.lit("hash:"), "file")
    )
    return joined.select(failure.alias("failure")).where("failure is not null")
