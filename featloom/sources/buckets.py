"""A keyed table in hash buckets that merges updates without rewriting the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.core import checkpointed, col, require_columns, rows_frame
from featloom.sources.registry import keyed_upsert

BUCKET = "_bucket"


class BucketedTable:
    """Rows by key below `path`; a merge writes new files only for buckets that get an update.

    Files lie under data/generation=G/_bucket=B. A manifest per generation names the generation that holds each bucket
    and is written last: a merge that is lost on its way leaves the table as it was, and the next one takes its place.
    Older generations stay readable through `read(generation)`. There is one writer at a time. Null is a key like any
    other; with repeated keys in one merge the row that `keyed_upsert` names wins. An empty merge changes nothing.
    The driver sees bucket numbers only, at most `buckets` of them.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 256):
        if buckets < 1 or not keys:
            raise ValueError(f"a bucketed table needs key columns and a bucket, not {list(keys)} and {buckets}")
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets

    def _number(self) -> Column:
        return F.pmod(F.xxhash64(*[col(k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def generations(self) -> list[int]:
        """Numbers of the complete merges, oldest first."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        store = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(folder):
            return []
        names = [s.getPath() for s in store.listStatus(folder)]
        done = [p.getName() for p in names if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(name.removeprefix("generation=")) for name in done)

    def holders(self, generation: int | None = None) -> dict[int, int]:
        """The generation that holds each bucket, as the given or the newest merge left it."""
        known = self.generations()
        if not known:
            return {}
        rows = self.spark.read.parquet(f"{self.path}/manifest/generation={known[-1] if generation is None else generation}").collect()
        if any((r["buckets"], r["keys"]) != (self.buckets, self.keys) for r in rows):
            raise ValueError(f"{self.path} has {rows[0]['buckets']} buckets by {rows[0]['keys']}, not {self.buckets} by {self.keys}")
        return {r["bucket"]: r["holder"] for r in rows}

    def _rows(self, holders: dict[int, int]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/data/generation={g}/{BUCKET}={b}" for b, g in sorted(holders.items())])

    def read(self, generation: int | None = None) -> DataFrame:
        holders = self.holders(generation)
        if not holders:
            raise ValueError(f"{self.path} has no complete merge yet")
        return self._rows(holders)

    def merge(self, updates: DataFrame, latest_by: str | None = None) -> list[int]:
        """Replace rows of known keys and add the others; the numbers of the buckets that were rewritten."""
        require_columns(updates, self.keys)
        if BUCKET in updates.columns:
            raise ValueError(f"the column name {BUCKET} is taken by the table itself")
        holders = self.holders()
        if holders:
            # equal keys of another type would fall into another bucket
            schema = self._rows(holders).schema
            require_columns(updates, schema.names)
            order = [] if latest_by is None or latest_by in schema.names else [col(latest_by)]
            updates = updates.select(*[col(f.name).cast(f.dataType).alias(f.name) for f in schema], *order)
        new = checkpointed(updates)
        touched = sorted(r[0] for r in new.select(self._number()).distinct().collect())
        if not touched:
            return []
        known = {b: holders[b] for b in touched if b in holders}
        names = schema.names if holders else new.columns
        base = self._rows(known) if known else new.select(*[col(c) for c in names]).limit(0)
        merged = keyed_upsert(base, new, self.keys, latest_by).withColumn(BUCKET, self._number())
        number = max(self.generations(), default=0) + 1
        # A large bucket is split into several files, small ones share a task.
        merged.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/data/generation={number}")
        now = holders | dict.fromkeys(touched, number)
        rows = [(b, g, self.buckets, self.keys) for b, g in sorted(now.items())]
        manifest = rows_frame(self.spark, rows, "bucket int, holder int, buckets int, keys array<string>")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/generation={number}")
        return touched
