"""Sources, sinks, fingerprints and the keyed register."""

from __future__ import annotations

from pyspark.sql import functions as F

from featloom.catalogue.base import query, shaped, table
from featloom.core import rows_frame, scratch_path
from featloom.sources import files, registry
from featloom.sources.buckets import BucketedTable


@query("a1_read_csv", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def a1(spark, d):
    path = scratch_path(spark, "csv")
    files.write_csv(table(spark, d, "customer"), path)
    return shaped(files.read_csv(spark, path))


@query(
    "a2_load_frames",
    """SELECT 'customer' AS name, count(*) AS rows, count(DISTINCT c_custkey) AS keys FROM customer
    UNION ALL SELECT 'orders', count(*), count(DISTINCT o_orderkey) FROM orders
    UNION ALL SELECT 'nation', count(*), count(DISTINCT n_nationkey) FROM nation""",
)
def a2(spark, d):
    root = scratch_path(spark, "frames")
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "nation": "n_nationkey"}
    for name in keys:
        files.write_csv(table(spark, d, name), f"{root}/{name}.csv")
    frames = files.load_frames(spark, root, list(keys))
    parts = [
        frames[n].agg(F.lit(n).alias("name"), F.count("*").alias("rows"), F.count_distinct(k).alias("keys")) for n, k in keys.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("a3_write_csv", "SELECT s_suppkey, s_name, round(s_acctbal, 6) AS s_acctbal FROM supplier")
def a3(spark, d):
    path = scratch_path(spark, "sink")
    files.write_csv(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return shaped(spark.read.option("header", True).schema("s_suppkey bigint, s_name string, s_acctbal double").csv(path))


@query("a5_read_dataset", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100")
def a5(spark, d):
    return files.read_dataset(spark, f"{d}/orders.parquet", 100, ["o_orderkey"], ["o_orderkey", "o_custkey", "o_orderstatus"])


def run_records(spark, d):
    """Run records from the events: one run per user, one condition per event type."""
    per = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 4).alias("v"), F.count("*").alias("n"))
    ok = F.col("v") >= 18
    condition = F.struct(
        F.when(ok, "succeeded").otherwise("failed").alias("status"),
        F.when(~ok, F.when(F.col("n") > 13, "fit").otherwise("output")).alias("stage"),
        F.when(~ok, F.lit("slow")).alias("reason"),
        F.lit(None).cast("string").alias("phase"),
        F.lit(None).cast("string").alias("error"),
        (F.floor(F.col("v")) / 100).alias("accuracy"),
        (F.floor(F.col("v")) / 200).alias("f1"),
        F.when(F.col("n") % 2 == 0, F.floor(F.col("v")) / 50).alias("auroc"),
        F.lit(None).cast("double").alias("pr_auc"),
        F.array("event_type").alias("operations"),
    )
    return per.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("event_type", condition))).alias("conditions")
    ).select(
        (F.col("user_id") % 5).alias("split_seed"), F.col("user_id").alias("repetition"), F.lit("succeeded").alias("status"), "conditions"
    )


RUN_ROWS = """
WITH per AS (SELECT user_id, event_type AS condition, round(avg(value), 4) AS v, count(*) AS n FROM events GROUP BY ALL),
runs AS (SELECT user_id % 5 AS split_seed, user_id AS repetition, condition,
  CASE WHEN v >= 18 THEN 'succeeded' ELSE 'failed' END AS status,
  CASE WHEN v < 18 THEN CASE WHEN n > 13 THEN 'fit' ELSE 'output' END END AS stage,
  CASE WHEN v < 18 THEN 'slow' END AS reason, CAST(NULL AS VARCHAR) AS phase,
  floor(v) / 100 AS accuracy, floor(v) / 200 AS f1, CASE WHEN n % 2 = 0 THEN floor(v) / 50 END AS auroc,
  CAST(NULL AS DOUBLE) AS pr_auc FROM per)
"""


@query("a6_run_records", RUN_ROWS + "SELECT split_seed, repetition, condition, status, stage, reason, round(accuracy, 6) AS accuracy FROM runs")
def a6(spark, d):
    from featloom.operators.metrics import run_conditions

    root = scratch_path(spark, "runs")
    records = run_records(spark, d)
    records.withColumn("seed", F.col("split_seed")).write.partitionBy("seed").json(root)
    found = run_conditions(files.read_run_records(spark, root, "seed=*/*.json", lines=True).select("split_seed", "repetition", "conditions"))
    return shaped(found.select("split_seed", "repetition", "condition", "status", "stage", "reason", "accuracy"))


@query(
    "a7_append_json",
    "SELECT event_type, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT event_type, count(*) FROM events WHERE value > 10 GROUP BY event_type",
)
def a7(spark, d):
    path = scratch_path(spark, "lines")
    events = table(spark, d, "events")
    files.append_json(events.groupBy("event_type").agg(F.count("*").alias("n")), path)
    files.append_json(events.where("value > 10").groupBy("event_type").agg(F.count("*").alias("n")), path)
    return spark.read.schema("event_type string, n bigint").json(path)


@query("a8_validate_files")
def a8(spark, d):
    digests = files.file_digests(spark, d, "*.parquet")
    known = digests.select("file", F.when(F.col("file") == "orders.parquet", F.sha2("file", 256)).otherwise(F.col("sha256")).alias("sha256"))
    manifest = known.unionByName(rows_frame(spark, [("absent.parquet", "0")], "file string, sha256 string"))
    return files.validate_files(digests, manifest)


def _supplier_files(spark, d):
    """One text file per nation, its lines in order."""
    path = scratch_path(spark, "suppliers")
    lines = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.concat_ws("|", "s_suppkey", "s_name", "s_acctbal").alias("value"))
    ordered = lines.repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey")
    ordered.select("s_nationkey", "value").write.partitionBy("s_nationkey").text(path)
    return path


_SUPPLIERS = """WITH f AS (SELECT s_nationkey, string_agg(concat_ws('|', s_suppkey, s_name, s_acctbal) || chr(10), '' ORDER BY s_suppkey) AS t FROM supplier GROUP BY s_nationkey)
"""


@query("a8_file_digests", _SUPPLIERS + "SELECT CAST(length(t) AS BIGINT) AS bytes, sha256(t) AS sha256 FROM f")
def a8_digests(spark, d):
    # half of the files lie above the size that is hashed as one value
    found = files.file_digests(spark, f"{_supplier_files(spark, d)}/*", "*.txt", whole_bytes=200)
    return shaped(found.select("bytes", "sha256"))


@query(
    "a8_file_trees",
    _SUPPLIERS + """, c AS (SELECT s_nationkey, i, sha256(substr(t, 64 * i + 1, 64)) AS h FROM f, unnest(range((length(t) + 63) // 64)) u(i)),
    l AS (SELECT s_nationkey, i // 3 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM c GROUP BY s_nationkey, i // 3)
    SELECT CAST(length(t) AS BIGINT) AS bytes, string_agg(h, '' ORDER BY i) AS level FROM l JOIN f USING (s_nationkey) GROUP BY s_nationkey, t""",
)
def a8_trees(spark, d):
    chunks = files.chunk_digests(spark, f"{_supplier_files(spark, d)}/*", "*.txt", chunk_bytes=64)
    level = files.tree_level(chunks, 3)
    nodes = F.array_sort(F.collect_list(F.struct("chunk", "sha256")))
    return shaped(level.groupBy("path", "bytes").agg(nodes.alias("n")).select("bytes", F.array_join(F.transform("n", lambda x: x["sha256"]), "").alias("level")))


def _fingerprint_sql(source: str, columns: list[str]) -> str:
    cells = ", ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns)
    return f"""
    WITH g AS (SELECT md5(concat({cells})) AS h FROM {source}),
    s AS (SELECT count(*) AS rows, bit_xor(('0x' || substr(h, 1, 15))::BIGINT) AS x,
      sum(('0x' || substr(h, 17, 15))::BIGINT) AS y FROM g)
    SELECT rows, upper(md5(concat_ws('|', CAST(rows AS VARCHAR), CAST(x AS VARCHAR), CAST(y AS VARCHAR)))) AS md5"""


@query("a9_fingerprint", _fingerprint_sql("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]) + " FROM s")
def a9(spark, d):
    return registry.fingerprint(table(spark, d, "customer"))


@query("a9_ordered_fingerprint", _fingerprint_sql("events", ["event_id", "user_id", "event_type", "props"]) + " FROM s")
def a9o(spark, d):
    return registry.ordered_fingerprint(table(spark, d, "events").select("user_id", "event_type", "props", "event_id"), "event_id")


_INFO = """(SELECT o_orderkey, count(*) AS "COUNT_lineitem", max(l_linenumber) AS "MAX_lineitem_l_linenumber"
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)"""


@query(
    "a10_dataset_info",
    _fingerprint_sql(_INFO, ["o_orderkey", '"COUNT_lineitem"', '"MAX_lineitem_l_linenumber"'])
    + """, CAST(3 AS BIGINT) AS cols, 'o_orderkey,COUNT_lineitem,MAX_lineitem_l_linenumber' AS col_names, 'int,int,int' AS col_types FROM s""",
)
def a10(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("COUNT(lineitem)"), F.max("l_linenumber").alias("MAX(lineitem.l_linenumber)")
    )
    orders = table(spark, d, "orders").select("o_orderkey")
    fused = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")
    return shaped(registry.dataset_info(fused))


_UPSERT_SQL = """WITH u AS (SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, 2 AS version FROM orders WHERE o_orderstatus = 'F'
      UNION ALL SELECT o_orderkey + 1000000000, o_totalprice, 1 FROM orders WHERE o_orderstatus = 'P'
      UNION ALL SELECT o_orderkey, o_totalprice + 5, 1 FROM orders WHERE o_orderstatus = 'F')
    SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice, CAST(0 AS BIGINT) AS version FROM orders
      WHERE o_orderkey NOT IN (SELECT o_orderkey FROM u)
    UNION ALL SELECT o_orderkey, round(o_totalprice, 2), CAST(version AS BIGINT) FROM u
      WHERE NOT (version = 1 AND o_orderkey < 1000000000)"""


def _upserts(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.lit(0).alias("version"))
    done, part = orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'P'")
    price = F.col("o_totalprice")
    updates = (
        done.select("o_orderkey", (price + 1).alias("o_totalprice"), F.lit(2).alias("version"))
        .unionByName(part.select((F.col("o_orderkey") + 1000000000).alias("o_orderkey"), "o_totalprice", F.lit(1).alias("version")))
        .unionByName(done.select("o_orderkey", (price + 5).alias("o_totalprice"), F.lit(1).alias("version")))
    )
    return orders.drop("o_orderstatus"), updates


@query("a11_keyed_upsert", _UPSERT_SQL)
def a11(spark, d):
    orders, updates = _upserts(spark, d)
    return shaped(registry.keyed_upsert(orders, updates, ["o_orderkey"], latest_by="version"), 2)


@query("a11_bucket_merge", _UPSERT_SQL)
def a11_buckets(spark, d):
    orders, updates = _upserts(spark, d)
    table_ = BucketedTable(spark, scratch_path(spark, "register"), ["o_orderkey"], buckets=32)
    table_.merge(orders)
    table_.merge(updates, latest_by="version")
    return shaped(table_.read(), 2)
