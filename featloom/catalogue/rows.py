"""Projections, filters, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from featloom.catalogue.base import query, shaped, table
from featloom.functions import columns as fn
from featloom.functions.regex import regex_matches
from featloom.operators import prepare, profile
from featloom.operators.corrupt import key_algebra
from featloom.operators.metrics import mean_jaccard
from featloom.operators.split import entity_overlap
from featloom.sources import files


def priced(spark, d):
    """Parts with injected gaps, zeros and negatives."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    return table(spark, d, "part").select(
        "p_partkey", "p_brand",
        F.when(size % 7 != 0, size - 20).cast("double").alias("size"),
        F.when(size % 5 != 0, price).alias("price"),
        F.when(size % 11 != 0, F.col("p_type")).alias("kind"),
    )


PRICED = """(SELECT p_partkey, p_brand, CASE WHEN p_size % 7 <> 0 THEN CAST(p_size - 20 AS DOUBLE) END AS size,
  CASE WHEN p_size % 5 <> 0 THEN p_retailprice END AS price, CASE WHEN p_size % 11 <> 0 THEN p_type END AS kind FROM part)"""


@query("b1_drop_column", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def b1(spark, d):
    return shaped(prepare.drop_column(table(spark, d, "nation"), "n_regionkey"))


@query("b2_drop_missing", f"SELECT p_partkey, size FROM {PRICED} WHERE price IS NOT NULL")
def b2(spark, d):
    return prepare.drop_missing(priced(spark, d), "price").select("p_partkey", "size")


@query("b3_zero_as_missing", f"SELECT p_partkey, CASE WHEN size <> 0 THEN size END AS size FROM {PRICED}")
def b3(spark, d):
    return prepare.apply_method(priced(spark, d), "missing_values", "ZERO_AS_MISSING_VALUE", "size").select("p_partkey", "size")


@query("b4_negative_as_missing", f"SELECT p_partkey, CASE WHEN size >= 0 THEN size END AS size FROM {PRICED}")
def b4(spark, d):
    return prepare.apply_method(priced(spark, d), "missing_values", "NEGATIVE_AS_MISSING_VALUE", "size").select("p_partkey", "size")


@query("b5_freeze_schema", f"SELECT price, 0.0::DOUBLE AS absent, p_partkey FROM {PRICED}")
def b5(spark, d):
    return prepare.freeze_schema(priced(spark, d), ["price", "absent", "p_partkey"])


@query("b6_features_by_family", "SELECT p_name, p_brand FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), CAST(p_size AS VARCHAR) FROM part")
def b6(spark, d):
    part = table(spark, d, "part")
    text = prepare.features_by_family(part, "categorical", "p_type")
    number = prepare.features_by_family(part.drop("p_retailprice"), "numeric", "p_type")
    return text.unionByName(number.select(F.col("p_partkey").cast("string").alias("p_name"), F.col("p_size").cast("string").alias("p_brand")))


@query(
    "b7_convert_datetimes",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
    strftime(o_orderdate, '%Y-%m-%d') AS slashed FROM orders""",
)
def b7(spark, d):
    text = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 9 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        F.date_format("o_orderdate", "yyyy/MM/dd").alias("slashed"),
    )
    dated = profile.convert_datetimes(text)
    return dated.select("o_orderkey", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("day", "slashed")])


@query(
    "b8_narrow_types",
    """SELECT o_orderkey, CASE WHEN m <= 32767 THEN 'smallint' WHEN m <= 2147483647 THEN 'int' ELSE 'bigint' END AS key_type,
    CAST(o_totalprice AS FLOAT)::DOUBLE AS price FROM orders, (SELECT max(o_orderkey) AS m FROM orders)""",
)
def b8(spark, d):
    narrow = profile.narrow_types(table(spark, d, "orders").select("o_orderkey", "o_totalprice"))
    kind = narrow.schema["o_orderkey"].dataType.simpleString()
    return narrow.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.lit(kind).alias("key_type"), F.col("o_totalprice").cast("double").alias("price"))


@query("b9_inference_frame", f"SELECT coalesce(size, 0) AS size, coalesce(price, 0) AS price FROM {PRICED}")
def b9(spark, d):
    return prepare.inference_frame(priced(spark, d).select("size", "price"), ["size", "price"])


@query("t2_preview", "SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 20")
def t2(spark, d):
    return files.preview(table(spark, d, "events").select("event_id", "user_id"), 20, ["event_id"])


@query("u1_drop_duplicate_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def u1(spark, d):
    return prepare.drop_duplicate_rows(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


@query("u3_entity_overlap", "SELECT count(DISTINCT user_id) AS overlap FROM events WHERE event_type = 'click' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'error')")
def u3(spark, d):
    events = table(spark, d, "events")
    overlap = entity_overlap(events.where("event_type = 'click'"), events.where("event_type = 'error'"), "user_id")
    return spark.createDataFrame([(overlap,)], "overlap bigint")


@query(
    "u4_key_algebra",
    """WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'),
    b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A')
    SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS "both",
    (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS left_only,
    (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS right_only""",
)
def u4(spark, d):
    lines = table(spark, d, "lineitem")
    return key_algebra(lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'"), ["l_partkey", "l_suppkey"])


@query(
    "u5_mean_jaccard",
    """WITH s AS (SELECT user_id, list(DISTINCT event_type || CASE WHEN value < 8 THEN CAST(CAST(value AS INTEGER) % 4 AS VARCHAR) ELSE 'high' END) AS m FROM events GROUP BY user_id)
    SELECT (SELECT count(*) FROM s) AS runs, round(avg(len(list_intersect(a.m, b.m)) * 1.0 / len(list_distinct(list_concat(a.m, b.m)))), 6) AS mean_jaccard
    FROM s a JOIN s b ON a.user_id < b.user_id""",
)
def u5(spark, d):
    member = F.concat("event_type", F.when(F.col("value") < 8, (F.rint("value").cast("int") % 4).cast("string")).otherwise("high"))
    sets = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(member).alias("m"))
    return shaped(mean_jaccard(sets, "user_id", "m"))


@query(
    "x1_regex_matches",
    r"""WITH g AS (SELECT conv_id * 1000 + turn AS k, regexp_extract_all(text, '(?i)[aeiou]+n[a-z]') AS t, string_split_regex(text, '(?i)[aeiou]+n[a-z]') AS s FROM conversations),
    e AS (SELECT k, unnest(range(1, len(t) + 1)) AS i, t, s FROM g)
    SELECT k, i AS sequence, CAST(1 + list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(t[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS position,
    t[i] AS token, length(t[i]) AS length FROM e""",
)
def x1(spark, d):
    talk = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")
    return shaped(regex_matches(talk, "k", "text", "[aeiou]+n[a-z]"))


@query(
    "f1_string_functions",
    r"""SELECT doc_id, length(text) AS characters, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS words,
    split_part(source, '/', 1) AS head FROM documents""",
)
def f1(spark, d):
    docs = table(spark, d, "documents")
    return shaped(
        docs.select(
            "doc_id", fn.num_characters(F.col("text")).alias("characters"), fn.num_words(F.col("text")).alias("words"),
            fn.nth_part(F.col("source"), "/", 1).alias("head"),
        )
    )


@query("f2_hash_functions", "SELECT doc_id, upper(md5(text)) AS md5 FROM documents")
def f2(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.digest_md5(F.col("text")).alias("md5"))


@query("f2_sha512")
def f2s(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.digest_sha512(F.col("text")).alias("sha512"))


@query(
    "f3_bits_and_json",
    """SELECT event_id, ((user_id >> 2) & 1) = 1 AS third_bit, json_extract_string(props, '$.k') AS k FROM events""",
)
def f3(spark, d):
    return table(spark, d, "events").select(
        "event_id", fn.bit_set(F.col("user_id"), 2).alias("third_bit"), fn.json_value(F.col("props"), "$.k").alias("k")
    )


@query(
    "c3_haversine",
    """SELECT c_custkey, round(2 * 3958.7613 * asin(sqrt(pow(sin((radians(s_lat) - radians(c_lat)) / 2), 2) + cos(radians(c_lat)) * cos(radians(s_lat)) * pow(sin((radians(s_lon) - radians(c_lon)) / 2), 2))), 4) AS miles
    FROM (SELECT c_custkey, c_custkey % 90 AS c_lat, c_custkey % 170 AS c_lon, c_nationkey AS s_lat, c_nationkey * 3 AS s_lon FROM customer)""",
)
def haversine(spark, d):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    places = table(spark, d, "customer").select("c_custkey", fn.haversine(key % 90, key % 170, nation, nation * 3).alias("miles"))
    return shaped(places, 4)


