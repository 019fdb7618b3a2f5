"""URL filter by the ratio of two character language models, in DataFrame functions only.

Rules decide first: a rule names a host, with all its subdomains, and the start of a path; the longest one that fits wins.
Every other URL is judged by two variable-order Markov models of characters, one of accepted and one of rejected URLs, both
counted over all URLs that a rule decides, but for a fold kept back. A character's probability is smoothed after Witten and
Bell: what a context of `order - 1` characters has seen, mixed with what the context without its first character has seen, and
so on down to equal shares of all symbols that occur; a context that was never seen falls to the shorter one. The score of a
URL is the mean log ratio of its characters, so it doesn't depend on length. The threshold is the one with the best balanced
accuracy on the fold kept back.

Counts are partial sums per run of `order` characters, so the model grows with the different runs of the corpus. Chances are
built from short to long runs by joins whose keys have at most as many rows as there are symbols. A run that makes up at least
one `common`th of all occurrences is looked up in a broadcast table, which so has at most `common` rows; all other runs, none
of which is frequent, meet their ratios in a shuffle. Ratios are whole billionths: a sum doesn't depend on the order.

Defined cases: a null URL, or one without `://`, has an empty host and path and is judged like any other URL without a rule;
an empty URL scores 0; without rule-decided URLs of both kinds every ratio is 0 and the threshold is 0, which allows;
repeated rows are judged alike; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.core import col
from featloom.llm.base import ascii_lower, in_fold, picked, query, stored, table

# The rules (host, path start, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

#: Stands before the start of a URL, once for every character of the longest context.
START = "\u0002"
#: Characters of a run: the longest context and the character after it.
ORDER = 6
#: A run with at least this fraction (one over it) of all occurrences is common.
COMMON = 100_000
#: Ratios are whole numbers of this unit.
UNIT = 1e-9
#: Width of the score bins among which the threshold is chosen.
BIN = 0.01

HOST, PATH = r"://([^/?#]*)", r"://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule; null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def runs(text: Column, order: int = ORDER) -> Column:
    """Every character with the `order - 1` before it; the start counts as that many symbols of its own."""
    padded = F.concat(F.lit(START * (order - 1)), text)
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(padded, i, F.lit(order)))


def log_ratios(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """run and its log ratio, accepted over rejected, in units; counted: run and its occurrences among `allow` and `block`."""
    ends = F.transform(F.sequence(F.lit(1), F.lit(order)), lambda k: F.substring(F.col("run"), order + 1 - k, k))
    grams = counted.select(F.explode(ends).alias("gram"), "allow", "block")
    grams = stored(grams.groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")), "grams")
    size, context = F.length("gram"), F.expr("substring(gram, 1, length(gram) - 1)")
    single = grams.where(size == 1).agg(F.count("*").alias("kinds"), F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    if not (single["allow"] and single["block"]):
        return counted.select("run", F.lit(0).cast("long").alias("units"))
    sums = [e for v in ("allow", "block") for e in (F.sum(v).alias(f"{v}_all"), F.sum((F.col(v) > 0).cast("int")).alias(f"{v}_kinds"))]
    contexts = grams.groupBy(context.alias("context")).agg(*sums)
    # A context has as many rows as symbols follow it.
    seen = stored(grams.withColumn("context", context).join(contexts, "context").withColumn("size", size).drop("context"), "seen")
    equal = F.lit(1.0 / (single["kinds"] + 1))
    chances = None
    for k in range(1, order + 1):
        level = seen.where(F.col("size") == k)
        if chances is None:
            level = level.withColumn("allow_low", equal).withColumn("block_low", equal)
        else:
            # A run without its first symbol has as many rows as symbols precede it.
            level = level.withColumn("rest", F.substring("gram", 2, k)).join(chances, "rest")
        chance = lambda v: F.when(
            F.col(f"{v}_all") > 0, (F.col(v) + F.col(f"{v}_kinds") * F.col(f"{v}_low")) / (F.col(f"{v}_all") + F.col(f"{v}_kinds"))
        ).otherwise(F.col(f"{v}_low"))
        chances = level.select(F.col("gram").alias("rest"), chance("allow").alias("allow_low"), chance("block").alias("block_low"))
    units = F.round((F.log("allow_low") - F.log("block_low")) / UNIT).cast("long")
    return chances.select(F.col("rest").alias("run"), units.alias("units"))


def mean_ratios(texts: DataFrame, ratios: DataFrame, total: int, order: int = ORDER, common: int = COMMON) -> DataFrame:
    """id and log_ratio of every text; texts: id, text; ratios: run, units, n; total: the sum of all n."""
    often = F.col("n") * common >= total
    cut = texts.select("id", F.explode(runs(F.col("text"), order)).alias("run"))
    # At most `common` runs can have that share of all occurrences.
    table = F.broadcast(ratios.where(often).select("run", "units"))
    near = cut.join(table, "run").select("id", "units")
    far = cut.join(table, "run", "left_anti").join(ratios.where(~often).select("run", "units"), "run").select("id", "units")
    return near.union(far).groupBy("id").agg(F.round(F.sum("units") * UNIT / F.count("*"), 9).alias("log_ratio"))


def judged(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, key: str = "page_id", url: str = "url", order: int = ORDER, common: int = COMMON
) -> DataFrame:
    """key, url, host, path, rule, log_ratio and verdict of every row."""
    rows = pages.select(col(key).alias("key"), col(url).alias("url"))
    host, path, text = host_of(F.col("url")), path_of(F.col("url")), ascii_lower(F.coalesce("url", F.lit("")))
    rows = rows.select("key", "url", host.alias("host"), path.alias("path"), text.alias("text"), in_fold(F.col("key")).alias("back"))
    rows = stored(rows.withColumn("by", ruled(F.col("host"), F.col("path"), rules)).withColumn("id", F.monotonically_increasing_id()), "rows")
    some = rows.where(F.length("text") > 0)
    # Training counts leave out the fold kept back.
    cut = some.select(F.when(~F.col("back"), F.col("by.verdict")).alias("verdict"), F.explode(runs(F.col("text"), order)).alias("run"))
    of = lambda v: F.sum((F.col("verdict") == v).cast("long"))
    counted = cut.groupBy("run").agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(of(v), F.lit(0)).alias(v) for v in ("allow", "block")])
    counted = stored(counted, "counted")
    ratios = stored(log_ratios(counted, order).join(counted.select("run", "n"), "run"), "ratios")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    scores = rows.join(mean_ratios(some.select("id", "text"), ratios, total, order, common), "id", "left").na.fill(0.0, ["log_ratio"])
    scores = stored(scores.drop("text"), "scores")
    limit = _threshold(scores.where("back AND by IS NOT NULL").select("log_ratio", F.col("by.verdict").alias("verdict")))
    own = F.when(F.col("log_ratio") >= limit, "allow").otherwise("block")
    return scores.select(F.col("key").alias(key), F.col("url").alias(url), "host", "path", F.col("by.rule").alias("rule"), "log_ratio", F.coalesce(F.col("by.verdict"), own).alias("verdict"))


def _threshold(labelled: DataFrame) -> float:
    """Lower edge of the bin from which on allowing gives the best balanced accuracy; the lowest of equal ones."""
    bins = labelled.groupBy(F.floor(F.col("log_ratio") / BIN).alias("bin")).agg(*[F.sum((F.col("verdict") == v).cast("int")).alias(v) for v in ("allow", "block")])
    # A log ratio lies within the logarithm of the largest count, so the bins are few thousands.
    rows = sorted((r["bin"], r["allow"], r["block"]) for r in bins.toLocalIterator())
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return 0.0
    best, limit, kept, dropped = -1, 0.0, good, 0
    for at, allow, block in rows:
        # Balanced accuracy times 2 * good * bad, in whole numbers.
        value = kept * bad + dropped * good
        if value > best:
            best, limit = value, at * BIN
        kept, dropped = kept - allow, dropped + block
    return limit


@query("op7_url_filter")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = judged(picked(table(spark, folder, "pages"), "page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict", F.round("log_ratio", 6).alias("log_ratio"))
