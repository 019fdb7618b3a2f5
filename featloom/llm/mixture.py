"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents are summed to cells of source, language and topic. The token weights of the cells are raked: for each
dimension in turn, the weights of a level are scaled so that their sum meets the level's target share, for a fixed number of
rounds. A cell's rate is its weight over its share of tokens. Each document is then sampled with the probability
min(1, scale * rate), where the scale is calibrated so that the expected number of sampled tokens meets the budget; cells
at probability 1 are counted in full and the others make up for them. Whether a document is taken depends on a hash of
its id only.

A target is a dict of shares by level, or a tempering exponent for the observed token shares. Levels with tokens that a
dict doesn't list share what it leaves, by their tokens; listed levels without tokens are left out; shares are scaled
to one.

Defined cases: a null source or language is the level `unknown`; null, empty and blank texts have no tokens, probability 0
and are not taken; repeated rows are decided alike; further columns are carried or ignored; without tokens nothing is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featloom.core import col, quoted
from featloom.llm.base import picked, query, stored, table

WORD = r"[^\x20\x09-\x0D]+"
# Topic by the first pattern that a text contains; else `prose`.
TOPICS = (("legal", "[Rr]ights reserved|[Ll]icen[sc]e|[Cc]opyright"), ("contact", "@[a-z0-9-]+[.]"), ("shouting", "[A-Z]!!"))
REST_TOPIC = "prose"
DIMENSIONS = ("source", "lang", "topic")
#: The mix of the registered query, of its SQL and of the pipeline. What the listed languages leave goes to all others, null among them.
TARGETS: dict[str, dict[str, float] | float] = {
    "source": 0.5,
    "lang": {"en": 0.475, "de": 0.19, "fr": 0.1425, "es": 0.1425},
    "topic": {"prose": 0.85, "legal": 0.05, "contact": 0.05, "shouting": 0.05},
}
ROUNDS, STEPS, BUDGET = 8, 8, 0.4
#: Cells sent to every task; more are joined by a shuffle.
SENT_CELLS = 50_000
SALT = "mix"


def tokens(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def topic(c: Column) -> Column:
    out = None
    for name, pattern in TOPICS:
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return out.otherwise(REST_TOPIC)


def position(key: Column) -> Column:
    """A document's place in [0, 1), from its id alone."""
    text = F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("null")), F.lit(SALT))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16**13)


def target_shares(cells: DataFrame, dimension: str, target: dict[str, float] | float) -> DataFrame:
    """level and share for the levels that have tokens; the shares sum to one."""
    levels = cells.groupBy(F.col(dimension).alias("level")).agg(F.sum("tokens").cast("double").alias("tokens"))
    if isinstance(target, (int, float)):
        wanted = levels.select("level", F.pow("tokens", F.lit(float(target))).alias("share"))
    else:
        listed = F.create_map(*[F.lit(v) for kv in sorted(target.items()) for v in (kv[0], float(kv[1]))]) if target else F.create_map().cast("map<string,double>")
        given = levels.select("level", "tokens", F.try_element_at(listed, F.col("level")).alias("given"))
        spare = given.where("given IS NULL").agg(F.sum("tokens")).first()[0] or 0.0
        left = max(0.0, 1.0 - sum(target.values()))
        wanted = given.select("level", F.coalesce("given", F.col("tokens") * (left / spare if spare else 0.0)).alias("share"))
    total = wanted.agg(F.sum("share")).first()[0] or 1.0
    return wanted.select("level", (F.col("share") / total).alias("share"))


def raked(cells: DataFrame, targets: dict[str, dict[str, float] | float], rounds: int = ROUNDS) -> DataFrame:
    """The cells with a weight; weights start at the tokens and end with the wanted sums of each dimension."""
    shares = {d: stored(target_shares(cells, d, t), f"share-{d}") for d, t in targets.items()}
    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    if cells.count() <= SENT_CELLS:
        return _raked_in_windows(out, shares, rounds)
    for _ in range(rounds):
        for d, share in shares.items():
            sums = out.groupBy(F.col(d).alias("level")).agg(F.sum("weight").alias("sum")).join(share, "level")
            factor = sums.select(F.col("level").alias(d), F.when(F.col("sum") > 0, F.col("share") / F.col("sum")).otherwise(0.0).alias("factor"))
            out = out.join(factor, d).select(*DIMENSIONS, "tokens", (F.col("weight") * F.col("factor")).alias("weight"))
        out = stored(out, "raked")
    return out


def _raked_in_windows(out: DataFrame, shares: dict[str, DataFrame], rounds: int) -> DataFrame:
    """The same rounds over few cells: each join's table would take a page of the driver's memory, so the shares are joined once."""
    for d, share in shares.items():
        out = out.join(share.select(F.col("level").alias(d), F.col("share").alias(f"_{d}")), d)
    out = stored(out, "shares")
    for _ in range(rounds):
        for d in shares:
            total = F.sum("weight").over(Window.partitionBy(d))
            out = out.withColumn("weight", F.col("weight") * F.when(total > 0, F.col(f"_{d}") / total).otherwise(0.0))
        out = stored(out, "raked")
    return out.select(*DIMENSIONS, "tokens", "weight")


def calibrated(cells: DataFrame, budget: float, steps: int = STEPS) -> DataFrame:
    """The cells with rate and probability; `budget` is the share of all tokens to expect in the sample."""
    total, weight = cells.agg(F.sum("tokens"), F.sum("weight")).first()
    total, weight = float(total or 0), float(weight or 1) or 1.0
    rated = stored(cells.withColumn("rate", F.when(F.col("tokens") > 0, F.col("weight") / weight * total / F.col("tokens")).otherwise(0.0)), "rated")
    scale = budget
    for _ in range(steps):
        # Expected tokens are concave and piecewise linear in the scale, so Newton's steps come from below and end exactly.
        free = F.col("rate") * scale < 1
        met, slope = rated.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("rate") * scale)), F.sum(F.when(free, F.col("tokens") * F.col("rate")))).first()
        if not slope:
            break
        scale += max(0.0, budget * total - met) / slope
    return rated.withColumn("probability", F.least(F.lit(1.0), F.col("rate") * scale))


def weighed(docs: DataFrame, targets: dict[str, dict[str, float] | float] | None = None, budget: float = BUDGET, key: str = "doc_id", text: str = "text",
            source: str = "source", lang: str = "lang", topics: Column | None = None, rounds: int = ROUNDS) -> DataFrame:
    """The columns of `docs` plus __topic, __tokens, __rate, __probability and __taken."""
    found = topic(col(text)) if topics is None else topics
    level = {"source": F.coalesce(col(source).cast("string"), F.lit("unknown")), "lang": F.coalesce(col(lang).cast("string"), F.lit("unknown")), "topic": F.coalesce(found, F.lit(REST_TOPIC))}
    slim = docs.select(*[c.alias(n) for n, c in level.items()], tokens(col(text)).alias("tokens"))
    cells = stored(slim.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "cells")
    rates = stored(calibrated(raked(cells, TARGETS if targets is None else targets, rounds), budget), "rates")
    rates = rates.select(*[F.col(d).alias(f"__{d}") for d in DIMENSIONS], F.col("rate").alias("__rate"), F.col("probability").alias("__probability"))
    if rates.count() <= SENT_CELLS:
        rates = F.broadcast(rates)
    own = docs.select("*", level["source"].alias("__source"), level["lang"].alias("__lang"), level["topic"].alias("__topic"), tokens(col(text)).alias("__tokens"))
    joined = own.join(rates, [f"__{d}" for d in DIMENSIONS], "left")
    some = F.col("__tokens") > 0
    rate, probability = (F.when(some, F.coalesce(c, F.lit(0.0))).otherwise(0.0) for c in (F.col("__rate"), F.col("__probability")))
    return joined.select(*[col(c) for c in docs.columns], "__topic", "__tokens", rate.alias("__rate"), probability.alias("__probability"), (position(col(key)) < probability).alias("__taken"))


def mixed_sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled documents, with the columns of `docs`."""
    return weighed(docs, **options).where("__taken").select(*[quoted(c) for c in docs.columns])


def _sql() -> str:
    """The same steps over common table expressions, one per scaling of a dimension."""
    topics = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPICS)
    ctes = [
        f"""d AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, CASE {topics} ELSE '{REST_TOPIC}' END AS topic,
            coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS tokens FROM documents)""",
        "c AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0)",
    ]
    for d, target in TARGETS.items():
        if isinstance(target, dict):
            given = "CASE " + f"{d} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in target.items()) + " END"
            left = max(0.0, 1.0 - sum(target.values()))
            share = f"SELECT {d}, coalesce(g, tokens * {left} / (SELECT sum(tokens) FROM g_{d} WHERE g IS NULL)) AS s FROM g_{d}"
            ctes.append(f"g_{d} AS (SELECT {d}, sum(tokens) AS tokens, {given} AS g FROM c GROUP BY {d})")
        else:
            share = f"SELECT {d}, pow(sum(tokens), {target}) AS s FROM c GROUP BY {d}"
        ctes.append(f"t_{d} AS MATERIALIZED (SELECT {d}, s / sum(s) OVER () AS share FROM ({share}))")
    last = "w0"
    ctes.append("w0 AS MATERIALIZED (SELECT *, tokens AS weight FROM c)")
    for i in range(ROUNDS):
        for d in TARGETS:
            name = f"w_{i}_{d}"
            ctes.append(f"{name} AS MATERIALIZED (SELECT w.* REPLACE (weight * share / sum(weight) OVER (PARTITION BY w.{d}) AS weight) FROM {last} w JOIN t_{d} USING ({d}))")
            last = name
    ctes.append(f"r AS MATERIALIZED (SELECT *, weight / sum(weight) OVER () * sum(tokens) OVER () / tokens AS rate FROM {last})")
    ctes.append(f"k0 AS (SELECT {BUDGET}::DOUBLE AS k)")
    for i in range(STEPS):
        ctes.append(f"""k{i + 1} AS MATERIALIZED (SELECT k + coalesce(greatest(0, {BUDGET} * sum(tokens) - sum(tokens * least(1, rate * k))) / nullif(sum(CASE WHEN rate * k < 1 THEN tokens * rate END), 0), 0) AS k
            FROM r, k{i} GROUP BY k)""")
    return f"""WITH {", ".join(ctes)},
p AS (SELECT source, lang, topic, rate, least(1, rate * k) AS probability FROM r, k{STEPS})
SELECT doc_id, d.topic, CAST(d.tokens AS BIGINT) AS n_tokens, round(CASE WHEN d.tokens > 0 THEN rate ELSE 0 END, 6) AS rate,
    round(CASE WHEN d.tokens > 0 THEN probability ELSE 0 END, 6) AS probability,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|{SALT}'), 1, 13))::BIGINT / {16**13}::DOUBLE < CASE WHEN d.tokens > 0 THEN probability ELSE 0 END AS taken
FROM d LEFT JOIN p USING (source, lang, topic)"""


@query("op1_mixture", _sql())
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = weighed(picked(table(spark, folder, "documents"), "doc_id", "text", "source", "lang"))
    return found.select("doc_id", F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"), F.round("__rate", 6).alias("rate"),
                        F.round("__probability", 6).alias("probability"), F.col("__taken").alias("taken"))
