"""Order statistics, ranks and running totals without a one-task window.

A plain `Window.orderBy` puts the whole table in one task and the exact
`percentile` aggregate keeps every distinct value in one buffer. The helpers
here use those only below a checked size and otherwise narrow the range by
bounded aggregates or split the order over range partitions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featloom.core import checkpointed, clean, col, rows_frame, small_rows

SMALL_ROWS = 2_000_000
_SKETCH = 10_000
_HASH_BITS = 60
_BUCKET_BITS = 16
_LITERAL_STRATA = 32


# ---------------------------------------------------------------- quantiles
def order_statistics(
    df: DataFrame,
    columns: dict[str, Column],
    ranks: dict[str, Sequence[int]],
    limit: int = SMALL_ROWS,
) -> dict[tuple[str, int], float]:
    """Exact values at 0-based ranks of the non-null values of each column.

    Every pass is one aggregate of bounded size: a mergeable sketch brackets
    each rank, counts verify the bracket, and only the rows left inside a
    bracket of at most `limit` rows are sorted.
    """
    frame = df.select([clean(c).alias(name) for name, c in columns.items()])
    tasks = [(name, rank) for name in columns for rank in sorted(set(ranks.get(name, ())))]
    if not tasks:
        return {}
    totals = frame.agg(*[F.count(col(n)).alias(n) for n in columns]).first()
    state = {
        t: {"low": None, "high": None, "below": 0, "inside": totals[t[0]]} for t in tasks
    }

    def inside(t) -> Column:
        c, s = col(t[0]), state[t]
        cond = c.isNotNull()
        if s["low"] is not None:
            cond = cond & (c >= F.lit(s["low"]))
        if s["high"] is not None:
            cond = cond & (c <= F.lit(s["high"]))
        return cond

    def fixed(t) -> bool:
        s = state[t]
        return s["low"] is not None and s["low"] == s["high"]

    while True:
        wide = [t for t in tasks if state[t]["inside"] > limit and not fixed(t)]
        if not wide:
            break
        # ranks with the same bracket share one sketch, and ranks with the same new bracket its counts
        alike: dict[tuple, list[tuple[str, int]]] = {}
        for t in wide:
            alike.setdefault((t[0], state[t]["low"], state[t]["high"]), []).append(t)
        sketches = []
        for i, ts in enumerate(alike.values()):
            probs = []
            for t in ts:
                p = (t[1] - state[t]["below"] + 0.5) / state[t]["inside"]
                probs += [max(p - 2 / _SKETCH, 0.0), min(p + 2 / _SKETCH, 1.0)]
            sketches.append(F.percentile_approx(F.when(inside(ts[0]), col(ts[0][0])), probs, _SKETCH).alias(f"s{i}"))
        brackets = frame.agg(*sketches).first()
        ends = {t: tuple(brackets[i][2 * j : 2 * j + 2]) for i, ts in enumerate(alike.values()) for j, t in enumerate(ts)}
        spans = {(t[0], *e): i for i, (t, e) in enumerate(ends.items())}
        counts = []
        for (name, low, high), i in spans.items():
            c = col(name)
            counts += [
                F.count_if(c < F.lit(low)).alias(f"b{i}"),
                F.count_if((c >= F.lit(low)) & (c <= F.lit(high))).alias(f"w{i}"),
            ]
        found = frame.agg(*counts).first()
        progress = False
        for t in wide:
            low, high = ends[t]
            i = spans[(t[0], low, high)]
            below, within = found[f"b{i}"], found[f"w{i}"]
            s = state[t]
            if below <= t[1] < below + within and (within < s["inside"] or low == high):
                s.update(low=low, high=high, below=below, inside=within)
                progress = True
        if not progress:
            break

    answers = {t: state[t]["low"] for t in tasks if fixed(t)}
    rest = [t for t in tasks if t not in answers and 0 <= t[1] < totals[t[0]]]
    if rest:
        # ranks with the same bracket share one copy of its rows
        shared: dict[tuple, list[tuple[str, int]]] = {}
        for t in rest:
            shared.setdefault((t[0], state[t]["low"], state[t]["high"]), []).append(t)
        groups = list(shared.values())
        wanted = F.create_map(
            *[
                x
                for i, ts in enumerate(groups)
                for x in (F.lit(i), F.array(*[F.lit(t[1] - state[t]["below"]).cast("long") for t in ts]))
            ]
        )
        candidates = F.filter(
            F.array(
                *[
                    F.struct(F.lit(i).alias("task"), F.when(inside(ts[0]), col(ts[0][0])).alias("value"))
                    for i, ts in enumerate(groups)
                ]
            ),
            lambda x: x["value"].isNotNull(),
        )
        weights = (
            frame.select(F.explode(candidates).alias("x"))
            .groupBy(F.col("x.task").alias("task"), F.col("x.value").alias("value"))
            .count()
        )
        w = Window.partitionBy("task").orderBy("value")
        running = weights.withColumn("upto", F.sum("count").over(w))
        start = F.col("upto") - F.col("count")
        hit = F.filter(wanted[F.col("task")], lambda k: (k >= start) & (k < F.col("upto")))
        for r in running.select("task", "value", F.explode(hit).alias("rank")).collect():
            for t in groups[r["task"]]:
                if t[1] - state[t]["below"] == r["rank"]:
                    answers[t] = r["value"]
    return answers


def quantiles(
    df: DataFrame,
    columns: dict[str, Column],
    probabilities: Sequence[float],
    rows: int | None = None,
    limit: int = SMALL_ROWS,
) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles of the non-null values."""
    if not columns:
        return {}
    rows = df.count() if rows is None else rows
    probs = [float(p) for p in probabilities]
    if rows <= limit:
        aggs = [F.percentile(clean(c), F.array(*[F.lit(p) for p in probs])).alias(name) for name, c in columns.items()]
        got = df.agg(*aggs).first()
        return {n: list(got[n]) if got[n] is not None else [None] * len(probs) for n in columns}
    counts = df.agg(*[F.count(clean(c)).alias(n) for n, c in columns.items()]).first()
    spots = {
        n: [((counts[n] - 1) * p) for p in probs] if counts[n] else [] for n in columns
    }
    ranks = {n: {r for s in spots[n] for r in (math.floor(s), math.ceil(s))} for n in columns}
    stats = order_statistics(df, columns, ranks, limit)
    out = {}
    for n in columns:
        if not counts[n]:
            out[n] = [None] * len(probs)
            continue
        values = []
        for s in spots[n]:
            lo, hi = stats[(n, math.floor(s))], stats[(n, math.ceil(s))]
            values.append(lo + (hi - lo) * (s - math.floor(s)))
        out[n] = values
    return out


# ------------------------------------------------------------ ordered scans
def range_tagged(
    df: DataFrame, order: Sequence[Column], rows: int | None = None, limit: int = SMALL_ROWS
) -> tuple[DataFrame, int]:
    """Number contiguous ranges of the order in `_part`; one range when small.

    Range partitioning samples its input, so the tags are fixed by a
    checkpoint before anything is computed from them.
    """
    rows = df.count() if rows is None else rows
    parts = max(1, math.ceil(rows / limit))
    if parts == 1:
        return df.withColumn("_part", F.lit(0)), 1
    spread = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    return checkpointed(spread), parts


def running_sums(
    df: DataFrame,
    order: Sequence[Column],
    sums: dict[str, Column],
    rows: int | None = None,
    limit: int = SMALL_ROWS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Add inclusive running totals of `sums` over a global order, or over an order in each group of `by`.

    Ranges follow the groups first, so a hot group is spread over several of them.
    """
    groups = [col(b) for b in by]
    tagged, parts = range_tagged(df, [*groups, *order], rows, limit)
    if parts == 1:
        w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(w).alias(n) for n, c in sums.items()])
    w = Window.partitionBy("_part", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    names = [f"_of{i}" for i in range(len(groups))]
    keys = [c.alias(n) for c, n in zip(groups, names, strict=True)]
    totals = tagged.groupBy(F.col("_part").alias("_at"), *keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.partitionBy(*names).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_at", *names, F.count("*").over(before).alias("_earlier"), *[F.sum(n).over(before).alias(f"_before_{n}") for n in sums])
    local = tagged.select("*", *[F.sum(c).over(w).alias(n) for n, c in sums.items()])
    # only a group that started in an earlier range has an offset: one at most for each range
    offsets = F.broadcast(offsets.where("_earlier > 0").drop("_earlier"))
    joined = local.join(offsets, _all([F.col("_part") == F.col("_at"), *[c.eqNullSafe(F.col(n)) for c, n in zip(groups, names, strict=True)]]), "left")
    return joined.select(
        *[col(c) for c in df.columns],
        *[(F.col(n) + F.coalesce(F.col(f"_before_{n}"), F.lit(0))).alias(n) for n in sums],
    )


def global_row_number(
    df: DataFrame, order: Sequence[Column], name: str, rows: int | None = None, limit: int = SMALL_ROWS
) -> DataFrame:
    """1-based position of every row in a total order."""
    return running_sums(df, order, {name: F.lit(1).cast("long")}, rows, limit)


# -------------------------------------------------------------- hash order
def hash_order(key: str | Sequence[str], seed: int | str) -> Column:
    """Reproducible shuffle position of a row: 60 bits of md5(key|seed)."""
    return F.conv(_hash_text(key, seed), 16, 10).cast("long")


def _hash_text(key: str | Sequence[str], seed: int | str) -> Column:
    """The hash position as 15 hex digits, which sort like the number."""
    keys = [key] if isinstance(key, str) else list(key)
    text = F.concat_ws("|", *[col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.substring(F.md5(text), 1, _HASH_BITS // 4)


def hash_cuts(
    df: DataFrame, key: str, seed: int | str, quotas, strata: Sequence[str] = ()
) -> list[dict] | None:
    """Hash position of the last row inside each quota, per stratum; None if there are too many strata for the driver.

    `quotas(n)` lists ascending row counts for a stratum of n rows. A first
    count by hash prefix finds the prefix each quota ends in, a second pass
    ranks only the rows of those prefixes. Filtering by the returned cuts then
    needs no shuffle of the table at all.
    """
    strata = list(strata)
    base = df.select(
        *[col(s).alias(f"_s{i}") for i, s in enumerate(strata)],
        col(key).alias("_key"),
        hash_order(key, seed).alias("_h"),
    )
    names = [f"_s{i}" for i in range(len(strata))]
    bucket = F.shiftright("_h", _HASH_BITS - _BUCKET_BITS)
    # at most 2^16 rows per stratum, read twice below
    counts = base.groupBy(*names, bucket.alias("_b")).count().persist()
    w = Window.partitionBy(*names).orderBy("_b")
    running = counts.withColumn("_upto", F.sum("count").over(w))
    sizes = small_rows(running.groupBy(*names).agg(F.max("_upto").alias("_n")))
    if sizes is None:
        counts.unpersist()
        return None
    cuts = {tuple(r[n] for n in names): {"n": r["_n"], "cuts": {}} for r in sizes}
    asked = {
        stratum: [(j, int(quota)) for j, quota in enumerate(quotas(v["n"])) if quota > 0] for stratum, v in cuts.items()
    }
    if any(asked.values()):
        # both broadcast sides hold at most one row per stratum and quota
        spark = df.sparkSession
        kinds = [f"{n}x {base.schema[n].dataType.simpleString()}" for n in names]
        same = [F.col(n).eqNullSafe(F.col(f"{n}x")) for n in names]
        start = F.col("_upto") - F.col("count")
        if names:
            rows = [(*stratum, wanted) for stratum, wanted in asked.items()]
            side = rows_frame(spark, rows, ", ".join([*kinds, "_asks array<struct<j: int, q: long>>"]))
            joined = running.join(F.broadcast(side), _all(same))
        else:
            pairs = [F.struct(F.lit(j).alias("j"), F.lit(q).cast("long").alias("q")) for j, q in asked[()]]
            joined = running.withColumn("_asks", F.array(*pairs))
        reached = F.filter("_asks", lambda x: (start < x["q"]) & (x["q"] <= F.col("_upto")))
        ends = (
            joined.select(*[F.col(n).alias(f"{n}x") for n in names], F.col("_b").alias("_bx"), start.alias("_start"), F.explode(reached).alias("_a"))
            .select(*[f"{n}x" for n in names], "_bx", F.col("_a.j").alias("_j"), (F.col("_a.q") - F.col("_start")).alias("_need"))
            .collect()
        )
        ends_df = rows_frame(spark, ends, ", ".join([*kinds, "_bx long", "_j int", "_need long"]))
        inside = base.join(F.broadcast(ends_df), _all([*same, bucket == F.col("_bx")]))
        spot = Window.partitionBy(*names, "_bx", "_j").orderBy("_h", "_key")
        hits = inside.withColumn("_rn", F.row_number().over(spot)).where(F.col("_rn") == F.col("_need"))
        for r in hits.collect():
            cuts[tuple(r[n] for n in names)]["cuts"][r["_j"]] = (r["_h"], r["_key"])
    counts.unpersist()
    return [{"stratum": k, **v} for k, v in cuts.items()]


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def cut_number(df: DataFrame, key: str, seed: int | str, parts: Sequence[dict], strata: Sequence[str], name: str) -> DataFrame:
    """Add the number of the first cut a row lies within (the last number beyond all).

    A few strata become literals; many become a join with one row per stratum,
    whose count `hash_cuts` has bounded.
    """
    strata = list(strata)
    cut_count = max((j + 1 for p in parts for j in p["cuts"]), default=0)
    if len(parts) <= _LITERAL_STRATA:
        out = F.lit(cut_count)
        for part in parts:
            number = F.lit(cut_count)
            for j in sorted(part["cuts"], reverse=True):
                number = F.when(within_cut(key, seed, part["cuts"][j]), F.lit(j)).otherwise(number)
            here = _all([F.lit(True), *[col(s).eqNullSafe(F.lit(v)) for s, v in zip(strata, part["stratum"], strict=True)]])
            out = F.when(here, number).otherwise(out)
        return df.withColumn(name, out)
    kinds = [f"_x{i} {df.schema[s].dataType.simpleString()}" for i, s in enumerate(strata)]
    key_kind = df.schema[key].dataType.simpleString()
    rows = [(*p["stratum"], [(j, *p["cuts"][j]) for j in sorted(p["cuts"])]) for p in parts]
    side = rows_frame(df.sparkSession, rows, ", ".join([*kinds, f"_cuts array<struct<j: int, h: long, k: {key_kind}>>"]))
    match = _all([col(s).eqNullSafe(F.col(f"_x{i}")) for i, s in enumerate(strata)])
    h = hash_order(key, seed)
    first = F.get(F.filter("_cuts", lambda c: (h < c["h"]) | ((h == c["h"]) & (col(key) <= c["k"]))), 0)["j"]
    joined = df.join(F.broadcast(side), match, "left")
    return joined.select(*[col(c) for c in df.columns], F.coalesce(first, F.lit(cut_count)).alias(name))


def within_cut(key: str, seed: int | str, cut: tuple | None) -> Column:
    """True for rows at or before a cut of `hash_cuts`."""
    if cut is None:
        return F.lit(False)
    h, at = _hash_text(key, seed), F.lit(f"{cut[0]:0{_HASH_BITS // 4}x}")
    return (h < at) | ((h == at) & (col(key) <= F.lit(cut[1])))
