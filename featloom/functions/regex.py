"""Regex matches as rows, with positions, from built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.core import col

_BLOCK = 128


def _let(value: Column, body) -> Column:
    """Evaluate `value` once per row and use it many times in `body`."""
    return F.get(F.transform(F.array(value), body), 0)


def _accumulated(values: Column, step, kept) -> Column:
    """(total, running) over an array of numbers."""
    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("running"))

    def merge(acc: Column, x: Column) -> Column:
        after = acc["total"] + step(x)
        return F.struct(
            after.alias("total"),
            F.concat(acc["running"], F.array(kept(acc["total"], after))).alias("running"),
        )

    return F.aggregate(values, start, merge)


def _running_total(values: Column) -> Column:
    """Inclusive running totals of a non-empty array, block by block.

    Appending to an array copies it, so only block-sized arrays are appended to.
    """
    last_block = F.floor((F.size(values) - 1) / _BLOCK).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), last_block),
        lambda b: _accumulated(
            F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)), lambda x: x, lambda before, after: after
        ),
    )
    return _let(
        blocks,
        lambda bs: _let(
            _accumulated(bs, lambda x: x["total"], lambda before, after: before)["running"],
            lambda starts: F.flatten(
                F.transform(bs, lambda b, i: F.transform(b["running"], lambda v: v + F.get(starts, i)))
            ),
        ),
    )


def regex_matches(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Case-insensitive matches: (key, sequence, position, token, length), 1-based.

    Splitting by the same pattern gives the gaps between matches, so positions
    follow from running lengths, also where a token occurs earlier unmatched.
    """
    flagged = F.lit("(?i)" + pattern)
    tokens = F.regexp_extract_all(col(text), flagged, F.lit(0))
    gaps = F.split(col(text), "(?i)" + pattern, -1)

    def spots(pair: Column) -> Column:
        found, between = pair["tokens"], pair["gaps"]
        # an empty match at the very start yields no leading gap
        lag = F.when(F.size(between) <= F.size(found), 1).otherwise(0)
        steps = F.transform(
            found,
            lambda _, i: F.coalesce(F.length(F.get(between, i - lag)), F.lit(0))
            + F.coalesce(F.length(F.get(found, i - 1)), F.lit(0)),
        )
        return F.when(
            F.size(found) > 0, F.arrays_zip(found.alias("token"), _let(steps, _running_total).alias("spot"))
        )

    both = F.struct(tokens.alias("tokens"), gaps.alias("gaps"))
    placed = df.select(col(key).alias(key), _let(both, spots).alias("_matches"))
    rows = placed.select(key, F.posexplode("_matches").alias("_i", "_m"))
    return rows.select(
        key,
        (F.col("_i") + 1).alias("sequence"),
        (F.col("_m.spot") + 1).alias("position"),
        F.col("_m.token").alias("token"),
        F.length("_m.token").alias("length"),
    )
