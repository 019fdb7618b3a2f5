"""Mean pairwise Jaccard similarity through an inverted index of elements.

Sets without a common element add nothing, so only the others are compared. Equal sets are one row with a weight.
Elements of one set only are left out; each set belongs to a block chosen by its rarest shared element, and a block
meets the sets that share an element with any of its own. Elements of very many sets count as one when meetings are
looked for, so a common element makes each meeting once. Meetings are compared inside tasks, a bounded part of them at
a time; a task emits one weighted sum, never pairs. A block of few elements is a dense 0/1 matrix there, so that all its
intersections come from one matrix product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.core import checkpointed, col, rows_frame

#: Sets of a block; an element of more than `HEAVY` blocks' worth of sets is heavy; sets met in one task.
BLOCK, HEAVY, MET = 8_000, 2, 20_000
#: Elements of a block up to which it always is a matrix, and beyond which it never is; cells of a matrix in work.
FEW, MANY, CELLS = 64, 4_096, 1 << 17


def _coded(sets: pa.ChunkedArray, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and code of every element that is among `known`, in row order, and the sizes of the sets."""
    sets = pa.concat_arrays(sets.chunks)
    sizes = pc.list_value_length(sets).to_numpy(zero_copy_only=False).astype(np.int64)
    code = pc.fill_null(pc.index_in(sets.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row[code >= 0], code[code >= 0], sizes


def _intersections(left: tuple, right: tuple, elements: int):
    """(first, sizes of the intersections of some right sets from `first` on with all left sets), part by part."""
    (row, code, a), (other, met, b) = left, right
    step = max(1, CELLS // len(a))
    # Rows of the product of one right set: all elements, or the left sets that hold one of its own.
    shared = len(row) / (len(a) * max(1, elements)) * (len(met) / len(b))
    dense = elements <= FEW or (elements <= MANY and elements <= FEW * shared)
    bounds = np.searchsorted(other, np.arange(len(b) + 1))
    if dense:
        mine = np.zeros((elements, len(a)), np.float32)
        mine[code, row] = 1
    else:
        by_code = np.argsort(code, kind="stable")
        places, ends = row[by_code], np.searchsorted(code[by_code], np.arange(elements + 1))
    for first in range(0, len(b), step):
        last = min(first + step, len(b))
        if dense:
            own = slice(bounds[first], bounds[last])
            theirs = np.zeros((last - first, elements), np.float32)
            theirs[other[own] - first, met[own]] = 1
            yield first, (theirs @ mine).astype(float)
            continue
        both = np.zeros((last - first, len(a)))
        for j in range(first, last):
            found = [places[ends[c] : ends[c + 1]] for c in met[bounds[j] : bounds[j + 1]]]
            if found:
                both[j - first] = np.bincount(np.concatenate(found), minlength=len(a))
        yield first, both


def _meetings(sets: DataFrame, block: int) -> DataFrame | None:
    """(x, chunk) groups as a cogroup: the sets of block x, and sets of it or of later blocks that share an element."""
    places = sets.select("id", F.explode("s").alias("e")).select("id", F.xxhash64("e").alias("e"))
    counts = places.groupBy("e").agg(F.count("*").alias("df")).where("df > 1")
    element = F.when(F.col("df") > HEAVY * block, F.lit(0).cast("long")).otherwise(F.col("e"))
    shared = checkpointed(places.join(counts, "e").groupBy("id", element.alias("e")).agg(F.min("df").alias("df")))
    rarest = checkpointed(shared.groupBy("id").agg(F.min(F.struct("df", "e")).alias("r")).select("id", F.col("r.e").alias("e")))
    rows = rarest.count()
    if not rows:
        return None
    # An element that is the rarest of many sets fills several blocks.
    parts = rarest.groupBy("e").agg(F.ceil(F.count("*") / F.lit(block)).alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    blocks = checkpointed(rarest.join(parts, "e").select("id", F.pmod(F.xxhash64("e", part), F.lit(-(-rows // block))).cast("int").alias("x")))
    inside = shared.join(blocks, "id").select("x", "e").distinct()
    homes = blocks.select("id", F.col("x").alias("home"))
    met = checkpointed(inside.join(shared.select("e", "id"), "e").join(homes, "id").where("home >= x").select("x", "id", "home").distinct())
    chunks = met.groupBy("x").agg(F.ceil(F.count("*") / F.lit(MET)).cast("int").alias("chunks"))
    left = blocks.join(chunks, "x").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).join(sets, "id")
    right = met.join(chunks, "x").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).join(sets, "id")
    mine = left.select("x", "chunk", "id", "s", "w").groupBy("x", "chunk")
    return mine.cogroup(right.select("x", "chunk", "id", "s", "w", (F.col("home") == F.col("x")).alias("own")).groupBy("x", "chunk"))


def mean_jaccard(
    df: DataFrame, run: str, members: str, empty_union: float = 0.0, single: float | None = 1.0, block: int = BLOCK
) -> DataFrame:
    """Mean pairwise Jaccard similarity of the member arrays of all runs; null is an empty set."""
    found = df.select(col(run).alias("run"), F.sort_array(F.array_distinct(F.coalesce(col(members), F.array()))).alias("s")).groupBy("s").agg(F.count("*").alias("w"))
    sets = checkpointed(found.select(F.sha2(F.to_json("s"), 256).alias("id"), "s", "w"))
    copies = F.sum(F.when(F.size("s") > 0, F.lit(1.0)).otherwise(F.lit(empty_union)) * F.col("w") * (F.col("w") - 1) / 2)
    known = sets.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n"), F.coalesce(copies, F.lit(0.0)).alias("copies")).first()
    n, spark = known["n"], df.sparkSession
    if n < 2:
        return rows_frame(spark, [(n, single)], "runs long, mean_jaccard double")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        total = 0.0
        if len(a) and len(b):
            a = a.sort_by("id")
            known = pc.unique(pa.concat_arrays(a["s"].chunks).flatten())
            left, right = _coded(a["s"], known), _coded(b["s"], known)
            ids, others = (x["id"].to_numpy().astype(str) for x in (a, b))
            # Within a block every pair comes up twice and every set with itself: a set meets those before it.
            upto = np.where(b["own"].to_numpy(), np.searchsorted(ids, others), len(ids))
            sizes, others_sizes = left[2].astype(float), right[2].astype(float)
            weights, weight = a["w"].to_numpy().astype(float), b["w"].to_numpy().astype(float)
            for first, both in _intersections(left, right, len(known)):
                part = slice(first, first + len(both))
                union = sizes[None, :] + others_sizes[part][:, None]
                union -= both
                score = np.divide(both, union, out=both)
                if (upto[part] < len(ids)).any():
                    score[np.arange(len(ids))[None, :] >= upto[part][:, None]] = 0
                total += float(weight[part] @ (score @ weights))
        return pa.table({"total": pa.array([total], pa.float64())})

    meetings = _meetings(sets, block)
    total = 0.0 if meetings is None else meetings.applyInArrow(compare, "total double").agg(F.coalesce(F.sum("total"), F.lit(0.0))).first()[0]
    return rows_frame(spark, [(n, (total + known["copies"]) / (n * (n - 1) / 2))], "runs long, mean_jaccard double")
