"""Approximate nearest neighbours by a hierarchical k-means tree and best-bin-first traversal.

The tree is fitted on a bounded sample; every vector is then put into the leaf that a greedy descent reaches. A query
walks the tree through a priority queue ordered by the distance to the node centres and visits leaves in that order. How
many leaves it visits is calibrated: for a bounded set of rows the exact neighbours are found by brute force over all
vectors, in blocks, and visits are widened until the wanted share of them lies in a visited leaf. Visits also go on
until the leaves hold more than k vectors. The first of a query's leaves bound the distance of its k nearest; from the other
leaves only vectors within this bound come back.

Equal vectors are one entry with its k + 1 smallest ids, cut before the shuffle, so copies cost nothing. Large leaves
are searched in parts, and so are leaves that many queries visit. Distances are Euclidean, in double precision, computed
on the original components for whatever is returned.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, neither do those of
another length than the most frequent one (the longest of these on a tie); fewer than k candidates are all returned; ties
go to the smaller id; repeated rows of one id count once; without queries or candidates the result is empty.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featloom.core import col
from featloom.llm.base import query, stored, table

#: Vectors the tree is fitted on, leaves at most, rows a leaf should hold, rows used to calibrate.
SAMPLE, LEAVES, LEAF_ROWS, CALIBRATION = 40_000, 4_096, 256, 96
BRANCHES = 8
#: Wanted share of the exact neighbours; one in HEAD of a query's leaves is searched first, for a bound.
RECALL, HEAD = 0.98, 8
#: Rows, and queries, that meet in one task.
PART_ROWS, PART_QUERIES = 4_096, 2_048


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def centres(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means from distance-weighted seeds."""
    found = [x[rng.integers(len(x))]]
    near = squared(x, np.array(found))[:, 0]
    while len(found) < k and near.max() > 0:
        found.append(x[rng.choice(len(x), p=near / near.sum())])
        near = np.minimum(near, squared(x, found[-1][None])[:, 0])
    c = np.array(found)
    for _ in range(rounds):
        own = squared(x, c).argmin(1)
        c = np.array([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
    return c


class Tree:
    """Centres by node; children of inner nodes; the number of the leaf of the others."""

    def __init__(self, sample: np.ndarray, leaf_rows: int, seed: int = 9):
        self.centre: list[np.ndarray] = [sample.mean(0)]
        self.children: list[np.ndarray | None] = [None]
        rng = np.random.default_rng(seed)
        todo = [(0, np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf_rows:
                continue
            c = centres(sample[rows], min(BRANCHES, -(-len(rows) // leaf_rows)), rng)
            own = squared(sample[rows], c).argmin(1)
            used = np.unique(own)
            if len(used) < 2:
                continue
            ids = np.arange(len(self.centre), len(self.centre) + len(used))
            self.children[node] = ids
            self.centre.extend(c[used])
            self.children.extend([None] * len(used))
            todo += [(int(i), rows[own == u]) for i, u in zip(ids, used, strict=True)]
        self.points = np.array(self.centre)
        leaves = [i for i, c in enumerate(self.children) if c is None]
        self.leaf = {node: k for k, node in enumerate(leaves)}
        self.rows = np.zeros(len(leaves), np.int64)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every vector by greedy descent."""
        out = np.empty(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            ids = self.children[node]
            if ids is None:
                out[rows] = self.leaf[node]
                continue
            own = squared(x[rows], self.points[ids]).argmin(1)
            todo += [(int(i), rows[own == u]) for u, i in enumerate(ids) if (own == u).any()]
        return out

    def visits(self, q: np.ndarray, leaves: int, rows: int) -> list[int]:
        """Leaves in best-bin-first order, until there are `leaves` of them that hold `rows` vectors."""
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < leaves or held < rows):
            _, node = heapq.heappop(queue)
            ids = self.children[node]
            if ids is None:
                out.append(self.leaf[node])
                held += int(self.rows[self.leaf[node]])
                continue
            gap = ((self.points[ids] - q) ** 2).sum(1)
            for d, i in zip(gap.tolist(), ids.tolist(), strict=True):
                heapq.heappush(queue, (d, i))
        return out


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact distances of the k nearest rows to one query, nearest first, ties by id."""
    rough = squared(q[None], x)[0]
    if len(rough) > k:
        limit = np.partition(rough, k - 1)[k - 1]
        keep = rough <= limit + 1e-9 * (1 + limit + (q * q).sum())
        x, ids = x[keep], ids[keep]
    exact = np.sqrt(((x - q) ** 2).sum(1))
    order = np.lexsort((ids, exact))[:k]
    return ids[order], exact[order]


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _smallest(df: DataFrame, by: str, k: int, *order: str) -> DataFrame:
    """The first k rows of each group; Spark cuts each group to k rows per task before the shuffle."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("rank", place).where(F.col("rank") <= k)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id and vec (doubles) of the vectors that take part."""
    fine = F.forall(col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(col(vector), lambda x: x != 0)
    rows = vectors.where(col(key).isNotNull() & F.coalesce(fine, F.lit(False))).select(col(key).cast("long").alias("vec_id"), col(vector).cast("array<double>").alias("vec"))
    size = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("vec") == (size["size"] if size else 0))


def nearest_neighbours(vectors: DataFrame, asked: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, recall: float = RECALL,
                       sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, leaves: int = LEAVES, calibration: int = CALIBRATION) -> DataFrame:
    """query_id, rank, vec_id and score for the rows that `asked` selects (over a column vec_id), against all others."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    distinct = _smallest(rows.distinct(), "vec", k + 1, "vec_id").drop("rank")
    distinct = stored(distinct, "distinct")
    total = distinct.count()
    empty = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], empty)
    order = F.xxhash64("vec_id", F.lit(31))
    drawn = distinct.where(F.pmod(order, F.lit(1_000_000)) < min(1_000_000, 1 + 1_200_000 * sample // total)).limit(sample)
    x = matrix(drawn.select("vec").toArrow().column(0).combine_chunks())
    if not len(x):
        x = matrix(distinct.limit(sample).select("vec").toArrow().column(0).combine_chunks())
    tree = Tree(np.unique(x, axis=0), max(4, -(-leaf_rows * len(x) // total), -(-len(x) // leaves)))
    sent = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = sent.value.assign(matrix(batch.column(1))) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int32())], ["vec_id", "vec", "leaf"])

    index = stored(distinct.mapInArrow(place, "vec_id long, vec array<double>, leaf int"), "index")
    # At most `leaves` rows.
    for r in index.groupBy("leaf").count().toLocalIterator():
        tree.rows[r["leaf"]] = r["count"]
    wanted = _calibrated(index, tree, k, recall, calibration)
    sized = spark.sparkContext.broadcast(tree)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sized.value
        for batch in batches:
            where = [tree.visits(q, wanted, 3 * (k + 1)) for q in matrix(batch.column(1))]
            heads = [max(-(-len(w) // HEAD), 1 + int(np.searchsorted(np.cumsum(tree.rows[w]), 3 * (k + 1)))) for w in where]
            at = pa.array(np.repeat(np.arange(batch.num_rows), [len(w) for w in where]), pa.int64())
            leaf = np.array([v for w in where for v in w], np.int32)
            early = np.array([i < h for w, h in zip(where, heads, strict=True) for i in range(len(w))], bool)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(leaf), pa.array(early)], ["qkey", "vec", "leaf", "early"])

    asking = rows.where(asked).distinct()
    # One query per distinct vector; its key is the smallest id.
    keys = stored(asking.groupBy("vec").agg(F.min("vec_id").alias("qkey")), "keys")
    visits = stored(keys.select("qkey", "vec").mapInArrow(walk, "qkey long, vec array<double>, leaf int, early boolean"), "visits")
    # The nearest leaves give every query a bound; the others return only what is within it.
    near = _searched(index, visits.where("early").select("qkey", "vec", "leaf", F.lit(float("inf")).alias("bound")), k)
    near = stored(_smallest(near, "qkey", k + 1, "score", "vec_id").drop("rank"), "near")
    bounds = near.groupBy("qkey").agg(F.when(F.count(F.lit(1)) > k, F.max("score")).otherwise(float("inf")).alias("bound"))
    rest = visits.where("NOT early").join(bounds, "qkey", "left").select("qkey", "vec", "leaf", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    pairs = near.union(_searched(index, rest, k))
    best = _smallest(pairs, "qkey", k + 1, "score", "vec_id").groupBy("qkey").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    named = stored(best.join(keys, "qkey").select("vec", "found"), "best")
    own = asking.select(F.col("vec_id").alias("query_id"), "vec").join(named, "vec")
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    out = own.select("query_id", F.posexplode(others).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def _searched(index: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """Up to k + 1 rows (qkey, vec_id, score) for every visit (qkey, vec, leaf, bound), none beyond the bound."""
    visits = stored(visits, "asked")
    # At most as many rows as the tree has leaves.
    parts = index.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("row_parts")).join(
        visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / PART_QUERIES).cast("int").alias("query_parts")), "leaf")
    parts = F.broadcast(stored(parts, "parts"))
    left = index.join(parts, "leaf").select("leaf", F.pmod(F.xxhash64("vec_id"), F.col("row_parts")).alias("row_part"), F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)).alias("query_part"), "vec_id", "vec")
    right = visits.join(parts, "leaf").select(
        "leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("row_parts").cast("long") - 1)).alias("row_part"), F.pmod(F.xxhash64("qkey"), F.col("query_parts")).cast("int").alias("query_part"), "qkey", "vec", "bound")

    def search(have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        keys, near, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if len(have) and len(want):
            x, ids = np.stack(have["vec"].to_numpy()), have["vec_id"].to_numpy()
            for key, q, bound in zip(want["qkey"], want["vec"], want["bound"], strict=True):
                found, score = nearest(np.asarray(q), x, ids, k + 1)
                within = score <= bound
                keys.append(np.full(within.sum(), key))
                near.append(found[within])
                scores.append(score[within])
        return pd.DataFrame({"qkey": np.concatenate(keys), "vec_id": np.concatenate(near), "score": np.concatenate(scores)})

    by = ["leaf", "row_part", "query_part"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(search, "qkey long, vec_id long, score double")


def _calibrated(index: DataFrame, tree: Tree, k: int, recall: float, calibration: int) -> int:
    """Leaves to visit so that the exact neighbours of the calibration rows are met at the wanted rate."""
    drawn = index.orderBy(F.xxhash64("vec_id", F.lit(77)), "vec_id").limit(calibration).select("vec_id", "vec").toArrow()
    own, q = drawn.column(0).to_numpy(), matrix(drawn.column(1).combine_chunks())
    sent = index.sparkSession.sparkContext.broadcast((own, q))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, points = sent.value
        for batch in batches:
            x, ids, leaf = matrix(batch.column(1)), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            if not len(ids):
                continue
            found = [nearest(p, x, ids, k + 1) for p in points]
            of = dict(zip(ids.tolist(), leaf.tolist(), strict=True))
            flat = np.concatenate([f[0] for f in found])
            arrays = [np.repeat(keys, [len(f[0]) for f in found]), flat, np.concatenate([f[1] for f in found]), np.array([of[i] for i in flat.tolist()], np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["qkey", "vec_id", "score", "leaf"])

    near = _smallest(index.select("vec_id", "vec", "leaf").mapInArrow(exact, "qkey long, vec_id long, score double, leaf int"), "qkey", k + 1, "score", "vec_id")
    # At most calibration * (k + 1) rows.
    met: dict[int, list[int]] = {}
    for r in near.where("vec_id != qkey").select("qkey", "leaf").toLocalIterator():
        met.setdefault(r["qkey"], []).append(r["leaf"])
    ranks = []
    for key, p in zip(own.tolist(), q, strict=True):
        order = {leaf: i for i, leaf in enumerate(tree.visits(p, len(tree.rows), 0))}
        ranks += [order[leaf] for leaf in met.get(key, [])]
    if not ranks:
        return 1
    return int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1


@query("op6_nearest_neighbours")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)
