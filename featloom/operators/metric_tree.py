"""Exact nearest neighbours over a tree of balls that is built in Spark rounds and searched block by block.

Building: every node with more than `leaf` points gets up to `FAN` pivots, spread out by farthest-first choice among a
hashed sample of its points and moved to the means of their cells, and its points go to their nearest pivot. A round does this for all large nodes at once.
A child keeps its centre, the distance of its farthest point and its size; that is all a search reads of it. Queries go
down with the points, so each of them has a home leaf.

Searching: queries of neighbouring leaves form blocks of bounded size, at least a few for each core, so their number
does not grow with the queries as long as these fit. A block goes down the tree once. A child that holds k points bounds
the k-th distance of a query from above by the way to its centre plus its radius; a child whose nearest possible point
lies beyond the bounds of all queries is left out. The points of the other leaves stream through the task of the block,
home leaves first and then the nearest ones; the task keeps the k nearest points of each query and their tightening bound.
So no row is made for a query and a leaf, and a block of queries is all that a task holds.

Squared distances come from matrix products. They only tell which points may be near enough, with a margin for rounding;
the distances of these are then taken from the differences.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featloom.core import written
from featloom.functions.ordering import running_sums

FAN, LEAF, BLOCK, DEPTH = 16, 2_000, 20_000, 14
#: Points of a node that its pivots are chosen from, and rounds in which they move to the means of their cells.
SAMPLE, MEANS = 40 * FAN, 4
#: Queries of a block: at least and at most; blocks for each core until blocks are full.
FEWEST, MOST, WAVES = 256, 20_000, 3
#: Queries that meet the points of a leaf at a time, and pairs whose differences are taken at a time.
SLICE, PAIRS = 512, 50_000


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, in slices so that no task holds a large cube."""
    out = np.empty((len(a), len(b)))
    for i in range(0, len(a), 64):
        out[i : i + 64] = np.sqrt(((a[i : i + 64, None, :] - b[None, :, :]) ** 2).sum(-1))
    return out


class Squares:
    """Squared distances from fixed rows by one matrix product; `margin` covers its rounding."""

    def __init__(self, a: np.ndarray):
        self.norms = np.einsum("ij,ij->i", a, a)
        self.left = np.column_stack([-2 * a, np.ones(len(a)), self.norms])

    def to(self, b: np.ndarray, rows=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        norms = np.einsum("ij,ij->i", b, b)
        with np.errstate(invalid="ignore", over="ignore"):
            found = self.left[rows] @ np.column_stack([b, norms, np.ones(len(b))]).T
            margin = (b.shape[1] + 4) * 1e-15 * (self.norms[rows] + np.fmax.reduce(norms, initial=0.0))
        return found, margin


def _stacked(pdf: pd.DataFrame, name: str = "vec") -> np.ndarray:
    return np.stack(pdf[name].to_numpy()).astype(float)


def _none(*names: str) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in names})


def _in_blocks(rows: DataFrame, beside: DataFrame, size: int):
    """Rows of a node in blocks of about `size`, each with all rows `beside` of the node."""
    blocks = rows.groupBy("node").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("_blocks"))
    left = rows.join(blocks, "node").withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")).drop("_blocks")
    right = beside.join(blocks, "node").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    return left.groupBy("node", "_block").cogroup(right.groupBy("node", "_block"))


def _pivots(rows: DataFrame, sizes: DataFrame, leaf: int) -> DataFrame:
    """node, child, centre: means around farthest-first points of a sample of every node; at least two, or none."""

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        points, wanted = _stacked(pdf), int(min(FAN, max(2, -(-int(pdf["n"].iat[0]) // leaf))))
        points = points[np.isfinite(points).all(1)]
        if not len(points):
            return _none("node", "child", "centre")
        taken, gap = [0], distances(points, points[:1])[:, 0]
        while len(taken) < wanted and gap.max() > 0:
            taken.append(int(gap.argmax()))
            gap = np.minimum(gap, distances(points, points[taken[-1:]])[:, 0])
        node, centres = pdf["node"].iat[0], points[taken]
        if len(centres) < 2:
            return _none("node", "child", "centre")
        # far points lie at the rim, where cells are small: the means of their cells even these out
        for _ in range(MEANS):
            at = distances(points, centres).argmin(1)
            moved = np.stack([points[at == i].mean(0) if (at == i).any() else c for i, c in enumerate(centres)])
            if len(np.unique(distances(points, moved).argmin(1))) < 2:
                break
            centres = moved
        # one digit a level: the order of the names is that of the tree
        return pd.DataFrame({"node": node, "child": [f"{node}{i:x}" for i in range(len(centres))], "centre": list(centres)})

    met = F.pmod(F.xxhash64("id", "node"), F.lit(1 << 30)) < F.lit(float(SAMPLE << 30)) / F.col("n")
    return rows.where("points > 0").join(sizes, "node").where(met).groupBy("node").applyInPandas(spread, "node string, child string, centre array<double>")


class Tree:
    """`leaves` holds (id, vec, node, points, asked: copies as a point and as a query), `nodes` (node, child, centre, radius, n, is_leaf)."""

    def __init__(self, points: DataFrame, queries: DataFrame, leaf: int = LEAF):
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        both = points.select("id", "vec", one.alias("points"), none.alias("asked")).union(queries.select("id", "vec", none, one))
        rows = both.groupBy("id", "vec").agg(F.sum("points").alias("points"), F.sum("asked").alias("asked"))
        rows = written(rows.select("id", "vec", F.lit("").alias("node"), "points", "asked"), "tree")
        done, levels = [], []
        for _ in range(DEPTH):
            sizes = rows.groupBy("node").agg(F.sum("points").alias("n"))
            pivots = written(_pivots(rows, sizes.where(F.col("n") > leaf), leaf), "pivots")
            if pivots.isEmpty():
                break
            split = pivots.select("node").distinct()
            done.append(rows.join(split, "node", "left_anti").select(rows.columns))
            rows, level = self._dealt(rows.join(split, "node", "left_semi"), pivots)
            levels.append(level)
        self.leaves = reduce(DataFrame.union, [*done, rows])
        if levels:
            inner = reduce(DataFrame.union, levels)
            parents = inner.select(F.col("node").alias("child"), F.lit(False).alias("_inner")).distinct()
            self.nodes = written(inner.join(parents, "child", "left").withColumn("is_leaf", F.coalesce("_inner", F.lit(True))).drop("_inner"), "nodes")
        else:
            alone = rows.where("points > 0").agg(F.min_by("vec", "id").alias("centre"), F.sum("points").alias("n")).where("n > 0")
            self.nodes = alone.select(F.lit("root").alias("node"), F.lit("").alias("child"), "centre", F.lit(float("inf")).alias("radius"), "n", F.lit(True).alias("is_leaf"))

    @staticmethod
    def _dealt(rows: DataFrame, pivots: DataFrame) -> tuple[DataFrame, DataFrame]:
        def assign(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(p):
                return _none("id", "vec", "node", "points", "asked", "away")
            p = p.sort_values("child")
            gap = distances(_stacked(q), _stacked(p, "centre"))
            at = gap.argmin(1)
            return pd.DataFrame({
                "id": q["id"].to_numpy(), "vec": q["vec"].to_numpy(), "node": p["child"].to_numpy()[at], "points": q["points"].to_numpy(),
                "asked": q["asked"].to_numpy(), "away": gap[np.arange(len(q)), at]})

        schema = "id string, vec array<double>, node string, points long, asked long, away double"
        dealt = written(_in_blocks(rows, pivots, BLOCK).applyInPandas(assign, schema), "dealt")
        seen = dealt.where("points > 0").groupBy(F.col("node").alias("child")).agg(F.max("away").alias("radius"), F.sum("points").alias("n"))
        return dealt.drop("away"), pivots.join(seen, "child").select("node", "child", "centre", "radius", "n")


def _slack(bound):
    """Covers rounding in the distances."""
    return bound * (1 + 1e-9) + 1e-12


def _asked(tree: Tree) -> tuple[DataFrame, int]:
    """(block, id, vec, node): queries of neighbouring leaves in blocks of bounded size; the number of blocks."""
    asked = tree.leaves.where("asked > 0")
    per_leaf = written(asked.groupBy("node").agg(F.sum("asked").alias("m")), "asked")
    total = per_leaf.agg(F.sum("m")).first()[0] or 0
    size = max(FEWEST, min(MOST, -(-total // (WAVES * asked.sparkSession.sparkContext.defaultParallelism))))
    before = running_sums(per_leaf, [F.asc("node")], {"_upto": F.col("m")})
    start = F.floor((F.col("_upto") - F.col("m")) / F.lit(size))
    places = before.select("node", start.cast("int").alias("start"), F.ceil(F.col("m") / F.lit(size)).cast("int").alias("parts"))
    copies = asked.select("id", "vec", "node", F.explode(F.sequence(F.lit(1).cast("long"), F.col("asked"))).alias("copy"))
    part = F.pmod(F.xxhash64("id", "copy"), F.col("parts")).cast("int")
    return copies.join(places, "node").select((F.col("start") + part).alias("block"), "id", "vec", "node"), total // size + 1


_ROUTE = "block int, turn double, node string, kind int, id string, vec array<double>, size double"
#: Kinds of rows that stream through a block: its queries (size: bound), a leaf (vec: centre, size: radius), a point of it.
QUERY, HEAD, POINT = 0, 1, 2


def _routes(asked: DataFrame, blocks: int, nodes: DataFrame, k: int) -> DataFrame:
    """The queries of each block with their bounds, and the leaves that can hold one of their k nearest points."""

    def down(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(t):
            return _none("block", "turn", "node", "kind", "id", "vec", "size")
        vecs, centres, radius, full = _stacked(q), _stacked(t, "centre"), t["radius"].to_numpy(), t["n"].to_numpy() >= k
        squares, bound, is_leaf = Squares(vecs), np.full(len(q), np.inf), t["is_leaf"].to_numpy()
        below = t.groupby("node").indices
        front, met, gaps = np.flatnonzero(~t["node"].isin(set(t["child"]))), [], []
        while len(front):
            alive, least = np.zeros(len(front), bool), np.full(len(front), np.inf)
            for i in range(0, len(q), SLICE):
                rows = slice(i, i + SLICE)
                square, margin = squares.to(centres[front], rows)
                with np.errstate(invalid="ignore"):
                    far = np.sqrt(np.maximum(square, 0) + margin[:, None]) + radius[front]
                    near = np.maximum(np.sqrt(np.maximum(square - margin[:, None], 0)) - radius[front], 0)
                bound[rows] = np.fmin(bound[rows], np.fmin.reduce(np.where(full[front], far, np.inf), axis=1))
                alive |= (~(near > _slack(bound[rows])[:, None])).any(0)
                least = np.fmin(least, np.fmin.reduce(near, axis=0))
            ends = alive & is_leaf[front]
            met.append(front[ends])
            gaps.append(least[ends])
            front = np.concatenate([below[c] for c in t["child"].to_numpy()[front[alive & ~is_leaf[front]]]] or [np.zeros(0, int)])
        met, gaps = np.concatenate(met), np.concatenate(gaps)
        home = np.flatnonzero(t["child"].isin(set(q["node"])).to_numpy() & is_leaf)
        heads = np.concatenate([home, met])
        block = int(q["block"].iat[0])
        own = pd.DataFrame({"block": block, "turn": -2.0, "node": q["node"].to_numpy(), "kind": QUERY, "id": q["id"].to_numpy(), "vec": q["vec"].to_numpy(), "size": bound})
        leaves = pd.DataFrame({
            "block": block, "turn": np.concatenate([np.full(len(home), -1.0), gaps]), "node": t["child"].to_numpy()[heads], "kind": HEAD, "id": None,
            "vec": t["centre"].to_numpy()[heads], "size": radius[heads]})
        return pd.concat([own, leaves], ignore_index=True)

    beside = nodes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return asked.groupBy("block").cogroup(beside.groupBy("block")).applyInPandas(down, _ROUTE)


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    width = len(flat) // len(column) if width is None else width
    if width * len(column) != len(flat):
        raise ValueError("all vectors must have the same length")
    return flat.reshape(len(column), width)


class Block:
    """The queries of a block and their k nearest points so far."""

    def __init__(self, names: list, homes: np.ndarray, vecs: np.ndarray, bound: np.ndarray, k: int):
        self.names, self.homes, self.vecs, self.far, self.k = names, homes, vecs, bound, k
        self.squares = Squares(vecs)
        self.gap = np.full((len(vecs), k), np.inf)
        self.other = np.full((len(vecs), k), None, object)
        self.held = np.zeros(len(vecs), int)
        self.rows = np.zeros(0, int)

    def enter(self, node: str, centre: np.ndarray, radius: float, home: bool) -> None:
        """From now on come points of this leaf: as the home leaf of some queries, or for the others."""
        if home:
            self.rows = np.flatnonzero(self.homes == node)
            return
        square, margin = self.squares.to(centre[None, :])
        with np.errstate(invalid="ignore"):
            near = np.sqrt(np.maximum(square[:, 0] - margin, 0)) - radius
        self.rows = np.flatnonzero(~(near > _slack(self.far)) & (self.homes != node))

    def meet(self, names: np.ndarray, points: np.ndarray) -> int:
        """Compare the queries that the leaf concerns with some of its points; the number of distances."""
        for i in range(0, len(self.rows), SLICE):
            self._slice(self.rows[i : i + SLICE], names, points)
        return len(self.rows) * len(points)

    def _slice(self, rows: np.ndarray, names: np.ndarray, points: np.ndarray) -> None:
        square, margin = self.squares.to(points, rows)
        far = self.far[rows]
        limit = _slack(far) ** 2 + margin
        loose = (self.held[rows] < self.k) | ~np.isfinite(far)
        if len(points) > self.k and loose.any():
            limit[loose] = np.fmin(limit[loose], np.partition(square[loose], self.k - 1, axis=1)[:, self.k - 1] + 2 * margin[loose])
        at = np.flatnonzero(~(square > limit[:, None]))
        for i in range(0, len(at), PAIRS):
            q, p = np.divmod(at[i : i + PAIRS], len(points))
            gap = np.sqrt(((self.vecs[rows[q]] - points[p]) ** 2).sum(-1))
            kept = ~(gap > _slack(self.far[rows[q]]))
            if kept.any():
                self._keep(rows[q[kept]], gap[kept], names[p[kept]])

    def _keep(self, rows: np.ndarray, gap: np.ndarray, names: np.ndarray) -> None:
        touched = np.unique(rows)
        old, slot = np.nonzero(np.arange(self.k) < self.held[touched][:, None])
        old = touched[old]
        rows, gap, names = np.concatenate([rows, old]), np.concatenate([gap, self.gap[old, slot]]), np.concatenate([names, self.other[old, slot]])
        by_name = np.unique(np.array([n or "" for n in names], object), return_inverse=True)[1]
        order = np.lexsort((by_name, gap, rows))
        rows, gap, names = rows[order], gap[order], names[order]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        kept = place < self.k
        self.gap[rows[kept], place[kept]], self.other[rows[kept], place[kept]] = gap[kept], names[kept]
        self.held[touched] = np.minimum(self.k, np.diff(np.append(first, len(rows))))
        full = touched[self.held[touched] == self.k]
        self.far[full] = self.gap[full, -1]

    def found(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.vecs), BLOCK):
            q, slot = np.nonzero(np.arange(self.k) < self.held[i : i + BLOCK, None])
            q += i
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.names[j] for j in q], pa.string()), pa.array(self.other[q, slot], pa.string()), pa.array(self.gap[q, slot], pa.float64())],
                ["id", "other", "distance"])


def _searched(batches: Iterator[pa.RecordBatch], k: int, counter) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, turn, node and kind: queries first, then each leaf before its points."""
    block, at, waiting = None, None, []
    for batch in batches:
        of, node, kind, turn = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("block", "node", "kind", "turn"))
        size, ids = batch.column("size").to_numpy(zero_copy_only=False), batch.column("id").to_numpy(zero_copy_only=False)
        new = (of[1:] != of[:-1]) | (kind[1:] != kind[:-1]) | ((kind[1:] != QUERY) & ((node[1:] != node[:-1]) | (turn[1:] != turn[:-1])))
        cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(of)]]) if len(of) else np.zeros(1, int)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if of[a] != at:
                if block is not None:
                    yield from block.found()
                block, at, waiting = None, of[a], []
            own = batch.column("vec").slice(a, b - a)
            if kind[a] == QUERY:
                waiting.append((ids[a:b], node[a:b], _matrix(own), size[a:b]))
                continue
            if block is None:
                names, homes, vecs, bound = (np.concatenate(part) for part in zip(*waiting, strict=True))
                block, waiting = Block(names, homes, vecs, bound, k), []
            if kind[a] == HEAD:
                block.enter(node[a], _matrix(own)[0], size[a], turn[a] < 0)
            elif len(block.rows):
                met = block.meet(ids[a:b], _matrix(own, block.vecs.shape[1]))
                if counter is not None:
                    counter.add(met)
    if block is not None:
        yield from block.found()


def _first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))
    return found.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def nearest(queries: DataFrame, points: DataFrame, k: int, chunk: int = LEAF, counter=None) -> DataFrame:
    """Exact k nearest points (id, other, distance) of each query; ties go to the smaller id.

    Both frames hold distinct (id string, vec array<double>). A query that is itself a point meets itself. `counter` is
    an accumulator for the distances between queries and points.
    """
    # of equal points no more than k can be among the nearest
    copies = Window.partitionBy("vec").orderBy("id")
    several = points.select("id", "vec").withColumn("_r", F.row_number().over(copies)).where(F.col("_r") <= k).drop("_r")
    tree = Tree(several, queries.select("id", "vec"), chunk)
    asked, blocks = _asked(tree)
    routes = written(_routes(asked, blocks, tree.nodes, k), "routes")
    held = tree.leaves.where("points > 0").select("node", "id", "vec", F.explode(F.sequence(F.lit(1).cast("long"), F.col("points"))).alias("_copy"))
    streamed = routes.where(F.col("kind") == HEAD).select("block", "turn", "node").join(held, "node").select(
        "block", "turn", "node", F.lit(POINT).alias("kind"), "id", "vec", F.lit(None).cast("double").alias("size"))
    dealt = routes.union(streamed).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "turn", "node", "kind")
    found = dealt.mapInArrow(lambda batches: _searched(batches, k, counter), "id string, other string, distance double")
    return _first(found, k)
