"""Near-duplicate classes by circulant MinHash.

Two permutations serve all coordinates: the first scatters a shingle over a circle of `CIRCLE` places, the second gives
every place a rank; coordinate k is the smallest rank met when the circle is turned by k places. Coordinates are grouped
into `BANDS` bands of `ROWS`; documents that agree in a whole band are compared on their full shingle sets. At a
similarity of 0.8 a pair shares no band with a probability of (1 - 0.8**6)**40 = 5e-6.

Steps, all of them Spark jobs whose tables lie in the shared folder:

1. sets: per document the number of shingles, a 128-bit digest of the set and one hash per band;
2. equal sets become one node, so a group of copies costs one row from here on;
3. per band bucket the smallest node leads; each other member is compared with its leader only (a star, no pairs);
4. a bucket that still holds several components names the largest of them its hub; the nodes of all buckets of a hub meet
   once, in blocks inside tasks, where pairs of different components are compared; a block emits the links that join
   components, never pairs;
5. links are closed to components by minimum labels with pointer jumping.

Defined cases: null, empty and blank texts have no shingles and link with nothing; a text of fewer words than a shingle is
one shingle; repeated rows share their component; rows with a null id are not linked and get a null component; further
columns are ignored. Rows of one id with different texts count as one node when components are built.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.core import col
from featloom.llm.base import WordHashes, encoded, mixed, picked, query, stored, table

CIRCLE = 1 << 20
BANDS, ROWS = 40, 6
#: Nodes of a hub that meet in one block, and bands that a pair must share there to be compared in full.
BLOCK, AGREE = 1_024, 1
#: Ids sent to every task instead of a shuffle of the texts; 8 bytes each.
SENT_IDS = 500_000


class ShingleSets:
    """Sorted 64-bit hashes of the distinct shingles of a text."""

    def __init__(self, width: int):
        self.width, self.hashes = width, WordHashes()

    def of(self, text: str | None) -> np.ndarray:
        words = encoded(text).lower().split()
        if not words:
            return np.empty(0, np.uint64)
        own = self.hashes.array(words)
        width = min(self.width, len(words))
        acc = np.full(len(words) - width + 1, width, np.uint64)
        for j in range(width):
            acc = mixed(acc * np.uint64(0x9E3779B97F4A7C15) + own[j : len(words) - width + 1 + j])
        return np.unique(acc)


class Circulant:
    def __init__(self, bands: int, rows: int, seed: int = 7):
        self.bands, self.rows = bands, rows
        ranks = np.random.default_rng(seed).permutation(CIRCLE).astype(np.uint32)
        turned = np.concatenate([ranks, ranks[: bands * rows]])
        self.windows = np.lib.stride_tricks.sliding_window_view(turned, bands * rows)[:CIRCLE]

    def bands_of(self, shingles: np.ndarray) -> np.ndarray:
        """One hash per band of the signature of a non-empty set."""
        places = (mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(44)).astype(np.int64)
        least = np.full(self.bands * self.rows, np.iinfo(np.uint32).max, np.uint32)
        for i in range(0, len(places), 2048):
            np.minimum(least, self.windows[places[i : i + 2048]].min(axis=0), out=least)
        grid = least.reshape(self.bands, self.rows).astype(np.uint64)
        acc = np.arange(1, self.bands + 1, dtype=np.uint64)
        for j in range(self.rows):
            acc = mixed(acc * np.uint64(0x9E3779B97F4A7C15) + grid[:, j])
        return acc.view(np.int64)


def shingle_sets(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, digest (null for an empty set) and the band hashes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, circulant = ShingleSets(width), Circulant(bands, rows)
        for batch in batches:
            sizes, digests, hashes = [], [], []
            for body in batch.column(1).to_pylist():
                own = shingles.of(body)
                sizes.append(len(own))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                hashes.append(circulant.bands_of(own) if len(own) else np.empty(0, np.int64))
            flat = pa.array(np.concatenate(hashes) if hashes else np.empty(0, np.int64), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(h) for h in hashes])]), pa.int32()), flat)
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "digest", "bands"])

    return docs.select("doc_id", "text").mapInArrow(sets, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The (node, leader) rows whose full sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = ShingleSets(width)
        last: tuple[int, np.ndarray] | None = None
        for batch in batches:
            keep = []
            for leader, body, other in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if last is None or last[0] != leader:
                    last = leader, shingles.of(other)
                keep.append(_linked(shingles.of(body), last[1], percent))
            yield batch.select(["node", "leader"]).filter(pa.array(keep, pa.bool_()))

    own = pairs.join(texts, "node")
    both = own.join(texts.select(F.col("node").alias("leader"), F.col("text").alias("leading")), "leader")
    return both.select("node", "leader", "text", "leading").mapInArrow(check, "node long, leader long")


def components(links: DataFrame, a: str = "node", b: str = "leader") -> DataFrame:
    """node, component (smallest reachable node) of every node that has a link."""
    edges = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(F.col(b), F.col(a))).where("u != v").distinct(), "edges")
    labels = stored(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("v"), F.col("component").alias("c")), "v").groupBy(F.col("u").alias("node")).agg(F.min("c").alias("c"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "c").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("root"))
        after = stored(lower.join(jump, "c").select("node", F.col("root").alias("component"), (F.col("root") != F.col("was")).alias("changed")), "labels")
        labels = after.select("node", "component")
        if after.where("changed").isEmpty():
            return labels


def _block_links(rows: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links that join different components; rows: hub, node, n, component, bands (each node once for a hub).

    All nodes of a hub meet in blocks of `BLOCK`, every pair in one block. A pair of different components that agrees in
    `AGREE` bands is compared in full inside the block; only the links that join components leave it.
    """
    held = stored(rows.groupBy("hub").agg(F.count(F.lit(1)).alias("held")), "held")
    parts = F.ceil(F.col("held") / BLOCK).cast("int")
    dealt = rows.join(held, "hub").withColumn("mine", F.pmod(F.xxhash64("node"), parts).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("other")).withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("node").reset_index(drop=True)
        nodes, sizes, part, home = (block[c].to_numpy() for c in ("node", "n", "mine", "component"))
        split = bool((block["low"] != block["high"]).iat[0])
        bands = np.stack([np.asarray(x) for x in block["bands"]]).astype(np.uint32)
        outside = home != block["hub"].to_numpy()
        up = {int(c): int(c) for c in home}
        shingles, sets, links = ShingleSets(width), {}, []
        bodies = list(block["text"])

        def root(c: int) -> int:
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        def of(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingles.of(bodies[k])
            return sets[k]

        for i in np.flatnonzero(outside):
            near = (home != home[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
            # Two nodes outside the hub meet when the later one is at hand.
            near[i:] &= ~outside[i:]
            if split:
                near &= part != part[i]
            ahead = np.flatnonzero(near)
            ahead = ahead[(bands[ahead] == bands[i]).sum(axis=1) >= AGREE]
            for j in ahead.tolist():
                if root(int(home[i])) != root(int(home[j])) and _linked(of(i), of(j), percent):
                    links.append((int(nodes[i]), int(nodes[j])))
                    up[root(int(home[i]))] = root(int(home[j]))
        return pd.DataFrame(links, columns=["node", "leader"], dtype="int64")

    return dealt.join(texts, "node").groupBy("hub", "low", "high").applyInPandas(compare, "node long, leader long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id and kept (the row's id is the smallest of its component)."""
    source = docs.select(col(key).cast("long").alias("doc_id"), col(text).alias("text"))
    sets = stored(shingle_sets(source, width), "sets")
    classes = sets.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest")
    classes = stored(classes.agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    buckets = classes.select("node", "n", F.explode("bands").alias("bucket"))
    lead = buckets.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    lead = stored(lead.select("bucket", F.col("lead.node").alias("leader"), F.col("lead.n").alias("lead_n"), "size"), "buckets")
    members = stored(buckets.join(lead, "bucket"), "members")

    wanted = stored(members.select("node").distinct(), "wanted")
    if wanted.count() <= SENT_IDS:
        wanted = F.broadcast(wanted)
    texts = stored(source.join(wanted, source["doc_id"] == wanted["node"]).select("node", "text").dropDuplicates(["node"]), "texts")

    close = (100 * F.least("n", "lead_n") >= percent * F.greatest("n", "lead_n")) & (F.col("node") != F.col("leader"))
    links = stored(_verified(members.where(close).select("node", "leader").distinct(), texts, width, percent), "links")
    labels = components(links)

    labelled = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = stored(labelled.select("bucket", "node", "n", "component", "size"), "labelled")
    # Written, so that the join on a hot component can be split.
    sizes = stored(labelled.select("node", "component").distinct().groupBy("component").agg(F.count(F.lit(1)).alias("k")), "sizes")
    ranked = labelled.join(sizes, "component").groupBy("bucket").agg(F.max(F.struct("k", "component")).alias("top"), F.min("component").alias("a"), F.max("component").alias("b"))
    hubs = stored(ranked.where("a != b").select("bucket", F.col("top.component").alias("hub")), "hubs")
    rest = stored(labelled.join(hubs, "bucket").select("hub", "node", "n", "component").distinct(), "rest")
    rest = rest.join(classes.select("node", "bands").dropDuplicates(["node"]), "node")
    more = stored(_block_links(rest, texts, width, percent).distinct(), "more")
    if not more.isEmpty():
        labels = components(links.union(more))

    named = classes.join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("found"))
    out = sets.drop("bands").join(stored(named, "named"), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The documents with the smallest id of their component; rows without an id stay."""
    found = near_duplicates(docs, key, text, width, percent)
    dropped = stored(found.where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__dropped")).distinct(), "dropped")
    if dropped.count() <= SENT_IDS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, col(key) == F.col("__dropped"), "left_anti")


@query("op9_near_duplicates")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(picked(table(spark, folder, "documents"), "doc_id", "text"), width=2)
