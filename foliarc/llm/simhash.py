"""SimHash near-duplicates: fingerprints meet in the leaves of vantage-point trees.

Fingerprints are linked at ``RADIUS`` or fewer differing bits. The 64 bits fall into three parts;
two linked fingerprints differ by at most one bit in some part. Each part has a vantage-point
tree over the Hamming distance: a node splits by the distance to its vantage point, and a ball of
radius one enters a branch only if the triangle inequality lets one of its points lie there. A
fingerprint lives in one leaf (a shard) of each tree and visits the other leaves that its ball
overlaps, so every linked pair meets. Leaves compare whole fingerprints and pass on one edge per
linked fingerprint, never pairs, and the edges of all leaves are joined to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from foliarc.llm.common import partitions, release_memory, staged, text_or_empty
from foliarc.llm.suffix_dedup import whole_groups

RADIUS = 4
SHINGLE = 4
SEED = 42
# Bits of the three parts: with four differing bits, one part has at most one.
PARTS = ((0, 21), (21, 21), (42, 22))
PART_RADIUS = 1
LEAF_ROWS = 64
MAX_DEPTH = 14
TREE_SAMPLE = 65_536
SHINGLES_AT_ONCE = 1 << 16
PAIRS_AT_ONCE = 1 << 21


def fingerprint(text: str) -> int:
    """Signed 64-bit SimHash of the whole text; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.cumsum(size) - size
    stop = (start + size - 1)[min(SHINGLE, len(words)) - 1:].tolist()
    start = start.tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(stop), SHINGLES_AT_ONCE):
        part = stop[at:at + SHINGLES_AT_ONCE]
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(start[at:], part)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(stop), bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column) -> Column:
    @F.pandas_udf(LongType())
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(t) for t in batch], dtype="int64")
        release_memory()

    return prints(text)


class VantageTree:
    """A vantage-point tree over one part of the bits, with nodes in heap order."""

    def __init__(self, sample: np.ndarray, bits: int, depth: int, seed: int):
        draw = np.random.default_rng(seed)
        self.depth, self.bits = depth, bits
        self.vantage = draw.integers(0, 1 << bits, (1 << depth) - 1, dtype=np.uint32)
        self.radius = np.full((1 << depth) - 1, bits // 2, np.int8)
        node = np.zeros(len(sample), np.int64)
        for level in range(depth):
            by = np.argsort(node, kind="stable")
            names, first = np.unique(node[by], return_index=True)
            for name, mine in zip(names, np.split(by, first[1:])):
                self.vantage[name] = sample[mine[len(mine) // 2]] if level % 2 else self.vantage[name]
                distance = np.bitwise_count(sample[mine] ^ self.vantage[name])
                self.radius[name] = self.halving(distance)
            far = np.bitwise_count(sample ^ self.vantage[node]) > self.radius[node]
            node = 2 * node + 1 + far

    @staticmethod
    def halving(distance: np.ndarray) -> int:
        """The radius that cuts the distances most evenly."""
        below = np.cumsum(np.bincount(distance))
        return int(np.argmin(np.abs(2 * below - len(distance))))

    def visits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Point number, leaf and whether it lives there, for every leaf that its ball of radius one overlaps.

        The ball is carried as a mask: one bit per flipped bit, and one for the point itself. At distance d
        from a vantage point its points lie at d - 1, d or d + 1, so only a boundary splits a mask.
        """
        at = np.arange(len(points))
        node = np.zeros(len(points), np.int64)
        own = np.uint32(1 << self.bits)
        flips = np.uint32((1 << self.bits) - 1)
        ball = np.full(len(points), own | flips, np.uint32)
        for _ in range(self.depth):
            differ = points[at] ^ self.vantage[node]
            reach = np.bitwise_count(differ).astype(np.int16) - self.radius[node]
            near = np.where(reach <= 1, ball & differ & flips, np.uint32(0))
            near |= np.where(reach <= 0, ball & own, np.uint32(0))
            near |= np.where(reach <= -1, ball & ~differ & flips, np.uint32(0))
            far = ball & ~near
            inside, outside = near != 0, far != 0
            at = np.concatenate([at[inside], at[outside]])
            node = np.concatenate([2 * node[inside] + 1, 2 * node[outside] + 2])
            ball = np.concatenate([near[inside], far[outside]])
        return at, node - ((1 << self.depth) - 1), (ball & own) != 0


def part_of(prints: np.ndarray, part: int) -> np.ndarray:
    low, bits = PARTS[part]
    return ((prints >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def plant(nodes: DataFrame, count: int) -> list[VantageTree]:
    """Trees fitted on at most ``TREE_SAMPLE`` fingerprints; the sample shapes the leaves, not the result."""
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, count) / LEAF_ROWS)))))
    picked = nodes.filter(F.pmod(F.xxhash64("fp"), F.lit(max(1, count // TREE_SAMPLE))) == 0).limit(TREE_SAMPLE)
    sample = picked.toPandas()["fp"].to_numpy().astype(np.int64).view(np.uint64) if depth else np.zeros(0, np.uint64)
    return [VantageTree(part_of(sample, p), PARTS[p][1], depth, p) for p in range(len(PARTS))]


def visitors(trees):
    """Rows (leaf, fp, home). Of two leaves the higher one compares, so a ball visits only leaves above its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy().view(np.uint64)
            for part, tree in enumerate(trees.value):
                at, leaf, home = tree.visits(part_of(fp, part))
                living = np.empty(len(fp), np.int64)
                living[at[home]] = leaf[home]
                use = leaf >= living[at]
                yield pd.DataFrame({"leaf": leaf[use] * len(PARTS) + part, "fp": fp[at[use]].view(np.int64), "home": home[use]})

    return run


def lowest(labels: np.ndarray) -> np.ndarray:
    """Follow labels to their ends."""
    while True:
        further = labels[labels]
        if (further == labels).all():
            return labels
        labels = further


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of a[i] and b[i]; every label ends as the smallest index of its set."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        labels = lowest(labels)
    return labels


def link(points: np.ndarray, lives: np.ndarray) -> np.ndarray:
    """Component of each point (index of its first member) among the links to points that live here.

    Large leaves are thinned first: points within half the radius of a pivot are linked to each other,
    so a pivot stands for them, and by the triangle inequality only points within 1.5 radii of the pivot can
    link to them. Links are used block by block and never listed for the whole leaf.
    """
    labels = np.arange(len(points))
    left = labels
    balls: list[tuple[int, np.ndarray]] = []
    if len(points) * int(lives.sum()) > PAIRS_AT_ONCE:
        while len(left) and len(balls) < 256:
            close = np.bitwise_count(points[left] ^ points[left[len(left) // 2]]) <= RADIUS // 2
            if close.sum() * 64 < len(left):
                break
            balls.append((left[len(left) // 2], left[close]))
            labels[left[close]] = left[close].min()
            left = left[~close]
    pivots = np.array([p for p, _ in balls], np.int64)
    rows = np.concatenate([pivots, left])
    columns = rows if len(balls) else np.flatnonzero(lives)
    step = max(1, PAIRS_AT_ONCE // max(1, len(columns)))
    for at in range(0, len(rows), step):
        some = rows[at:at + step]
        a, b = np.nonzero(np.bitwise_count(points[some][:, None] ^ points[columns][None, :]) <= RADIUS)
        labels = merge_labels(labels, some[a], columns[b])
    for pivot, members in balls:
        near = np.flatnonzero(np.bitwise_count(points ^ points[pivot]) <= RADIUS + RADIUS // 2)
        step = max(1, PAIRS_AT_ONCE // len(members))
        for at in range(0, len(near), step):
            some = near[at:at + step]
            some = some[labels[some] != labels[pivot]]
            hit = (np.bitwise_count(points[some][:, None] ^ points[members][None, :]) <= RADIUS).any(axis=1)
            labels = merge_labels(labels, some[hit], np.full(int(hit.sum()), pivot))
    return labels


def leaf_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One edge (a, b) from each linked fingerprint of a leaf to its local component's first."""
    for batch in whole_groups(batches, "leaf"):
        leaf, fp, home = batch["leaf"].to_numpy(), batch["fp"].to_numpy(), batch["home"].to_numpy().astype(bool)
        edge = np.append(np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1])), len(leaf))
        one, two = [], []
        for start, stop in zip(edge[:-1], edge[1:]):
            if stop - start < 2 or not home[start:stop].any():
                continue
            labels = link(fp[start:stop].view(np.uint64), home[start:stop])
            linked = np.flatnonzero(labels != np.arange(stop - start))
            one.append(fp[start + linked])
            two.append(fp[start + labels[linked]])
        if one:
            yield pd.DataFrame({"a": np.concatenate(one), "b": np.concatenate(two)})


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node of its component.

    Alternates the large-star and small-star steps: each node's neighbours are handed to the
    smallest one. A step is two combined aggregates and joins on the node; a star's centre is
    reduced before the exchange. Edges are written to the shared folder after each round.
    """
    arcs = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "arcs")
    mark = signature(arcs)
    while True:
        both = arcs.unionByName(arcs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        arcs = staged(small.unionByName(below.select("u", F.col("m").alias("v"))).distinct(), "arcs")
        now = signature(arcs)
        if now == mark:
            return arcs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def signature(arcs: DataFrame) -> tuple:
    return tuple(arcs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def grouped_prints(prints: DataFrame) -> DataFrame:
    """(fp, root): the component of every fingerprint of ``prints`` (fp), named by its smallest fingerprint."""
    spark = prints.sparkSession
    nodes = prints.select("fp").distinct()
    nodes = staged(nodes, "fingerprints")
    trees = spark.sparkContext.broadcast(plant(nodes, nodes.count()))
    placed = nodes.mapInPandas(visitors(trees), "leaf long, fp long, home boolean")
    met = placed.repartition(partitions(spark), "leaf").sortWithinPartitions("leaf")
    found = components(met.mapInPandas(leaf_edges, "a long, b long"))
    return nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of each row of ``docs`` (doc_id, text).

    Null, empty and wordless texts have fingerprint zero and link like any other. component_id is the
    smallest doc_id of the component, null ids aside (null if it has no other). Repeated rows are
    returned each; other columns are ignored; an empty table gives an empty result.
    """
    prints = staged(docs.select("doc_id", fingerprint_column(text_or_empty()).alias("fp")), "prints")
    groups = grouped_prints(prints)
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).join(groups, "fp")
    named = firsts.join(firsts.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")
