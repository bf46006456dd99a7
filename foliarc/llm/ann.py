"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample and every row is indexed in one of its leaves. A query walks
the tree best bin first: a priority queue holds nodes by the distance to their centres, the nearest
is opened next, and leaves are visited in that order. How many leaves are visited is widened until
the recall measured on calibration queries, against brute force over all rows, is reached.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliarc.llm.common import staged

BRANCHES = 8
SAMPLE = 20_000  # rows the tree is fitted on at most
LEAF_ROWS = 256  # aimed at; leaves grow with the table once the sample is used up
LEAST_SAMPLE = 4  # sampled rows a leaf keeps at least
ROUNDS = 8
TARGET = 0.97
CALIBRATION = 256  # calibration queries at most
BLOCK_ROWS = 8192
BLOCK_QUERIES = 4096
CELLS = 1 << 21


class KMeansTree:
    """Nodes with centres; children of a node stand together; leaves are numbered."""

    def __init__(self, sample: np.ndarray, leaf_size: int):
        self.centres = [sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1] if sample.ndim == 2 else 0)]
        self.children: list[tuple[int, int]] = [(0, 0)]
        open_nodes = [(0, sample)]
        draw = np.random.default_rng(7)
        while open_nodes:
            node, rows = open_nodes.pop(0)
            if len(rows) <= leaf_size:
                continue
            centres, nearest = lloyd(rows, BRANCHES, draw)
            if len(centres) < 2:
                continue
            self.children[node] = (len(self.centres), len(centres))
            for i, centre in enumerate(centres):
                self.centres.append(centre)
                self.children.append((0, 0))
                open_nodes.append((len(self.centres) - 1, rows[nearest == i]))
        self.centres = np.array(self.centres)
        leaves = [n for n, (_, many) in enumerate(self.children) if not many]
        self.leaf_of = {node: i for i, node in enumerate(leaves)}
        self.leaves = len(leaves)

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: nearest child centre at every level."""
        leaf = np.empty(len(rows), np.int64)
        waiting = [(0, np.arange(len(rows)))]
        while waiting:
            node, mine = waiting.pop()
            first, many = self.children[node]
            if not many:
                leaf[mine] = self.leaf_of[node]
                continue
            best = squared(rows[mine], self.centres[first:first + many]).argmin(axis=1)
            waiting += [(first + i, mine[best == i]) for i in range(many) if (best == i).any()]
        return leaf

    def best_bins(self, query: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order."""
        far = squared(query[None, :], self.centres)[0]
        queue = [(far[0], 0)]
        while queue:
            _, node = heapq.heappop(queue)
            first, many = self.children[node]
            if not many:
                yield self.leaf_of[node]
            for child in range(first, first + many):
                heapq.heappush(queue, (far[child], child))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)


def lloyd(rows: np.ndarray, k: int, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centres and nearest centre of each row; empty centres are dropped."""
    distinct = np.unique(rows, axis=0)
    centres = distinct[draw.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(ROUNDS):
        nearest = squared(rows, centres).argmin(axis=1)
        used = np.unique(nearest)
        centres = np.array([rows[nearest == i].mean(axis=0) for i in used])
    nearest = squared(rows, centres).argmin(axis=1)
    used, nearest = np.unique(nearest, return_inverse=True)
    return centres[used], nearest


def usable(vector: Column) -> Column:
    """Whether a vector has only finite components, not all zero."""
    big = float(np.finfo(np.float64).max)
    return (vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= F.lit(big)))
            & F.exists(vector, lambda x: x != 0))


def stack(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(np.float64) if len(series) else np.zeros((0, 0))


def nearest(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int,
            leaf: np.ndarray | None = None, visited: np.ndarray | None = None) -> pd.DataFrame:
    """The k nearest of ``rows`` to each query, exactly, without the query's own id; ties to smaller ids.

    With ``leaf`` of each row and ``visited`` (query by leaf), a query sees only rows of leaves it visits.

    Products screen the rows; all that could be among the k nearest within rounding are then
    measured by differences in double precision.
    """
    found = []
    norms = (rows * rows).sum(axis=1)
    step = max(1, CELLS // max(1, len(rows)))
    for at in range(0, len(queries), step):
        some, own = queries[at:at + step], query_ids[at:at + step]
        size = (some * some).sum(axis=1)
        rough = norms[None, :] + size[:, None] - 2 * (some @ rows.T)
        rough[own[:, None] == ids[None, :]] = np.inf
        if visited is not None:
            rough[~visited[at:at + step][:, leaf]] = np.inf
        edge = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(some), np.inf)
        slack = 1e-9 * (size + norms.max(initial=0))
        for i in range(len(some)):
            near = np.flatnonzero((rough[i] <= edge[i] + slack[i]) & np.isfinite(rough[i]))
            difference = rows[near] - some[i]
            score = np.sqrt((difference * difference).sum(axis=1))
            top = np.lexsort((ids[near], score))[:k]
            found.append((np.full(len(top), own[i]), ids[near][top], score[top], near[top]))
    if not found:
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0), "row": np.zeros(0, np.int64)})
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score", "row"), map(np.concatenate, zip(*found)))))


def grow(vectors: DataFrame, rows: int, dims: int) -> KMeansTree:
    """Fit the tree on at most ``SAMPLE`` rows drawn by a hash of vec_id."""
    picked = vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, rows // SAMPLE))) == 0).limit(SAMPLE)
    sample = stack(picked.toPandas().sort_values("vec_id")["embedding"]) if rows else np.zeros((0, dims))
    leaf_size = max(LEAST_SAMPLE, int(np.ceil(LEAF_ROWS * len(sample) / max(1, rows))))
    return KMeansTree(sample.reshape(len(sample), dims), leaf_size)


def calibrated_visits(tree: KMeansTree, index: DataFrame, known: pd.DataFrame, k: int, target: float) -> int:
    """Least number of leaves, best bin first, that holds ``target`` of the true neighbours of the calibration queries."""
    if tree.leaves < 2 or not len(known):
        return 1
    ids, queries = known["vec_id"].to_numpy(), stack(known["embedding"])

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for batch in batches:
            if not len(batch):
                continue
            top = nearest(batch["vec_id"].to_numpy(), stack(batch["embedding"]), ids, queries, k)
            top["leaf"] = batch["leaf"].to_numpy()[top["row"]]
            best = top if best is None else pd.concat([best, top])
            best = best.sort_values(["query_id", "score", "vec_id"]).groupby("query_id").head(k)
        if best is not None:
            yield best[["query_id", "vec_id", "score", "leaf"]]

    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    truth = (index.mapInPandas(brute, "query_id long, vec_id long, score double, leaf long")
             .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "leaf").toPandas())
    place = {q: {leaf: n for n, leaf in enumerate(tree.best_bins(v))} for q, v in zip(ids, queries)}
    needed = np.sort([place[q][leaf] + 1 for q, leaf in zip(truth["query_id"], truth["leaf"])])
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) if len(needed) else 1


def search(vectors: DataFrame, every: int = 100, k: int = 10, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row whose vec_id is divisible by ``every``.

    ``vectors`` has vec_id and embedding. Null, zero and non-finite vectors, null ids, and vectors of
    another length than most take no part. Equal distances go to the smaller vec_id; rows that repeat a
    vec_id are candidates each, but none for its own query, which asks with the least of its vectors. Fewer candidates than ``k`` give all of
    them; other columns are ignored; an empty table gives an empty result. Small leaves are compared
    together, so a query gets one short list from them; bins with many rows or many queries are cut
    into blocks, so no task holds a large leaf.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    lengths = rows.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    dims = lengths[0]["dims"] if lengths else 0
    rows = rows.filter(F.size("embedding") == dims)
    count = lengths[0]["count"] if lengths else 0
    tree = spark.sparkContext.broadcast(grow(rows, count, dims))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(leaf=tree.value.assign(stack(batch["embedding"])))

    index = staged(rows.mapInPandas(place, "vec_id long, embedding array<double>, leaf long"), "leaves")
    asked = index.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    known = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).toPandas()
    visits = calibrated_visits(tree.value, index, known, k, target)
    sizes = np.zeros(tree.value.leaves, np.int64)
    for leaf, many in index.groupBy("leaf").count().collect():
        sizes[leaf] = many
    bin_of = packed(sizes)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for query, vector in zip(batch["vec_id"], batch["embedding"]):
                held, by_bin = 0, {}
                for n, leaf in enumerate(tree.value.best_bins(np.asarray(vector, np.float64))):
                    if n >= visits and held > k:
                        break
                    held += int(sizes[leaf])
                    by_bin.setdefault(int(bin_of[leaf]), []).append(leaf)
                out += [(query, vector, at, leaves) for at, leaves in by_bin.items()]
            yield pd.DataFrame(out, columns=["query_id", "query", "bin", "leaves"])

    walked = staged(asked.select("vec_id", "embedding").mapInPandas(walk, "query_id long, query array<double>, bin int, leaves array<long>"), "visits")
    bins = int(bin_of.max(initial=-1)) + 1
    callers = np.zeros(bins, np.int64)
    for at, many in walked.groupBy("bin").count().collect():
        callers[at] = many
    counts = (np.bincount(bin_of, weights=sizes, minlength=bins).astype(np.int64), callers)
    parts = [F.array(*[F.lit(int(max(1, -(-n // size)))) for n in many]) if bins else F.array(F.lit(1))
             for many, size in zip(counts, (BLOCK_ROWS, BLOCK_QUERIES))]
    bin_column = F.get(F.array(*[F.lit(int(b)) for b in bin_of]), F.col("leaf").cast("int")) if bins else F.lit(0)

    def cell(own: int, key: str) -> tuple[Column, Column]:
        """Own block by hash, and a copy for each block of the other side."""
        mine = F.pmod(F.xxhash64(key), F.get(parts[own], F.col("bin"))).cast("int")
        others = F.explode(F.sequence(F.lit(0), F.get(parts[1 - own], F.col("bin")) - 1))
        return mine, others

    mine, others = cell(0, "vec_id")
    held = index.withColumn("bin", bin_column).select("bin", mine.alias("row_block"), others.alias("query_block"), "vec_id", "embedding", "leaf")
    mine, others = cell(1, "query_id")
    calls = walked.select("bin", mine.alias("query_block"), others.alias("row_block"), "query_id", "query", "leaves")
    keys = ["bin", "row_block", "query_block"]

    def compare(stored: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(stored) or not len(asking):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        names, leaf = np.unique(stored["leaf"].to_numpy(), return_inverse=True)
        visited = np.array([np.isin(names, leaves) for leaves in asking["leaves"]])
        return nearest(stored["vec_id"].to_numpy(), stack(stored["embedding"]), asking["query_id"].to_numpy(), stack(asking["query"]), k,
                       leaf, visited)[["query_id", "vec_id", "score"]]

    found = held.groupBy(*keys).cogroup(calls.groupBy(*keys)).applyInPandas(compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def packed(sizes: np.ndarray) -> np.ndarray:
    """A bin for each leaf: neighbouring leaves share one up to ``BLOCK_ROWS`` rows, a larger leaf has its own."""
    out, at, held = np.zeros(len(sizes), np.int64), 0, 0
    for leaf, size in enumerate(sizes.tolist()):
        if held and held + size > BLOCK_ROWS:
            at, held = at + 1, 0
        out[leaf] = at
        held += size
    return out
