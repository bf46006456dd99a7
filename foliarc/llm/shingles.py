"""Near duplicates: SimHash fingerprints meet in vantage-point trees, exact word-shingle similarity decides.

Texts first meet by the SimHash of their shingle set, through the trees of ``simhash``. Fingerprints alone miss most
pairs near ``least`` and may link others, so two exact steps follow. Every pair is compared shingle by shingle, and
pairs the fingerprints leave apart meet by heads: two sets that share ``least`` of their union share a shingle among
the first n - ceil(least * n) + 1 of each, in any order common to all sets. Pairs that size, position or a parity
sketch rule out are dropped, so no similar pair is missed and none is linked by chance. The order puts frequent
shingles last; how frequent a shingle is comes from every third text and a table of fixed size, which shapes the
work, not the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliarc.llm.common import discard, partitions, release_memory, staged, text_or_empty
from foliarc.llm.simhash import PAIRS_AT_ONCE, SEED, components, grouped_prints, merge_labels
from foliarc.llm.suffix_dedup import whole_groups
from foliarc.session import fits_broadcast

SHARE = 3  # one text in so many tells which shingles are frequent
FREQUENT = 3
CELL_BITS = 22
ROWS_AT_ONCE = 512
SKETCH_WORDS = 4  # 256 bits of parity
# Slack of the filters against rounding; the comparison itself has none.
SLACK = 1e-6
MULTIPLIER, MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, a wordless one none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    hashed = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    mixed = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        mixed = mixed * MULTIPLIER + hashed[k:k + len(mixed)]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * MIXER
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def set_key(shingles: np.ndarray) -> int:
    """Signed digest that names a set; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64)) if len(shingles) else 0


def head(shingles: np.ndarray, levels: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a set, rare ones first: any set as similar as ``least`` shares one of its own head."""
    n = len(shingles)
    level = levels[(shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
    return shingles[np.lexsort((shingles, level))][:n - int(np.ceil(least * n - SLACK)) + 1]


def simhash(shingles: np.ndarray) -> int:
    """Signed fingerprint: a bit is set if over half of the shingles set it; 0 for the empty set."""
    if not len(shingles):
        return 0
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(shingles), bitorder="little").view("<i8")[0])


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of 64 * SKETCH_WORDS cells.

    Each shingle that only one of two sets holds flips one bit, so their sketches differ in no more bits than the
    sets in shingles.
    """
    cells = np.bincount((shingles & np.uint64(64 * SKETCH_WORDS - 1)).astype(np.int64), minlength=64 * SKETCH_WORDS)
    return np.packbits((cells & 1).astype(np.uint8), bitorder="little").view("<i8")


def mark() -> Column:
    """Names a text without moving it."""
    return F.xxhash64(text_or_empty())


def frequent(docs: DataFrame, width: int) -> np.ndarray:
    """A level for each cell of shingle hashes: twice the log of the count of its most frequent shingle, 0 if all are rare.

    Shingles of one text in ``SHARE`` are counted; a cell for each of 2^CELL_BITS hash prefixes comes to the driver.
    """
    texts = docs.filter(F.pmod(mark(), F.lit(SHARE)) == 0).select(text_or_empty().alias("text"))

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                tokens = np.concatenate([shingle_set(t, width) for t in batch["text"].iloc[at:at + ROWS_AT_ONCE]])
                token, n = np.unique(tokens, return_counts=True)
                yield pd.DataFrame({"token": token.view(np.int64), "n": n})
        release_memory()

    counts = texts.mapInPandas(listed, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    level = F.least(F.ceil(F.log2("n") * 2), F.lit(255)).cast("int")
    cells = counts.groupBy(F.shiftrightunsigned("token", 64 - CELL_BITS).cast("int").alias("cell")).agg(F.max(level).alias("level")).toPandas()
    levels = np.zeros(1 << CELL_BITS, np.uint8)
    levels[cells["cell"].to_numpy(np.int64)] = cells["level"].to_numpy(np.uint8)
    return levels


def headed(text: Column, width: int, least: float, order) -> Column:
    """Structs (key, n, fp, sketch, head) of texts."""

    @F.pandas_udf("key long, n long, fp long, sketch array<long>, head array<long>")
    def heads(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        levels = order.value
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                sets = [shingle_set(t, width) for t in batch.iloc[at:at + ROWS_AT_ONCE]]
                yield pd.DataFrame({"key": [set_key(s) for s in sets], "n": [len(s) for s in sets],
                                    "fp": [simhash(s) for s in sets], "sketch": [sketch(s) for s in sets],
                                    "head": [head(s, levels, least).view(np.int64) for s in sets]})
        release_memory()

    return heads(text)


def rows_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``docs`` with the doc_id and mark of a row of ``wanted``, and its other columns.

    The names are broadcast where their counted size allows it, so texts stay where they are.
    """
    names = wanted.withColumnsRenamed({"doc_id": "__id", "mark": "__mark"})
    names = F.broadcast(names) if fits_broadcast(names, 64) else names
    rows = docs.withColumn("__own", mark())
    return rows.join(names, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__mark"))).drop("__id", "__mark", "__own")


def compared(width: int, least: float):
    """The pairs of texts whose sets are similar; one side's set is kept while its rows follow each other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, held = None, None
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for row, (b, one, two) in enumerate(zip(batch["b"], batch["text_a"], batch["text_b"])):
                if name != b:
                    name, held = b, shingle_set(two, width)
                own = shingle_set(one, width)
                common = len(np.intersect1d(own, held, assume_unique=True))
                keep[row] = common >= least * (len(own) + len(held) - common)
            yield batch.loc[keep, ["a", "b"]]
        release_memory()

    return run


def possible(n_a, at_a, n_b, at_b, least: float):
    """Whether two sets whose first common shingle has these places can be as similar as ``least``."""
    return np.minimum(n_a - at_a, n_b - at_b) >= least / (1 + least) * (n_a + n_b) - SLACK


def pairs_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, the smaller key first."""
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return both[:, 0], both[:, 1]


MET = "a long, token long, n long, at long"
PLACE_BITS = 32  # a row carries size and place of its shingle in one number


def split_place(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return place >> PLACE_BITS, place & ((1 << PLACE_BITS) - 1)


def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of sets that follow each other in one group of fingerprints; rows come by group."""
    for batch in batches:
        root, key = batch["root"].to_numpy(), batch["key"].to_numpy()
        one = np.flatnonzero((root[1:] == root[:-1]) & (key[1:] != key[:-1]))
        if len(one):
            a, b = pairs_of(key[one], key[one + 1])
            yield pd.DataFrame({"a": a, "b": b})


def fingerprint_pairs(heads: DataFrame) -> DataFrame:
    """(a, b): sets whose fingerprints the vantage-point trees put into one component, each with the next one of it.

    A component is laid out by range, so one of any size is spread over the tasks.
    """
    order = ["root", "fp", "n", "key"]
    named = heads.select("key", "n", "fp").distinct().join(grouped_prints(heads.select("fp")), "fp").select(*order)
    laid = named.repartitionByRange(partitions(heads.sparkSession), *order).sortWithinPartitions(*order)
    return laid.mapInPandas(chained, "a long, b long").distinct()


def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of shingles that two sets or more have in their heads."""
    for batch in whole_groups(batches, "token"):
        token, key, place = (batch[c].to_numpy() for c in ("token", "key", "place"))
        first = np.append(True, (token[1:] != token[:-1]) | (key[1:] != key[:-1]))  # equal sets of different texts
        token, key, (n, at) = token[first], key[first], split_place(place[first])
        size = np.diff(np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token)))
        many = np.repeat(size >= 2, size)
        if many.any():
            yield pd.DataFrame({"a": key[many], "token": token[many], "n": n[many], "at": at[many]})


def crossing(least: float, nearest: bool):
    """Possible pairs under one shingle whose sets are not joined yet; rows come by shingle and size.

    With ``nearest`` each set gets only the one with the nearest sketch, and what such a pair would join
    gets no further pair from the same batch: few pairs that join most of what is similar.
    """
    share = (1 - least) / (1 + least)  # of both sizes, at most so much is in one set only

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in whole_groups(batches, "token"):
            token, key, n, at = (batch[c].to_numpy() for c in ("token", "a", "n", "at"))
            bits = np.stack([batch[f"s{k}"].to_numpy() for k in range(SKETCH_WORDS)]).view(np.uint64)
            names, root = np.unique(batch["root"].to_numpy(), return_inverse=True)
            labels = np.arange(len(names))
            edge = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            stop = np.append(edge[1:], len(token))
            one, two, held = [], [], 0
            for first, last in zip(edge, stop):
                own = labels[root[first:last]]
                if (own == own[0]).all():
                    continue
                lows = first + np.searchsorted(n[first:last], least * n[first:last] - SLACK)
                row = first
                while row < last:
                    low = lows[row - first]
                    span = int(row - low)
                    until = min(last, row + max(1, int(((span * span + PAIRS_AT_ONCE) ** 0.5 - span) / 2)))
                    i, j = np.arange(row, until)[:, None], np.arange(low, until)[None, :]
                    hit = (j < i) & (labels[root[i]] != labels[root[j]]) & possible(n[i], at[i], n[j], at[j], least)
                    x, y = np.nonzero(hit)
                    apart = np.zeros(len(x), np.int64)
                    for word in bits:
                        apart += np.bitwise_count(word[row + x] ^ word[low + y])
                    near = apart <= share * (n[row + x] + n[low + y]) + SLACK
                    x, y, apart = x[near], y[near], apart[near]
                    if nearest and len(x):
                        by = np.lexsort((y, apart, x))
                        by = by[np.append(True, x[by][1:] != x[by][:-1])]
                        x, y = x[by], y[by]
                        labels = merge_labels(labels, root[row + x], root[low + y])
                    one.append(key[row + x])
                    two.append(key[low + y])
                    held += len(x)
                    if held > PAIRS_AT_ONCE:
                        a, b = pairs_of(np.concatenate(one), np.concatenate(two))
                        yield pd.DataFrame({"a": a, "b": b})
                        one, two, held = [], [], 0
                    row = until
            if held:
                a, b = pairs_of(np.concatenate(one), np.concatenate(two))
                yield pd.DataFrame({"a": a, "b": b})
        release_memory()

    return run


def crossing_pairs(met: DataFrame, sketches: DataFrame, links: DataFrame, least: float, nearest: bool) -> DataFrame:
    """(a, b): possible pairs of ``met`` whose sets ``links`` leave apart."""
    roots = components(links)
    named = sketches.join(roots, F.col("key") == F.col("node"), "left").select(
        F.col("key").alias("a"), F.coalesce("root", "key").alias("root"), *[f"s{k}" for k in range(SKETCH_WORDS)])
    rows = met.join(named, "a").repartition(partitions(met.sparkSession), "token").sortWithinPartitions("token", "n", "a")
    return rows.mapInPandas(crossing(least, nearest), "a long, b long").distinct()


def similar(docs: DataFrame, pairs: DataFrame, holders: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) of set keys whose Jaccard similarity is at least ``least``; only their texts are read again."""
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    held = holders.join(wanted, "key").select("key", "doc_id", "mark").withColumnRenamed("key", "__key")
    texts = rows_of(docs.select("doc_id", F.col("text")), held).groupBy(F.col("__key").alias("key")).agg(F.first("text").alias("text"))
    one, two = (texts.select(F.col("key").alias(f"key_{side}"), F.coalesce("text", F.lit("")).alias(f"text_{side}")) for side in "ab")
    met = pairs.join(one, F.col("a") == F.col("key_a")).join(two, F.col("b") == F.col("key_b"))
    return met.select("a", "b", "text_a", "text_b").mapInPandas(compared(width, least), "a long, b long")


def one_of_each_similar(docs: DataFrame, width: int, least: float) -> DataFrame:
    """The row of ``docs`` with the smallest doc_id of each component, all columns; of equal rows one.

    Texts are linked if their sets of ``width``-word shingles have a Jaccard similarity of at least ``least``;
    wordless and null texts are linked with each other. Null ids come last. Sets whose fingerprints meet are
    compared first, then for each set the one with the nearest sketch among those that share a shingle of its
    head, then every possible pair that those links leave apart. Large tables written on the way are deleted
    once read.
    """
    own, spark = docs.columns, docs.sparkSession
    order = spark.sparkContext.broadcast(frequent(docs, width))
    ranked = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("mark").alias("mark"), F.col("many").alias("many"))
    rows = docs.select("doc_id", mark().alias("mark")).groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("many"))
    texts = staged(rows.groupBy("mark").agg(F.min(ranked).alias("best")).select("best.doc_id", "best.mark", "best.many"), "texts")
    first = rows_of(docs.select("doc_id", "text"), texts.select("doc_id", "mark"))
    heads = staged(first.select(mark().alias("mark"), headed(text_or_empty(), width, least, order).alias("set")), "heads").select("mark", "set.*")
    holders = heads.select("mark", "key").join(texts, "mark").groupBy("key").agg(F.min(ranked).alias("best"))
    holders = staged(holders.select("key", "best.doc_id", "best.mark", "best.many"), "holders")
    discard(texts)
    place = F.shiftleft("n", PLACE_BITS).bitwiseOR(F.col("at"))
    tokens = heads.select("key", "n", F.posexplode("head").alias("at", "token")).select("token", place.alias("place"), "key")
    sketches = staged(heads.groupBy("key").agg(F.first("sketch").alias("sketch")).select(
        "key", *[F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH_WORDS)]), "sketches")
    ordered = tokens.repartition(partitions(spark), "token").sortWithinPartitions("token", F.shiftright("place", PLACE_BITS), "key")
    met = staged(ordered.mapInPandas(shared, MET), "met")
    tried = staged(fingerprint_pairs(heads), "near")
    discard(heads)
    links = staged(similar(docs, tried, holders, width, least), "links")
    for nearest in (True, False):
        found = staged(crossing_pairs(met, sketches, links, least, nearest).join(tried, ["a", "b"], "left_anti"), "far")
        tried = tried.unionByName(found)
        links = links.unionByName(staged(similar(docs, found, holders, width, least), "links"))
    discard(met, sketches)
    roots = components(links)
    named = holders.join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))
    chosen = staged(named.groupBy("root").agg(F.min(ranked).alias("best")).select("best.doc_id", "best.mark", F.col("best.many").alias("__many")), "chosen")
    columns = [F.col(f"`{c}`") for c in own]
    single = rows_of(docs, chosen.filter("__many = 1")).select(*columns)
    repeated = rows_of(docs, chosen.filter("__many > 1")).withColumn("__mark", mark())
    place = F.row_number().over(Window.partitionBy("doc_id", "__mark").orderBy("__mark"))
    return single.unionByName(repeated.withColumn("__n", place).filter("__n = 1").select(*columns))
