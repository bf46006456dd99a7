"""Quality classifier by importance resampling.

Two generative models of hashed n-grams, one of target text (labelled good) and one of the raw
corpus, give each document the weight p_target / p_raw. Documents are sampled without replacement
in proportion to their weights by Gumbel top-k: the k largest of log-weight plus Gumbel noise. k is
the number of documents whose weight passes a threshold calibrated on labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from foliarc.llm.common import release_memory, staged, text_or_empty

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 1 << 15
LABELLED = 20_000  # labelled rows used at most, chosen by a hash of doc_id
CLEAN_RECALL = 0.995  # share of labelled good rows that the threshold keeps at least
SEED = 42
BINS = 4096
RANKED_AT_ONCE = 50_000

def grams(text: str) -> np.ndarray:
    """Buckets of the words and word pairs of the whole text; a word followed by itself is one pair for all words."""
    words = TOKEN.findall(text)
    one = np.array([crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (one[1:] + np.uint64(0x632BE59BD9B4E019))
    two[one[:-1] == one[1:]] = np.uint64(1)
    both = np.concatenate([one, two])
    both = (both ^ (both >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
    return (both >> np.uint64(40)).astype(np.int64) % BUCKETS


def model_counts(docs: DataFrame, good: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of the raw corpus and of the documents whose id is in ``good``; at most two rows a bucket reach the driver."""
    chosen = docs.sparkSession.sparkContext.broadcast(good)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for doc_id, text in zip(batch["id"], batch["text"]):
                found = np.bincount(grams(text), minlength=BUCKETS)
                raw += found
                if doc_id in chosen.value:
                    target += found
        yield pd.DataFrame({"bucket": np.arange(BUCKETS), "raw": raw, "target": target})
        release_memory()

    part = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), text_or_empty().alias("text"))
    sums = part.mapInPandas(count, "bucket int, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[sums["bucket"]], target[sums["bucket"]] = sums["raw"], sums["target"]
    return raw, target


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of smoothed target over smoothed raw probability per bucket."""
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def log_weight(text: Column, ratio) -> Column:
    @F.pandas_udf(DoubleType())
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([float(ratio.value[grams(t)].sum()) for t in batch], dtype="float64")
        release_memory()

    return weigh(text)


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise of a key."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 12).cast("double")
    return -F.log(-F.log((bits + F.lit(0.5)) / F.lit(2.0 ** 52)))


def threshold(scores: pd.DataFrame, recall: float) -> float:
    """The log-weight that best parts good from bad labelled rows while ``recall`` of the good ones pass."""
    good, bad = (np.sort(scores.loc[scores["quality"] == q, "log_weight"].to_numpy()) for q in (1, 0))
    if not len(good) or not len(bad):
        return -np.inf
    cuts = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2])
    lost = np.searchsorted(good, cuts) / len(good)
    caught = np.searchsorted(bad, cuts) / len(bad)
    return float(cuts[np.argmax(np.where(lost <= 1 - recall, caught - lost, -1.0))])


def top_k(scored: DataFrame, key: str, tie: str, k: int) -> DataFrame:
    """Add ``kept``: whether a row is among the ``k`` largest by ``key`` (ties by ``tie``).

    Histograms close in on the k-th key, so the driver sees bin counts only and just the rows of
    the last bin are ranked.
    """
    low, high = scored.agg(F.min(key), F.max(key)).first()
    if low is None or k <= 0:
        return scored.withColumn("kept", F.lit(False))
    need, inside = k, scored
    while True:
        width = (high - low) / BINS
        if not width > 0 or low + width == low:
            break
        at = F.least(F.floor((F.col(key) - low) / width), F.lit(BINS - 1)).cast("int")
        counts = dict(inside.groupBy(at.alias("bin")).count().collect())
        below = need
        for chosen in sorted(counts, reverse=True):
            if below <= counts[chosen]:
                break
            below -= counts[chosen]
        else:
            return scored.withColumn("kept", F.lit(True))
        rows = counts[chosen]
        edges = inside.filter(at == chosen).agg(F.min(key), F.max(key)).first()
        need, (low, high) = below, edges
        inside = scored.filter(F.col(key).between(low, high))
        if rows <= RANKED_AT_ONCE:
            break
    border = F.col(key).between(F.lit(low), F.lit(high))
    order = Window.partitionBy("__border").orderBy(F.desc(key), tie)
    ranked = scored.filter(border).withColumn("__border", F.lit(1)).withColumn("__rank", F.row_number().over(order))
    decided = scored.filter(~border).withColumn("kept", F.col(key) > F.lit(high))
    return decided.unionByName(ranked.withColumn("kept", F.col("__rank") <= need).drop("__border", "__rank"))


def resample(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, recall: float = CLEAN_RECALL, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, key, kept of each row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, quality) names good (1) and bad (0) rows; at most ``labelled`` of them are
    used, all documents count for the raw model. Null and empty texts have weight one (log 0).
    Without both kinds of labels everything is kept. Repeated rows get equal keys; null ids share
    one noise value; other columns are ignored; an empty table gives an empty result.
    """
    chosen = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).toPandas()
    raw, target = model_counts(docs, set(chosen.loc[chosen["quality"] == 1, "doc_id"].astype(int).tolist()))
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratio(raw, target) if target.sum() else np.zeros(BUCKETS))
    scored = docs.select("doc_id", log_weight(text_or_empty(), ratio).alias("log_weight"))
    scored = staged(scored.withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"), seed)), "weights")
    if len(chosen):
        known = docs.sparkSession.createDataFrame(chosen.astype({"doc_id": "int64", "quality": "int32"}))
        calibration = scored.join(F.broadcast(known), "doc_id").select("quality", "log_weight").limit(2 * labelled).toPandas()
        least = threshold(calibration, recall)
    else:
        least = -np.inf
    k = scored.filter(F.col("log_weight") >= F.lit(float(least))).count()
    return top_k(scored, "key", "doc_id", k)


def kept_documents(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, recall: float = CLEAN_RECALL, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that the resampling keeps, all columns. Ties of one doc_id are kept or dropped together.

    Only the rejected ids are joined back, so texts meet a narrow table once.
    """
    decided = resample(docs, labels, labelled, recall, seed)
    kept = decided.groupBy("doc_id").agg(F.max("kept").alias("__kept")).filter("not __kept").select(F.col("doc_id").alias("__out"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__out")), "left_anti")
