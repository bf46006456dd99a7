"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Each source may be repeated at most ``epochs`` times. A source whose weighted share exceeds that
cap is clamped, and the excess goes to the others in proportion to their weights until none is
above. Sources sorted by cap per weight fill in that order, so the fixed point is found by one
pass of running sums instead of rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 42
BLOCK_DIGITS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Targets of sources (source, source_size); one row per source, so the windows here are small.

    Weights repeat over the sources in code-point order, null last. The whole of all sizes is
    shared; with epochs >= 1 that is always feasible.
    """
    whole = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("weight", F.get(cycle, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * epochs)
    filling = Window.orderBy((F.col("cap").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (ranked.withColumn("total", F.sum("source_size").over(whole))
              .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(earlier), F.lit(0)))
              .withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))))
    # A source is clamped where its share of what is left would exceed its cap; all before it are clamped too.
    full = F.col("left") * F.col("weight") > F.col("cap") * F.col("open")
    ranked = ranked.withColumn("full", full)
    level = F.first(F.when(~F.col("full"), F.struct("left", "open")), ignorenulls=True).over(
        filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    shared = F.col("weight") * F.col("level.left").cast("double") / F.col("level.open")
    return (ranked.withColumn("level", level)
            .select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(shared).alias("target")))


def shares(rows: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Add source_size, target and taken to ``rows`` (doc_id, source, size, ...).

    Every document is taken as often as its source's target holds the source whole. The rest of
    the target is filled in the order of a seeded digest of doc_id: documents before the mark once
    more, the one at the mark for the words still missing. A source is cut into digest blocks; the
    blocks' sums give each block its start, so no task holds a source.
    """
    keyed = rows.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).cast("binary")))
    keyed = keyed.withColumn("__block", F.substring("__h", 1, BLOCK_DIGITS))
    blocks = keyed.groupBy("source", "__block").agg(F.sum("size").alias("__sum"))
    targets = water_fill(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("__whole", whole)
    rest = F.round(F.col("target") - F.col("__whole") * F.col("source_size")).cast("long")
    targets = targets.withColumn("__rest", rest)
    before = Window.partitionBy("source").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__start", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    b, t = blocks.alias("b"), targets.alias("t")
    guide = b.join(t, F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        F.col("b.source").alias("__source"), F.col("b.__block").alias("__at"), "__start", "source_size", "target", "__whole", "__rest")
    joined = keyed.join(guide, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__block") == F.col("__at")))
    inside = Window.partitionBy("source", "__block").orderBy("__h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.col("__start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    joined = joined.withColumn("__part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("__rest") - passed)))
    return (joined.withColumn("taken", F.col("__whole") * F.col("size") + F.col("__part"))
            .drop("__h", "__block", "__source", "__at", "__start"))


def mix(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of ``docs`` (doc_id, text, source).

    Null and empty texts have size 0 and are taken 0 words; a null source is a source; repeated rows
    count each; a null doc_id sorts first among equal digests. Other columns are ignored and an empty table
    gives an empty result. Reruns agree: nothing but the seed and doc_id orders documents.
    """
    rows = docs.select("doc_id", "source", words(F.col("text")).alias("size"))
    return shares(rows, seed, weights, epochs).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``docs`` with each row as often as the mix takes it whole: repeated, once, or not at all.

    Texts are never cut here: the document at a source's mark is taken once more if at least half
    of it is due. Rows without a word weigh nothing and stay once. All columns are returned.
    """
    own = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row"), "doc_id", "source", words(F.col("text")).alias("size"))
    taken = shares(rows, seed, weights, epochs)
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("__whole") + F.when(F.col("__part") * 2 >= F.col("size"), 1).otherwise(0))
    return (taken.withColumn("__times", times.cast("int")).filter(F.col("__times") > 0)
            .select("__row", F.explode(F.array_repeat(F.lit(1), F.col("__times"))).alias("__copy")).select("__row.*"))
