"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard. At each level every child draws ``-ln(u) / weight`` with
``u`` hashed from the key and the child's name, and the smallest draw wins: a child is chosen in
proportion to its weight, and changing one weight moves keys only into or out of that child. Since
an inner node weighs as much as its shards, movement stays inside the subtrees whose weights
change. A shard added as a region of its own changes no other weight, so it takes rows only into
itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliarc.llm.common import partitions, text_or_empty

# Region name -> rack name -> shard id -> weight.
Tree = dict[str, dict[str, dict[int, float]]]

ROW_OVERHEAD = 16


def tree_of(shards: int, base: int = 40, racks: int = 8, racks_a_region: int = 2) -> Tree:
    """The tree that a shard count stands for: the first ``base`` shards in equal racks, later ones as regions of their own."""
    tree: Tree = {}
    for shard in range(min(shards, base)):
        rack = shard * racks // base
        tree.setdefault(f"region{rack // racks_a_region}", {}).setdefault(f"rack{rack}", {})[shard] = 1.0
    for shard in range(base, shards):
        tree[f"region-of-{shard}"] = {f"rack-of-{shard}": {shard: 1.0}}
    return tree


def draw(key: Column, child: Column) -> Column:
    """Exponential draw of one child for a key; smaller wins. 52 bits of an MD5 digest make ``u`` in (0, 1)."""
    digest = F.md5(F.concat_ws("/", key, child["name"]).cast("binary"))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(2.0 ** 52)) / child["weight"]


def siblings(weights: dict[str, float]) -> Column:
    """The children of one node as an array constant. Children without weight take no part."""
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(i).alias("place"))
                     for i, (n, w) in enumerate(weights.items()) if w > 0])


def choose(key: Column, children: Column) -> Column:
    """Place of the winning child among its siblings."""
    return F.array_min(F.transform(children, lambda c: F.struct(draw(key, c).alias("draw"), c["place"].alias("place"))))["place"]


def descend(rows: DataFrame, key: Column, tree: Tree, out: str) -> DataFrame:
    """Add the shard id of ``key`` as column ``out``: one weighted draw among siblings at each level."""
    racks = [{name: sum(shards.values()) for name, shards in region.items()} for region in tree.values()]
    leaves = [[list(shards) for shards in region.values()] for region in tree.values()]
    regions = siblings({name: sum(inner.values()) for name, inner in zip(tree, racks)})
    by_region = F.array(*[siblings(inner) for inner in racks])
    by_rack = F.array(*[F.array(*[siblings({f"shard{s}": w for s, w in shards.items()}) for shards in region.values()]) for region in tree.values()])
    ids = F.array(*[F.array(*[F.array(*map(F.lit, shards)) for shards in region]) for region in leaves])
    region, rack, leaf = F.col("__region"), F.col("__rack"), F.col("__leaf")
    step = rows.withColumn("__region", choose(key, regions))
    step = step.withColumn("__rack", choose(key, F.get(by_region, region)))
    step = step.withColumn("__leaf", choose(key, F.get(F.get(by_rack, region), rack)))
    return step.withColumn(out, F.get(F.get(F.get(ids, region), rack), leaf).cast("int")).drop("__region", "__rack", "__leaf")


def gapless_slots(rows: DataFrame, group: str, order: list[str], out: str = "slot") -> DataFrame:
    """Number the rows of each group from 0 without gaps, in ``order``.

    A group is cut into as many hash blocks as the session has shuffle partitions; rows are
    numbered inside a block and shifted by the sizes of the blocks before, so no task holds a group.
    """
    blocks = partitions(rows.sparkSession)
    spread = rows.withColumn("__block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    sizes = spread.groupBy(group, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(group, "__block").orderBy(*order)
    numbered = spread.withColumn("__at", F.row_number().over(inside) - 1)
    return (numbered.join(starts, [group, "__block"])
            .withColumn(out, (F.col("__start") + F.col("__at")).cast("long")).drop("__block", "__start", "__at", "__n"))


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of ``docs`` (doc_id, text).

    Law ``key``: doc_id and the shard count decide. The tree is laid out for up to 40 shards in equal racks; a
    ``grown_shard`` is a region of its own beside that tree, whatever ``shards`` is. ``size`` is the text's UTF-8 bytes plus 16
    (null text: 16, checksum of no bytes). A null doc_id is one key of its own. Repeated rows keep one
    slot each; other columns are ignored; an empty table gives an empty result.
    """
    text = text_or_empty()
    rows = docs.select("doc_id", (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    base = min(shards, 40)
    placed = descend(rows.withColumn("law", F.lit("key")), key, tree_of(shards, base), "shard")
    placed = descend(placed, key, tree_of(shards + 1, base), "grown_shard")
    slots = gapless_slots(placed, "shard", ["doc_id", "text_crc32", "size"])
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
