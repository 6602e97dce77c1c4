"""Sharding by a hierarchical weighted hash tree (operator 7).

Keys descend region, rack and shard levels.  At each level every child gets a hash
draw of its own, -ln(u) / weight, and the least wins, so children receive keys in
proportion to their weights, and a changed weight moves keys only between that child
and its siblings.  A new shard is a region of its own: keys move only into it.

Slots are gapless within a shard without gathering a shard in one task: rows are
counted per (shard, bucket), the counts are summed over the buckets, and each bucket
numbers its own rows.  Equal rows are counted first and expanded last, so no group
of copies meets in one task.

Defined results: a null text has size 16 and crc 0; a null key is a key of its own.
Repeated rows get slots of their own, in ties by what their columns hold.  Empty and very
long texts count by their bytes.  An empty table gives an empty result.  Extra columns,
whatever their names, are ignored by the digest; they pass through ``with_shard``, which
replaces a column of its result's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

SHARDS_PER_RACK, RACKS_PER_REGION = 5, 4
#: Buckets of a shard that are numbered apart.
BUCKETS = 1024
#: Counts of buckets that are broadcast, at most; more are joined by a shuffle.
MOST_COUNTS = 1 << 20
#: Copies of an equal row that are written in one go; where some row has more, lots are dealt out to tasks.
LOT = 1000

Tree = list[list[list[tuple[int, float]]]]


def hash_tree(base: int, added: int = 0) -> Tree:
    """Regions of racks of (shard, weight): ``base`` shards packed in order, then one region for each added shard."""
    racks = [[(s, 1.0) for s in range(i, min(i + SHARDS_PER_RACK, base))] for i in range(0, base, SHARDS_PER_RACK)]
    regions = [racks[i : i + RACKS_PER_REGION] for i in range(0, len(racks), RACKS_PER_REGION)]
    return regions + [[[(base + k, 1.0)]] for k in range(added)]


def _drawn(key: Column, name: str, weights: list[float]) -> Column:
    """Index of the child with the least weighted draw; each draw depends on the key and the child alone."""
    if len(weights) == 1:
        return F.lit(0)
    draws = []
    for child, weight in enumerate(weights):
        if weight <= 0:
            continue
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(f"{name}/{child}"), key), 11)
        draws.append(F.struct((-F.log((bits + 0.5) / float(1 << 53)) / F.lit(float(weight))).alias("draw"), F.lit(child).alias("child")))
    return F.array_min(F.array(*draws)).getField("child")


def tree_shard(key: Column, tree: Tree) -> Column:
    """The shard of ``key``: a draw among regions, then among its racks, then among its shards."""

    def at(index: Column, options: list[Column]) -> Column:
        return options[0] if len(options) == 1 else F.element_at(F.array(*options), index + 1)

    def of_rack(name: str, rack: list[tuple[int, float]]) -> Column:
        return at(_drawn(key, name, [w for _, w in rack]), [F.lit(s) for s, _ in rack])

    def of_region(name: str, region: list[list[tuple[int, float]]]) -> Column:
        drawn = _drawn(key, name, [sum(w for _, w in rack) for rack in region])
        chosen = of_rack(f"{name}/0", region[0])
        for i, rack in enumerate(region[1:], 1):
            chosen = F.when(drawn == i, of_rack(f"{name}/{i}", rack)).otherwise(chosen)
        return chosen

    drawn = _drawn(key, "root", [sum(w for rack in region for _, w in rack) for region in tree])
    chosen = of_region("root/0", tree[0])
    for i, region in enumerate(tree[1:], 1):
        chosen = F.when(drawn == i, of_region(f"root/{i}", region)).otherwise(chosen)
    return chosen


def with_shard(df: DataFrame, shards: int, key: str = "doc_id", added: int = 0, to: str = "shard") -> DataFrame:
    """``df`` with the shard of each row, of ``shards`` packed ones and ``added`` later ones."""
    return df.withColumn(to, tree_shard(F.col(key), hash_tree(shards, added)))


def with_slots(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, 2 ... within each shard."""
    equal = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_copies"))
    equal = staged(equal.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(BUCKETS)).cast("int")), "slots")
    counts = staged(equal.groupBy(shard, "_bucket").agg(F.sum("_copies").alias("_n")), "bucket-counts")
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col(shard).alias("_shard"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(shard, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = equal.withColumn("_inside", F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
    few = counts.count() <= MOST_COUNTS
    placed = placed.join(F.broadcast(first) if few else first, (F.col(shard) == F.col("_shard")) & (F.col("_bucket") == F.col("_b")))
    lots = placed.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_copies - 1) div {LOT}"))))
    if (equal.agg(F.max("_copies")).first()[0] or 0) > LOT:
        lots = lots.repartition(F.col(shard), F.col("_bucket"), F.col("_lot"))
    numbered = lots.withColumn("_copy", F.explode(F.sequence(F.col("_lot") * LOT, F.least(F.col("_lot") * LOT + LOT, F.col("_copies")) - 1)))
    return numbered.withColumn("slot", F.col("_first") + F.col("_inside") + F.col("_copy")).select(*rows.columns, "slot")


def shard_digest(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    body = F.col(text).cast("string").cast("binary")
    size = F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + 16
    rows = docs.select(
        F.col(doc_id),
        size.alias("size"),
        F.crc32(F.coalesce(body, F.lit(b""))).cast("long").alias("text_crc32"),
        tree_shard(F.col(doc_id), hash_tree(shards)).alias("shard"),
        tree_shard(F.col(doc_id), hash_tree(shards, 1)).alias("grown_shard"),
    )
    numbered = with_slots(rows, "shard", [doc_id, "size", "text_crc32"])
    return numbered.select(doc_id, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
