"""Presence, filling, overriding and indexing of blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the mask offset of a block that isn't recorded.
ABSENT = 4294967295


def present(offset: Column) -> Column:
    """Whether a mask offset stands for a recorded block; no mask means that all are."""
    return offset.isNull() | (offset != ABSENT)


def full_grid(images: DataFrame, keys: Sequence[str], rows: str, cols: str) -> DataFrame:
    """Every (br, bc) of the block grids of the images."""
    placed = images.select(*keys, rows, cols).withColumn("br", F.explode(F.sequence(F.lit(0), F.col(rows) - 1)))
    return placed.withColumn("bc", F.explode(F.sequence(F.lit(0), F.col(cols) - 1))).select(*keys, "br", "bc")


def filled(grid: DataFrame, blocks: DataFrame, on: Sequence[str], value: str, pad) -> DataFrame:
    """The grid with the blocks' values; missing ones hold the pad value."""
    return grid.join(blocks.select(*on, value), list(on), "left").withColumn(value, F.coalesce(value, F.lit(pad)))


def missing(grid: DataFrame, blocks: DataFrame, on: Sequence[str]) -> DataFrame:
    return grid.join(blocks, list(on), "left_anti")


def overridden(source: DataFrame, local: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Source blocks, with local ones in their place or beside them."""
    both = source.select(*on, F.col(value).alias("_source")).join(local.select(*on, F.col(value).alias("_local")), list(on), "full")
    return both.select(*on, F.coalesce("_local", "_source").alias(value), F.col("_local").isNotNull().alias("local"))


def latest(blocks: DataFrame, on: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """The last written block of each place."""
    return blocks.groupBy(*on).agg(F.max_by(F.struct(*values), order).alias("_last")).select(*on, "_last.*")


def completeness(blocks: DataFrame, keys: Sequence[str], expected: Column, on: Sequence[str] = ("br", "bc")) -> DataFrame:
    """Different blocks of each image, and whether they are as many as its grid has."""
    return blocks.groupBy(*keys).agg(F.count_distinct(*on).alias("blocks"), expected.alias("expected")).withColumn("complete", F.col("blocks") == F.col("expected"))


def tile_parts(parts: DataFrame, keys: Sequence[str], order: str, offset: str, length: str) -> DataFrame:
    """Byte ranges of each tile in codestream order."""
    ranges = F.array_sort(F.collect_list(F.struct(F.col(order).alias("place"), F.col(offset).alias("off"), F.col(length).alias("len"))))
    return parts.groupBy(*keys).agg(ranges.alias("ranges")).withColumn("ranges", F.transform("ranges", lambda r: F.struct(r["off"].alias("off"), r["len"].alias("len"))))


def contiguous(ranges: Column) -> Column:
    """Whether each range ends where the next begins."""
    return F.forall(F.sequence(F.lit(1), F.size(ranges)), lambda i: (i == F.size(ranges)) | (F.get(ranges, i - 1)["off"] + F.get(ranges, i - 1)["len"] == F.get(ranges, i)["off"]))


def merged(ranges: Column) -> Column:
    """Contiguous ranges as one; others as they are."""
    one = F.array(F.struct(ranges[0]["off"].alias("off"), F.aggregate(ranges, F.lit(0).cast("bigint"), lambda a, r: a + r["len"]).alias("len")))
    return F.when(contiguous(ranges), one).otherwise(ranges)


def manifest_shape(index: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shape of each image's chunk grid."""
    return index.groupBy(*keys).agg((F.max("br") + 1).alias("rows"), (F.max("bc") + 1).alias("cols"), F.count(F.lit(1)).alias("chunks"))


def chunk_key(*parts: Column) -> Column:
    """Chunk key 0.row.col."""
    return F.concat_ws(".", F.lit("0"), *[p.cast("string") for p in parts])


def level_scale(levels: DataFrame, keys: Sequence[str], level: str, size: str) -> DataFrame:
    """Ratio of each level's size to the level before; the first has 1."""
    before = F.lag(size).over(Window.partitionBy(*keys).orderBy(level))
    return levels.withColumn("scale", F.coalesce(before / F.col(size), F.lit(1.0)))


def overview_order(assets: DataFrame, parent: str, overview: str, area: str, tie: str, keys: Sequence[str] = ()) -> DataFrame:
    """Place of each asset when full-resolution ones come in order, each followed by its overviews, largest first."""
    w = Window.partitionBy(*keys).orderBy(F.col(parent), F.col(overview), F.col(area).desc(), F.col(tie))
    return assets.withColumn("place", F.row_number().over(w))


def level_checks(levels: DataFrame, keys: Sequence[str], level: str, rows: str, cols: str) -> DataFrame:
    """Levels with ``nests``: whether each side is that of the level before halved, rounded up or down; the first level nests.

    A level whose predecessor is missing doesn't nest.
    """
    w = Window.partitionBy(*keys).orderBy(level)
    first = F.row_number().over(w) == 1
    halved = lambda size: F.col(size).isin(F.floor(F.lag(size).over(w) / 2), F.ceil(F.lag(size).over(w) / 2)) | ((F.lag(size).over(w) == 1) & (F.col(size) == 1))
    follows = F.lag(level).over(w) == F.col(level) - 1
    return levels.withColumn("nests", F.when(first, F.col(level) == 0).otherwise(follows & halved(rows) & halved(cols)))


def level_choice(requests: DataFrame, levels: DataFrame, keys: Sequence[str], scale: str, level_scale: str, values: Sequence[str]) -> DataFrame:
    """Each request with ``values`` of the coarsest level of its image that is as fine as asked: the greatest scale of no more than the request's.

    An image has few levels, so they travel as one sorted array a image and the look-up is no range join.
    A request finer than all levels gets the finest; one of an unknown image gets nulls.
    """
    held = levels.where(F.col(level_scale).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(level_scale).alias("_scale"), *values))).alias("_levels"))
    joined = requests.join(held, list(keys), "left")
    fine = F.filter("_levels", lambda x: x["_scale"] <= F.col(scale))
    chosen = F.coalesce(F.try_element_at(fine, F.lit(-1)), F.try_element_at("_levels", F.lit(1)))
    return joined.withColumn("_level", chosen).select(*requests.columns, *[F.col(f"_level.{v}").alias(v) for v in values])


#: Bytes of a file after which a request ends, and bytes that may lie between two ranges of one.
EXTENT, GAP = 16 << 20, 64 << 10


def coalesced(ranges: DataFrame, on: Sequence[str], offset: str = "off", length: str = "len", gap: int = GAP, extent: int = EXTENT) -> DataFrame:
    """Ranges of bytes with the request (``start``, ``stop``) that fetches them.

    Ranges of a file that overlap, touch or lie no more than ``gap`` bytes apart share a request.  A
    file is cut at every ``extent`` bytes: a range belongs to the extent that it starts in, and a request
    to one extent, so neither requests nor what a task sorts grow with the file.
    """
    end = F.col(offset) + F.col(length)
    place = [*on, "_extent"]
    order = Window.partitionBy(*place).orderBy(offset, length)
    cut = ranges.withColumn("_extent", F.floor(F.col(offset) / extent)).withColumn("_end", end)
    reached = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = cut.withColumn("_new", F.when(F.col(offset) <= reached + gap, 0).otherwise(1))
    island = opened.withColumn("_island", F.sum("_new").over(order))
    whole = Window.partitionBy(*place, "_island")
    return island.withColumns({"start": F.min(offset).over(whole), "stop": F.max("_end").over(whole)}).drop("_extent", "_end", "_new", "_island")
