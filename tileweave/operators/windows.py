"""Tables of windows joined with tables of blocks.

A window or block is a rectangle of an image: columns of its image's key, and y, x, h, w
in pixels.  Windows are covered by the cells of a grid, which makes the range join an
equi-join on image and cell: a shuffle by keys of which a large image has many, never a
nested loop.  A window and a block that share several cells meet in all of them and are
kept in the first only, so no distinct is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .raster import tile_count

PLACE = ("y", "x", "h", "w")


def cells_of(start: Column, length: Column, cell: int) -> Column:
    """Numbers of the cells along an axis that a range meets; none for an empty one."""
    return F.when(length > 0, F.sequence(F.floor(start / cell), F.floor((start + length - 1) / cell)))


def covered(rects: DataFrame, cell: tuple[int, int]) -> DataFrame:
    """``rects`` once for each cell they meet: cy, cx and the first cell of each axis (fy, fx).

    A wide rectangle's cells are exploded an axis at a time, so no row holds more than one
    side of them.
    """
    rows = rects.withColumns({"fy": F.floor(F.col("y") / cell[0]), "fx": F.floor(F.col("x") / cell[1])})
    rows = rows.withColumn("cy", F.explode(cells_of(F.col("y"), F.col("h"), cell[0])))
    return rows.withColumn("cx", F.explode(cells_of(F.col("x"), F.col("w"), cell[1])))


def overlap(start: Column, length: Column, other: Column, other_length: Column) -> tuple[Column, Column]:
    """First pixel and number of pixels that two ranges of an axis share."""
    first = F.greatest(start, other)
    return first, F.least(start + length, other + other_length) - first


def overlaps(windows: DataFrame, blocks: DataFrame, on: Sequence[str], cell: tuple[int, int] = (256, 256)) -> DataFrame:
    """Every window with every block of the same image that it meets.

    Gives the columns of both sides (the blocks' y, x, h, w as block_y, block_x, block_h, block_w) and the
    shared rectangle: oy, ox, oh, ow.  ``cell`` should be about a block's size: larger cells
    compare more pairs, smaller ones copy more rows; the result is the same.  Empty rectangles and
    null keys meet nothing.  Neither side is broadcast: Catalyst takes a table of cells for as small as the
    rectangles they come from.  Tiles of a regular grid need no table, see ``window_tiles``.
    """
    renamed = {c: f"block_{c}" for c in PLACE}
    left = covered(windows, cell)
    right = covered(blocks, cell).withColumnsRenamed({**renamed, "fy": "block_fy", "fx": "block_fx"})
    met = left.join(right.hint("merge"), [*on, "cy", "cx"])
    first = (F.col("cy") == F.greatest("fy", "block_fy")) & (F.col("cx") == F.greatest("fx", "block_fx"))
    oy, oh = overlap(F.col("y"), F.col("h"), F.col("block_y"), F.col("block_h"))
    ox, ow = overlap(F.col("x"), F.col("w"), F.col("block_x"), F.col("block_w"))
    found = met.where(first).withColumns({"oy": oy, "oh": oh, "ox": ox, "ow": ow}).where("oh > 0 AND ow > 0")
    return found.drop("cy", "cx", "fy", "fx", "block_fy", "block_fx")


def block_ranges(windows: DataFrame, grids: DataFrame, on: Sequence[str]) -> DataFrame:
    """Windows of images with regular grids (rows, cols, bh, bw), clipped to the image, with the range of blocks they meet: br0, br1, bc0, bc1.

    A window outside its image meets no block and is left out.
    """
    both = windows.join(grids.select(*on, "rows", "cols", "bh", "bw"), list(on))
    y0, x0 = F.greatest("y", F.lit(0)), F.greatest("x", F.lit(0))
    y1, x1 = F.least(F.col("y") + F.col("h"), "rows"), F.least(F.col("x") + F.col("w"), "cols")
    clipped = both.withColumns({"y0": y0, "x0": x0, "y1": y1, "x1": x1}).where("y1 > y0 AND x1 > x0")
    at = lambda pixel, size: F.floor(pixel / size).cast("int")
    ranged = clipped.withColumns({"br0": at(F.col("y0"), F.col("bh")), "br1": at(F.col("y1") - 1, F.col("bh")), "bc0": at(F.col("x0"), F.col("bw")), "bc1": at(F.col("x1") - 1, F.col("bw"))})
    return ranged.drop("y0", "x0", "y1", "x1")


def window_blocks(windows: DataFrame, grids: DataFrame, on: Sequence[str]) -> DataFrame:
    """A row for each window and each block (br, bc) of its image's regular grid that it meets, with the shared rectangle (oy, ox, oh, ow)."""
    placed = block_ranges(windows, grids, on).withColumn("br", F.explode(F.sequence("br0", "br1"))).withColumn("bc", F.explode(F.sequence("bc0", "bc1")))
    inside = lambda start, size, most: F.least(F.lit(0) + size, most - start)
    by, bx = F.col("br") * F.col("bh"), F.col("bc") * F.col("bw")
    oy, oh = overlap(F.col("y"), F.col("h"), by, inside(by, F.col("bh"), F.col("rows")))
    ox, ow = overlap(F.col("x"), F.col("w"), bx, inside(bx, F.col("bw"), F.col("cols")))
    return placed.withColumns({"oy": oy, "oh": oh, "ox": ox, "ow": ow}).drop("br0", "br1", "bc0", "bc1")


def tiles_of(start: Column, length: Column, whole: Column, size: int, lap: int) -> Column:
    """Numbers of the tiles along an axis of ``whole`` pixels that a range meets, neighbours sharing ``lap`` pixels; none for an empty one or one outside."""
    first = F.greatest(F.floor((start - size) / (size - lap)) + 1, F.lit(0))
    last = F.least(F.floor((start + length - 1) / (size - lap)), tile_count(whole, size, lap) - 1)
    return F.when((length > 0) & (whole > 0) & (start < whole) & (first <= last), F.sequence(first, last))


def window_tiles(windows: DataFrame, images: DataFrame, on: Sequence[str], size: tuple[int, int], lap: tuple[int, int] = (0, 0)) -> DataFrame:
    """A row for each window and each tile (tr, tc) of its image's ``raster.tile_grid`` that it meets, with the shared rectangle (oy, ox, oh, ow).

    ``images`` have rows and cols, ``lap`` is the pixels that neighbours share.  A window's tiles follow from its place, so only tiles
    that windows meet are made, and only windows and images are joined.
    """
    both = windows.join(images.select(*on, F.col("rows").alias("_rows"), F.col("cols").alias("_cols")), list(on))
    placed = both.withColumn("tr", F.explode(tiles_of(F.col("y"), F.col("h"), F.col("_rows"), size[0], lap[0])))
    placed = placed.withColumn("tc", F.explode(tiles_of(F.col("x"), F.col("w"), F.col("_cols"), size[1], lap[1])))
    ty, tx = F.col("tr") * (size[0] - lap[0]), F.col("tc") * (size[1] - lap[1])
    oy, oh = overlap(F.col("y"), F.col("h"), ty, F.least(F.lit(size[0]), F.col("_rows") - ty))
    ox, ow = overlap(F.col("x"), F.col("w"), tx, F.least(F.lit(size[1]), F.col("_cols") - tx))
    numbers = [F.col(c).cast("int").alias(c) for c in ("tr", "tc")]
    return placed.select(*windows.columns, *numbers, oy.alias("oy"), ox.alias("ox"), oh.alias("oh"), ow.alias("ow"))


def window_rows(windows: DataFrame, lines: DataFrame, on: Sequence[str], row: str, samples: str, cell: int = 256) -> DataFrame:
    """What windows hold of images stored as lines of samples: window columns, the line's place in the window (dy) and its samples from x on.

    Lines are blocks of one row, so the cells are ranges of rows; only the slice that the window shows moves on.
    """
    left = windows.withColumn("cy", F.explode(cells_of(F.col("y"), F.col("h"), cell)))
    right = lines.select(*on, F.col(row).alias("_row"), F.col(samples).alias("_samples"), F.floor(F.col(row) / cell).alias("cy"))
    met = left.join(right, [*on, "cy"]).where("_row >= y AND _row < y + h AND x < size(_samples) AND x + w > 0")
    shown = F.slice("_samples", F.greatest("x", F.lit(0)).cast("int") + 1, (F.least(F.col("x") + F.col("w"), F.size("_samples")) - F.greatest("x", F.lit(0))).cast("int"))
    return met.select(*windows.columns, (F.col("_row") - F.col("y")).alias("dy"), shown.alias("samples"))
