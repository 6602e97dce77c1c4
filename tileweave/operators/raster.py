"""Pixels, windows, tiles and bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pixels(df: DataFrame, samples: str, row: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per sample of an array column: keep..., row, col, v."""
    return df.select(*keep, F.col(row).alias("row"), F.posexplode(samples).alias("col", "v"))


def window_chip(df: DataFrame, samples: str, row: str, top: int, left: int, height: int, width: int) -> DataFrame:
    """Rows and samples inside a window; the row range reaches the scan as a filter."""
    inside = df.where(F.col(row).between(top, top + height - 1))
    return inside.select(F.col(row), F.slice(F.col(samples), left + 1, width).alias(samples))


def block_of(row: Column, col: Column, height: int, width: int) -> tuple[Column, Column]:
    """Block row and block column of a pixel."""
    return F.floor(row / height).cast("int"), F.floor(col / width).cast("int")


def block_stats(px: DataFrame, height: int, width: int, value: str = "v") -> DataFrame:
    """Least, largest and number of samples of every block of a pixel table."""
    br, bc = block_of(F.col("row"), F.col("col"), height, width)
    return px.groupBy(br.alias("br"), bc.alias("bc")).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n"))


def grid_size(length: Column, block: Column) -> Column:
    """Blocks along an axis; a block size of 0 means one block."""
    return F.when(block == 0, F.lit(1)).otherwise(F.ceil(length / block)).cast("int")


def tile_count(length: Column, size: int, overlap: int) -> Column:
    """Tiles along an axis, of which neighbours share ``overlap`` pixels; at least one."""
    return F.greatest(F.lit(1), F.ceil((length - overlap) / (size - overlap))).cast("int")


def tile_grid(images: DataFrame, height: int, width: int, overlap: tuple[int, int] = (0, 0), rows: str = "rows", cols: str = "cols") -> DataFrame:
    """Every tile of every image in row-major order: tr, tc, y, x, h, w; tiles at the edge are clipped."""
    dy, dx = height - overlap[0], width - overlap[1]
    placed = images.withColumn("tr", F.explode(F.sequence(F.lit(0), tile_count(F.col(rows), height, overlap[0]) - 1)))
    placed = placed.withColumn("tc", F.explode(F.sequence(F.lit(0), tile_count(F.col(cols), width, overlap[1]) - 1)))
    y, x = F.col("tr") * dy, F.col("tc") * dx
    return placed.withColumns({"y": y, "x": x, "h": F.least(F.lit(height), F.col(rows) - y), "w": F.least(F.lit(width), F.col(cols) - x)})


def edge_block(images: DataFrame, rows: str, block: int, index: str) -> Column:
    """Rows of a block that lie in the image."""
    return F.least(F.lit(block), F.col(rows) - F.col(index) * block)


def retile(px: DataFrame, source: tuple[int, int], target: tuple[int, int], value: str = "v") -> DataFrame:
    """Every target tile with what it gathers: samples, their sum, and how many source tiles they come from."""
    (sr, sc), (tr, tc) = block_of(F.col("row"), F.col("col"), *source), block_of(F.col("row"), F.col("col"), *target)
    placed = px.select(tr.alias("tr"), tc.alias("tc"), sr.alias("sr"), sc.alias("sc"), F.col(value).alias("v"))
    partial = placed.groupBy("tr", "tc", "sr", "sc").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("high"))
    return partial.groupBy("tr", "tc").agg(F.sum("n").alias("n"), F.max("high").alias("high"), F.count(F.lit(1)).alias("sources"))


def bands_selected(df: DataFrame, samples: str, bands: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """One row per wanted band, in the wanted order, repeats included; a band out of range raises an error."""
    wanted = F.array(*[F.lit(b) for b in bands])
    return df.select(*keep, samples, F.posexplode(wanted).alias("place", "band")).select(*keep, "place", "band", F.element_at(samples, F.col("band") + 1).alias("v"))


def sequential_index(position: Column, mode: str, rows: int, cols: int, bands: int) -> Column:
    """Place in band-sequential order of a sample at ``position`` in interleave mode B, P, R or S."""
    plane = rows * cols
    if mode == "P":
        return (position % bands) * plane + F.floor(position / bands).cast("int")
    if mode == "R":
        row, rest = F.floor(position / (cols * bands)).cast("int"), position % (cols * bands)
        return F.floor(rest / cols).cast("int") * plane + row * cols + rest % cols
    if mode in ("B", "S"):
        return position
    raise ValueError(f"no interleave mode {mode}")


def interleaved_index(position: Column, mode: str, rows: int, cols: int, bands: int) -> Column:
    """Inverse of ``sequential_index``."""
    plane = rows * cols
    band, pixel = F.floor(position / plane).cast("int"), position % plane
    if mode == "P":
        return pixel * bands + band
    if mode == "R":
        return F.floor(pixel / cols).cast("int") * cols * bands + band * cols + pixel % cols
    if mode in ("B", "S"):
        return position
    raise ValueError(f"no interleave mode {mode}")


def halved(px: DataFrame, value: str = "v") -> DataFrame:
    """Mean of every two by two pixels: an overview level (an extension)."""
    return px.groupBy(F.floor(F.col("row") / 2).cast("int").alias("row"), F.floor(F.col("col") / 2).cast("int").alias("col")).agg(F.avg(value).alias("v"))


def squared_error(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Pixels compared, mean squared error and PSNR for a peak of 1."""
    both = left.select(*keys, F.col(value).alias("_l")).join(right.select(*keys, F.col(value).alias("_r")), list(keys))
    total = both.agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("_l") - F.col("_r"), 2)).alias("mse"))
    return total.withColumn("psnr", F.when(F.col("mse") > 0, -10 * F.log10("mse")))


def similarity_index(left: Column, right: Column, peak: float = 1.0) -> Column:
    """Structural similarity of two sample columns over a group, in its global form; an aggregate."""
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    means = (2 * F.avg(left) * F.avg(right) + c1) / (F.pow(F.avg(left), 2) + F.pow(F.avg(right), 2) + c1)
    return means * (2 * F.covar_pop(left, right) + c2) / (F.var_pop(left) + F.var_pop(right) + c2)


def with_halo(px: DataFrame, block: tuple[int, int], halo: int, row: str = "row", col: str = "col") -> DataFrame:
    """A pixel table by blocks (br, bc), each with the pixels up to ``halo`` outside it; ``own`` tells those inside."""
    places = lambda at, size: F.sequence(F.floor((F.col(at) - halo) / size), F.floor((F.col(at) + halo) / size))
    spread = px.withColumn("br", F.explode(places(row, block[0]))).withColumn("bc", F.explode(places(col, block[1])))
    home = (F.floor(F.col(row) / block[0]) == F.col("br")) & (F.floor(F.col(col) / block[1]) == F.col("bc"))
    return spread.withColumn("own", home)


def window_similarity(px: DataFrame, on: Sequence[str], left: str, right: str, peak: float = 1.0, size: int = 7, block: tuple[int, int] = (128, 128)) -> DataFrame:
    """Structural similarity around each pixel (on..., row, col, ssim) of two sample columns, over windows of ``size`` x ``size`` samples.

    Windows are uniform, variances those of a sample, and only windows that lie wholly in the image
    count.  Pixels are dealt out once, by block with a halo of half a window; moments are summed along
    rows and then along columns inside each, so a task holds no more than a block and its halo
    of an image, and sums of whole numbers are exact.
    """
    half = size // 2
    x, y = F.col(left), F.col(right)
    spread = with_halo(px.select(*on, "row", "col", left, right), block, half).repartition(*on, "br", "bc")
    moments = {"_n": F.lit(1).cast("bigint"), "_x": x, "_y": y, "_xx": x * x, "_yy": y * y, "_xy": x * y}
    keys = [*on, "br", "bc"]
    along = lambda line, order: Window.partitionBy(*keys, line).orderBy(order).rangeBetween(-half, half)
    rows = spread.select(*keys, "row", "col", "own", *[F.sum(c).over(along("row", "col")).alias(name) for name, c in moments.items()])
    both = rows.select(*keys, "row", "col", "own", *[F.sum(name).over(along("col", "row")).alias(name) for name in moments])
    n = size * size
    mean = lambda c: F.col(c) / n
    spare = n / (n - 1)
    vx, vy, vxy = spare * (mean("_xx") - mean("_x") * mean("_x")), spare * (mean("_yy") - mean("_y") * mean("_y")), spare * (mean("_xy") - mean("_x") * mean("_y"))
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    luminance = (2 * mean("_x") * mean("_y") + c1) / (mean("_x") * mean("_x") + mean("_y") * mean("_y") + c1)
    ssim = luminance * (2 * vxy + c2) / (vx + vy + c2)
    return both.where(F.col("own") & (F.col("_n") == n)).select(*on, "row", "col", ssim.alias("ssim"))
