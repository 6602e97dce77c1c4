"""Images, texts and data made in memory, as block tables like those of scans.

An image is a set of block rows; setting a block again replaces it, and an image derived
from another takes what it lacks from there, re-tiled if the grids differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .formats import FormatError
from .scan import BLOCKS


def image_blocks(spark: SparkSession, image: np.ndarray, block: tuple[int, int], path: str = "memory", key: str = "image:0") -> DataFrame:
    """A whole image (bands, rows, cols) cut into blocks."""
    if image.ndim != 3 or 0 in image.shape:
        raise FormatError("an image has three dimensions, none of them zero")
    rows = []
    for br, y in enumerate(range(0, image.shape[1], block[0])):
        for bc, x in enumerate(range(0, image.shape[2], block[1])):
            px = np.ascontiguousarray(image[:, y : y + block[0], x : x + block[1]])
            rows.append((path, key, 0, br, bc, *map(int, px.shape), px.dtype.name, bytearray(px.tobytes())))
    return spark.createDataFrame(rows, BLOCKS)


def strips(rows: DataFrame, path: str, row: str, samples: str, dtype: str, height: int, key: str = "image:0") -> DataFrame:
    """Image rows (path, number of the row, array of its samples) as blocks of one band and ``height`` whole rows."""

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(row)
        px = np.stack([np.asarray(s) for s in group[samples]]).astype(dtype)[None]
        one = (group[path].iloc[0], key, 0, int(group[row].iloc[0]) // height, 0, *px.shape, px.dtype.name, np.ascontiguousarray(px).tobytes())
        return pd.DataFrame([one], columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return rows.select(path, row, samples).groupBy(path, F.floor(F.col(row) / height)).applyInPandas(join, BLOCKS)


def with_block(blocks: DataFrame, br: int, bc: int, px: np.ndarray, path: str = "memory", key: str = "image:0") -> DataFrame:
    """The table with one block set, in place of the one that was there."""
    row = [(path, key, 0, br, bc, *map(int, px.shape), px.dtype.name, bytearray(np.ascontiguousarray(px).tobytes()))]
    same = (F.col("path") == path) & (F.col("key") == key) & (F.col("br") == br) & (F.col("bc") == bc)
    return blocks.where(~same).unionByName(blocks.sparkSession.createDataFrame(row, BLOCKS))


def derived(local: DataFrame, source: DataFrame) -> DataFrame:
    """Local blocks, and those of the source where there is none."""
    on = ["path", "key", "level", "br", "bc"]
    return local.unionByName(source.join(local.select(*on), on, "left_anti"))


def mapped(blocks: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Every block through a function of its array (bands, rows, cols); its exceptions end the query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for b in batch.itertuples(index=False):
                px = np.ascontiguousarray(f(np.frombuffer(b.payload, b.dtype).reshape(b.bands, b.rows, b.cols)))
                out.append((b.path, b.key, b.level, b.br, b.bc, *px.shape, px.dtype.name, px.tobytes()))
            yield pd.DataFrame(out, columns=list(batch.columns))

    return blocks.mapInPandas(run, BLOCKS)


def retiled(blocks: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Blocks of another size: each source block is cut by the target grid, and each target block joined from its cuts.

    Equal sizes pass through.  A target block gathers only the source blocks that it meets.
    """
    if source == target:
        return blocks
    (sh, sw), (th, tw) = source, target
    top, left = F.col("br") * sh, F.col("bc") * sw
    cut = blocks.withColumn("tr", F.explode(F.sequence(F.floor(top / th).cast("int"), F.floor((top + F.col("rows") - 1) / th).cast("int"))))
    cut = cut.withColumn("tc", F.explode(F.sequence(F.floor(left / tw).cast("int"), F.floor((left + F.col("cols") - 1) / tw).cast("int"))))

    def join(group: pd.DataFrame) -> pd.DataFrame:
        one = group.iloc[0]
        y0, x0 = int(one["tr"]) * th, int(one["tc"]) * tw
        rows = max(min(y0 + th, b.br * sh + b.rows) for b in group.itertuples()) - y0
        cols = max(min(x0 + tw, b.bc * sw + b.cols) for b in group.itertuples()) - x0
        out = np.zeros((one["bands"], rows, cols), one["dtype"])
        for b in group.itertuples():
            px = np.frombuffer(b.payload, b.dtype).reshape(b.bands, b.rows, b.cols)
            top, left = b.br * sh, b.bc * sw
            ya, yb, xa, xb = max(y0, top), min(y0 + rows, top + b.rows), max(x0, left), min(x0 + cols, left + b.cols)
            out[:, ya - y0 : yb - y0, xa - x0 : xb - x0] = px[:, ya - top : yb - top, xa - left : xb - left]
        return pd.DataFrame([(one["path"], one["key"], one["level"], one["tr"], one["tc"], *out.shape, out.dtype.name, out.tobytes())], columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return cut.groupBy("path", "key", "level", "tr", "tc").applyInPandas(join, BLOCKS)


def text_asset(spark: SparkSession, text: str, key: str = "text:0", encoding: str = "utf-8") -> DataFrame:
    return spark.createDataFrame([(key, "text", f"text/plain; charset={encoding}", bytearray(text.encode(encoding)))], "key string, kind string, media_type string, content binary")


def data_asset(spark: SparkSession, content: bytes, media_type: str, key: str = "des:0") -> DataFrame:
    return spark.createDataFrame([(key, "data", media_type, bytearray(content))], "key string, kind string, media_type string, content binary")
