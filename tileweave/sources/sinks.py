"""Sinks: blocks to container files, tile indexes to Parquet or JSON."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import contiguous
from .codecs import FORMATS, registered_codecs, using
from .ranged import file_system
from .formats import FormatError

FILES = "path string, content binary"
#: Raw bytes of one output file that fit a row of a DataFrame; larger files go through ``formats`` block by block.
MAX_RAW = (1 << 31) - (1 << 20)


def assembled(blocks: pd.DataFrame) -> np.ndarray:
    """Blocks of one image as one array (bands, rows, cols); missing ones are zero."""
    one = blocks.iloc[0]
    heights = blocks.groupby("br")["rows"].max().to_dict()
    widths = blocks.groupby("bc")["cols"].max().to_dict()
    bh, bw = heights.get(0, max(heights.values())), widths.get(0, max(widths.values()))
    rows, cols = max(r * bh + h for r, h in heights.items()), max(c * bw + w for c, w in widths.items())
    out = np.zeros((one["bands"], rows, cols), one["dtype"])
    for b in blocks.itertuples(index=False):
        out[:, b.br * bh : b.br * bh + b.rows, b.bc * bw : b.bc * bw + b.cols] = np.frombuffer(b.payload, b.dtype).reshape(b.bands, b.rows, b.cols)
    return out


def encoded(blocks: DataFrame, fmt: str, image_metadata: dict | None = None, **options) -> DataFrame:
    """One row (path, content) per file of a block table, all its images in key order; a file is made in one task.

    ``image_metadata`` goes with every image.
    """

    codecs = registered_codecs()

    def build(group: pd.DataFrame) -> pd.DataFrame:
        using(codecs)
        if group["payload"].map(len).sum() > MAX_RAW:
            raise FormatError(f"{group['path'].iloc[0]} has more than {MAX_RAW} raw bytes")
        images = []
        for key, own in sorted(group.groupby("key"), key=lambda g: g[0]):
            meta = {**(image_metadata or {}), **({"overview": True} if ":overview:" in key else {})}
            images.append((assembled(own), meta))
        module = FORMATS[fmt]
        if fmt in ("tiff", "nitf", "nsif"):
            more = {"magic": module.MAGIC[1]} if fmt == "nsif" else {}
            content = module.encode(images, **more, **options)
        else:
            if len(images) != 1:
                raise FormatError(f"{fmt} holds one image")
            content = module.encode(images[0][0], {**(image_metadata or {}), **options.get("metadata", {})})
        return pd.DataFrame({"path": [group["path"].iloc[0]], "content": [content]})

    return blocks.groupBy("path").applyInPandas(build, FILES)


def save_files(contents: DataFrame, folder: str) -> DataFrame:
    """Writes each content under its base name into a folder of any file system that all tasks share; gives path and bytes.

    A file appears by rename (on object stores when its upload ends), so a task that is run again leaves no half of one.
    """

    def write(batches):
        from uuid import uuid4

        system, target = file_system(folder)
        target = target.rstrip("/")
        system.create_dir(target, recursive=True)
        for batch in batches:
            done = []
            for path, content in zip(batch["path"], batch["content"]):
                name = path.rstrip("/").rsplit("/", 1)[-1]
                part = f"{target}/.{name}.{uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(content)
                system.move(part, f"{target}/{name}")
                done.append((f"{folder.rstrip('/')}/{name}", len(content)))
            yield pd.DataFrame(done, columns=["path", "bytes"])

    return contents.select("path", "content").mapInPandas(write, "path string, bytes long")


def write_tile_index(index: DataFrame, path: str, keys: list[str] | None = None, form: str = "parquet") -> None:
    """A tile index as Parquet, or as one JSON document of references per image and level."""
    chosen = index if keys is None else index.where(F.col("key").isin(keys))
    if form == "parquet":
        chosen.repartitionByRange("path", "key", "br", "bc").write.mode("overwrite").parquet(path)
    elif form == "json":
        refs = chosen.select("path", "key", "level", F.concat_ws(".", F.lit("0"), "br", "bc").alias("chunk"), "ranges")
        refs.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"no index form {form}")


def references(index: DataFrame) -> DataFrame:
    """Chunk references (chunk, reference as JSON): one range as [url, offset, length], several as [url, [[offset, length], ...]]."""
    url = F.to_json(F.array("path"))
    opened = F.substr(url, F.lit(1), F.length(url) - 1)
    pair = lambda r: F.concat_ws(", ", r["off"].cast("string"), r["len"].cast("string"))
    whole = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda a, r: a + r["len"])
    one = F.concat(opened, F.lit(", "), F.get("ranges", 0)["off"].cast("string"), F.lit(", "), whole.cast("string"), F.lit("]"))
    several = F.concat(opened, F.lit(", ["), F.array_join(F.transform("ranges", lambda r: F.concat(F.lit("["), pair(r), F.lit("]"))), ", "), F.lit("]]"))
    return index.select("key", "level", F.concat_ws(".", F.lit("0"), "br", "bc").alias("chunk"), F.when(contiguous(F.col("ranges")), one).otherwise(several).alias("reference"))
