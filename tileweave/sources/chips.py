"""Many windows of many files read in one job.

Headers tell each file's grid; an equi-join turns windows into the blocks they need, and
tasks get ranges of (file, image, block), so a block that many windows want is decoded once for
each task that holds some of them, and one that very many want is spread over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators.windows import window_blocks
from .codecs import FORMATS, registered_codecs, sniffed, using
from .ranged import Ranged
from .scan import scan_assets

PIECE = "dy int, dx int, bands int, rows int, cols int, dtype string, payload binary"


def window_pieces(spark: SparkSession, windows: DataFrame, partitions: int | None = None) -> DataFrame:
    """The samples of each window (path, key, y, x, h, w and columns of the user's own), a row for each block it meets.

    dy and dx place a piece in its window; parts of a window outside its image have no pieces.
    """
    paths = windows.select("path").distinct()
    grids = scan_assets(paths).where("kind = 'image'").select("path", "key", "rows", "cols", "bh", "bw")
    need = window_blocks(windows, grids, ["path", "key"])
    own = [c for c in windows.columns if c not in ("path", "key")]
    parts = partitions or spark.sparkContext.defaultParallelism * 2
    dealt = need.select(*windows.columns, "br", "bc", "oy", "ox", "oh", "ow").repartitionByRange(parts, "path", "key", "br", "bc", *own).sortWithinPartitions("path", "key", "br", "bc")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema.fields]

    codecs = registered_codecs()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        using(codecs)
        path = data = module = None
        assets: dict = {}
        block, px = None, None
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                if r["path"] != path:
                    if data is not None:
                        data.file.close()
                    path, data, block = r["path"], Ranged(r["path"]), None
                    module = FORMATS[sniffed(data[:16])]
                    assets = {a.key: a for a in module.assets(data)}
                asset, here = assets[r["key"]], (r["key"], r["br"], r["bc"])
                if here != block:
                    recorded = not hasattr(module, "has_block") or module.has_block(asset, r["br"], r["bc"])
                    block, px = here, module.block(data, asset, r["br"], r["bc"]) if recorded else None
                if px is None:
                    continue
                top, left = r["oy"] - r["br"] * asset.bh, r["ox"] - r["bc"] * asset.bw
                piece = np.ascontiguousarray(px[:, top : top + r["oh"], left : left + r["ow"]])
                out.append({**{c: r[c] for c in windows_columns}, "dy": r["oy"] - r["y"], "dx": r["ox"] - r["x"], "bands": piece.shape[0], "rows": piece.shape[1], "cols": piece.shape[2], "dtype": piece.dtype.name, "payload": piece.tobytes()})
            if out:
                yield pd.DataFrame(out)
        if data is not None:
            data.file.close()

    windows_columns = list(windows.columns)
    return dealt.mapInPandas(cut, ", ".join([*fields, PIECE]))


def assembled_windows(pieces: DataFrame, on: list[str], fill=0) -> DataFrame:
    """on..., bands, rows, cols, dtype and payload of whole windows (``h`` x ``w`` samples a band, ``fill`` where nothing is recorded); each window fits a row."""

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        one = group.iloc[0]
        out = np.full((one["bands"], one["h"], one["w"]), fill, one["dtype"])
        for p in group.itertuples(index=False):
            out[:, p.dy : p.dy + p.rows, p.dx : p.dx + p.cols] = np.frombuffer(p.payload, p.dtype).reshape(p.bands, p.rows, p.cols)
        return pd.DataFrame([{**{c: one[c] for c in on}, "bands": out.shape[0], "rows": out.shape[1], "cols": out.shape[2], "dtype": one["dtype"], "payload": out.tobytes()}])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*on).schema.fields]
    return pieces.groupBy(*on).applyInPandas(whole, ", ".join([*fields, "bands int, rows int, cols int, dtype string, payload binary"]))
