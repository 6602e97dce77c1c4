"""Scans: assets, blocks and tile indexes of container files, on any file system that Spark reads.

Files are listed by Spark's ``binaryFile`` source, so paths may be local, HDFS or object
stores, and the listing reads no content.  Tasks read headers and the ranges of wanted
blocks themselves, so a scan's bytes follow what is asked for and files may be of any
size; tables with a ``content`` column (made files, streams) are parsed from that.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import EXTENT, GAP, coalesced
from ..operators.segments import rset_level, without_rset
from .codecs import FORMATS, registered_codecs, sniffed, using
from .ranged import Ranged, file_system

ASSETS = "path string, format string, key string, kind string, roles array<string>, rows int, cols int, bands int, bh int, bw int, levels int, dtype string, bits int, offset long, length long, metadata string, warning string"
BLOCKS = "path string, key string, level int, br int, bc int, bands int, rows int, cols int, dtype string, payload binary"
RANGES = "path string, key string, level int, br int, bc int, ranges array<struct<off:long,len:long>>"


def files(spark: SparkSession, paths: str | Sequence[str], content: bool = False) -> DataFrame:
    """path and length of each file, listed without a byte read; with ``content`` each file's bytes, too (up to 2 GB each)."""
    found = spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else list(paths))
    listed = found.select("path", "length", *(["content"] if content else []))
    cores = spark.sparkContext.defaultParallelism
    return listed if content else listed.repartition(max(cores, listed.rdd.getNumPartitions()), "path")


def opened(batch: pd.DataFrame) -> Iterator[tuple[str, bytes | Ranged]]:
    """Path and bytes of each file: its content where the table has it, else ranges of the file, read on demand."""
    if "content" in batch:
        yield from zip(batch["path"], batch["content"])
        return
    for path in batch["path"]:
        with Ranged(path) as data:
            yield path, data


def _sources(contents: DataFrame) -> DataFrame:
    return contents.select("path", *[c for c in contents.columns if c == "content"])


def _parsed(content: bytes, fmt: str | None):
    name = fmt or sniffed(content[:16])
    return name, FORMATS[name], FORMATS[name].assets(content)


def scan_assets(contents: DataFrame, fmt: str | None = None) -> DataFrame:
    """One row per asset of files (path, content); a file that can't be parsed gives one row with a warning."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ASSETS.split(", ")]
        for batch in batches:
            rows = []
            for path, content in opened(batch):
                try:
                    name, _, found = _parsed(content, fmt)
                except (ValueError, KeyError, IndexError, ArithmeticError) as e:
                    rows.append((path, fmt, None, None, [], 0, 0, 0, 0, 0, 0, None, 0, 0, 0, None, f"{type(e).__name__}: {e}"))
                    continue
                rows += [(path, name, a.key, a.kind, list(a.roles), a.rows, a.cols, a.bands, a.bh, a.bw, a.levels, a.dtype, a.bits, a.offset, a.length, json.dumps(a.metadata, default=str, sort_keys=True), None) for a in found]
            yield pd.DataFrame(rows, columns=names)

    return _sources(contents).mapInPandas(parse, ASSETS)


def scan_blocks(contents: DataFrame, key: str | None = None, fmt: str | None = None, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, bands: Sequence[int] | None = None) -> DataFrame:
    """One row per recorded block, decoded to band-sequential samples in native order.

    ``rows`` and ``cols`` (first, last pixel) choose the blocks that a window meets, so
    others are never decoded; ``bands`` chooses bands, in order, repeats included.
    """

    codecs = registered_codecs()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        using(codecs)
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        for batch in batches:
            for path, content in opened(batch):
                _, module, found = _parsed(content, fmt)
                for asset in (a for a in found if a.kind == "image" and key in (None, a.key)):
                    level = int(asset.key.rsplit(":", 1)[1]) if ":overview:" in asset.key else 0
                    gr, gc = asset.grid
                    out = []
                    for br in range(rows[0] // asset.bh if rows else 0, min(gr, rows[1] // asset.bh + 1) if rows else gr):
                        for bc in range(cols[0] // asset.bw if cols else 0, min(gc, cols[1] // asset.bw + 1) if cols else gc):
                            if hasattr(module, "has_block") and not module.has_block(asset, br, bc):
                                continue
                            px = module.block(content, asset, br, bc)
                            if bands is not None:
                                px = px[list(bands)]
                            out.append((path, asset.key, level, br, bc, *px.shape, px.dtype.name, np.ascontiguousarray(px).tobytes()))
                    if out:
                        yield pd.DataFrame(out, columns=names)

    return _sources(contents).mapInPandas(cut, BLOCKS)


def tile_index(contents: DataFrame, fmt: str | None = None) -> DataFrame:
    """Byte ranges of every recorded block of every image."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "key", "level", "br", "bc", "ranges"]
        for batch in batches:
            out = []
            for path, content in opened(batch):
                _, module, found = _parsed(content, fmt)
                for asset in (a for a in found if a.kind == "image"):
                    level = int(asset.key.rsplit(":", 1)[1]) if ":overview:" in asset.key else 0
                    out += [(path, asset.key, level, br, bc, [{"off": o, "len": n} for o, n in parts]) for (br, bc), parts in module.ranges(asset).items()]
            yield pd.DataFrame(out, columns=names)

    return _sources(contents).mapInPandas(listed, RANGES)


#: Ranges of one block that a task fetches at the same time.
AT_ONCE = 8


def range_bytes(index: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """The recorded bytes of each block of an index, its ranges fetched side by side and joined in order; nothing else of a file is read.

    Files that only a table (path, content) holds are taken from ``contents``.
    """
    if contents is not None and "content" in contents.columns:
        part = F.transform("ranges", lambda r: F.hex(F.substr(F.col("content"), (r["off"] + 1).cast("int"), r["len"].cast("int"))))
        return index.join(contents.select("path", "content"), "path").select(*index.columns, F.unhex(F.array_join(part, "")).alias("data"))
    schema = f"{RANGES}, data binary"

    def fetched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(AT_ONCE) as pool:
            for batch in batches:
                batch = batch.reset_index(drop=True)
                data = [b""] * len(batch)
                for path, rows in batch.groupby("path").groups.items():
                    system, at = file_system(path)
                    with system.open_input_file(at) as file:
                        for i in rows:
                            parts = pool.map(lambda r: file.read_at(int(r["len"]), int(r["off"])), batch["ranges"][i])
                            data[i] = b"".join(parts)
                yield batch.assign(data=data)

    return index.select("path", "key", "level", "br", "bc", "ranges").mapInPandas(fetched, schema)


#: Bytes that a task of ``coalesced_bytes`` fetches, about.
TASK_BYTES = 128 << 20


def coalesced_bytes(index: DataFrame, gap: int = GAP, extent: int = EXTENT, task_bytes: int = TASK_BYTES) -> DataFrame:
    """As ``range_bytes`` of files, with neighbouring ranges fetched by one request and cut apart again.

    Requests are dealt out so that tasks fetch about ``task_bytes``; blocks of several ranges are put together
    afterwards, in order.
    """
    keys = ["path", "key", "level", "br", "bc"]
    spread = index.select(*keys, F.size("ranges").alias("parts"), F.posexplode("ranges").alias("part", "r")).select(*keys, "parts", "part", "r.off", "r.len")
    wanted = coalesced(spread, ["path"], gap=gap, extent=extent)
    item = F.struct(*keys[1:], "parts", "part", "off", "len")
    requests = wanted.groupBy("path", "start", "stop").agg(F.collect_list(item).alias("wanted"))  # the ranges of one request, which an extent bounds
    total = spread.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("bytes")).first().bytes
    parts = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // task_bytes))
    schema = "path string, key string, level int, br int, bc int, parts int, part int, start long, data binary"

    def fetched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, rows in batch.groupby("path"):
                system, at = file_system(path)
                with system.open_input_file(at) as file:
                    for r in rows.itertuples(index=False):
                        held = file.read_at(int(r.stop - r.start), int(r.start))
                        yield pd.DataFrame([
                            (path, w["key"], w["level"], w["br"], w["bc"], w["parts"], w["part"], r.start, held[w["off"] - r.start : w["off"] - r.start + w["len"]]) for w in r.wanted
                        ], columns=[c.split()[0] for c in schema.split(", ")])

    cut = requests.repartition(int(parts), "path", "start").mapInPandas(fetched, schema)
    one = cut.where("parts = 1").select(*keys, F.array("start").alias("requests"), "data")
    several = cut.where("parts > 1").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", "start", "data"))).alias("p"))
    joined = several.select(*keys, F.array_distinct(F.transform("p", lambda x: x["start"])).alias("requests"), F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["data"])), "")).alias("data"))
    return one.unionByName(joined)


def reference_bytes(refs: DataFrame, reference: str = "reference", keep: Sequence[str] = ("key", "chunk")) -> DataFrame:
    """keep... and data of chunk references (JSON, or a plain string).

    A string is the data itself, after ``base64:`` in that form; ``[url]`` is a whole file, ``[url, offset,
    length]`` a range and ``[url, [[offset, length], ...]]`` several, joined in order.
    """

    text = F.col(reference)
    coded = text.startswith("base64:")
    inline = F.when(coded, F.unbase64(F.substr(text, F.lit(8)))).otherwise(F.encode(text, "UTF-8"))
    steps = F.from_json(text, "array<string>")
    ranges = F.when(F.size(steps) == 3, F.array(F.array(F.get(steps, 1).try_cast("bigint"), F.get(steps, 2).try_cast("bigint")))).when(F.size(steps) == 2, F.from_json(F.get(steps, 1), "array<array<bigint>>"))

    @F.pandas_udf("binary")
    def fetched(urls: pd.Series, wanted: pd.Series) -> pd.Series:
        def one(url: str | None, parts) -> bytes | None:
            if url is None:
                return None
            with Ranged(url) as data:
                return data[:] if parts is None else b"".join(data[o : o + n] for o, n in parts)

        return pd.Series([one(u, p) for u, p in zip(urls, wanted)], dtype=object)

    away = text.startswith("[")
    return refs.select(*keep, F.when(away, fetched(F.when(away, F.get(steps, 0)), F.when(away, ranges))).otherwise(inline).alias("data"))


def with_pyramid(assets: DataFrame) -> DataFrame:
    """Assets of files and of their ``.rN`` siblings as levels of the base file: level, base and an overview key."""
    level = F.coalesce(rset_level(F.col("path")), F.lit(0))
    key = F.when(level > 0, F.concat("key", F.lit(":overview:"), level.cast("string"))).otherwise(F.col("key"))
    roles = F.when(level > 0, F.array(F.lit("overview"))).otherwise(F.col("roles"))
    return assets.withColumns({"base": without_rset(F.col("path")), "level": level, "key": key, "roles": roles})


def block_pixels(blocks: DataFrame) -> DataFrame:
    """One row per sample of decoded blocks: path, key, level, br, bc, band, y, x (inside the block) and v."""
    schema = "path string, key string, level int, br int, bc int, band int, y int, x int, v double"

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples(index=False):
                px = np.frombuffer(b.payload, b.dtype).reshape(b.bands, b.rows, b.cols)
                band, y, x = np.indices(px.shape, dtype=np.int32).reshape(3, -1)
                yield pd.DataFrame({"path": b.path, "key": b.key, "level": b.level, "br": b.br, "bc": b.bc, "band": band, "y": y, "x": x, "v": px.ravel().astype(np.float64)})

    return blocks.mapInPandas(spread, schema)
