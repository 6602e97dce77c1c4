"""Large files written by many tasks at once.

Every tile's place in the file is known before a byte of it is written: sizes come first, and
places are their running sums.  Tasks then write their own tiles, and their own entries
of the tables of places, into a hidden file beside the target.  The driver writes the
headers only, and the file appears by a rename when all tasks are done.  A task that
runs again writes the same bytes to the same places; if the write fails the hidden file
goes and the target stays as it was.  No task holds more than a batch of tiles.

Files are TIFF with 64-bit places.  The target's folder must be one that all tasks share and that allows writes
at any place (a local or mounted file system); on stores that don't, ``sinks.save_files`` writes whole smaller files.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .formats import FormatError

ENCODED = "image int, br int, bc int, nth long, data binary"
PLACED = "offset long, data binary, entry long, counts long"
#: Tag numbers and types of the format that a header needs.
TAG_TYPES = {254: 4, 256: 4, 257: 4, 258: 3, 259: 3, 262: 3, 277: 3, 284: 3, 322: 4, 323: 4, 324: 16, 325: 16, 339: 3}
_SIZE = {3: ("H", 2), 4: ("I", 4), 16: ("Q", 8)}
HEADER = 16


def local_path(target: str) -> str:
    path = "/" + target.removeprefix("file:").lstrip("/") if target.startswith("file:") else target
    if "://" in path:
        raise FormatError(f"{target}: only file systems with writes at any place hold a file that many tasks write")
    return path


class PlacedWriter(DataSourceWriter):
    """Writes rows (offset, data, entry, counts) at their places of a hidden file; ``commit`` adds headers and renames it."""

    def __init__(self, options):
        self.hidden, self.target, self.headers = options["hidden"], options["path"], json.loads(options["headers"])

    def write(self, rows: Iterator) -> WriterCommitMessage:
        with open(self.hidden, "r+b", buffering=0) as file:

            def put(at: int, data: bytes) -> None:
                done = 0
                while done < len(data):
                    done += os.pwrite(file.fileno(), data[done:], at + done)

            for row in rows:
                put(row.offset, row.data)
                put(row.entry, struct.pack("<Q", row.offset))
                put(row.counts, struct.pack("<Q", len(row.data)))
            os.fsync(file.fileno())
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        with open(self.hidden, "r+b") as file:
            for at, text in self.headers:
                file.seek(at)
                file.write(bytes.fromhex(text))
        os.replace(self.hidden, self.target)

    def abort(self, messages) -> None:
        if os.path.exists(self.hidden):
            os.remove(self.hidden)


class PlacedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tileweave_placed"

    def schema(self) -> str:
        return PLACED

    def writer(self, schema, overwrite) -> PlacedWriter:
        return PlacedWriter(self.options)


def running_places(sizes: DataFrame) -> DataFrame:
    """Tiles (image, br, bc, nth, size) with ``within``, the sum of the sizes before them in their image, row by row.

    Sums are made twice, over an image's block rows and inside each block row, so no task sorts all tiles.
    """
    lines = sizes.groupBy("image", "br").agg(F.sum("size").alias("whole"))
    before = Window.partitionBy("image").orderBy("br").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("line_at", F.coalesce(F.sum("whole").over(before), F.lit(0))).drop("whole")
    inside = Window.partitionBy("image", "br").orderBy("bc").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.join(lines, ["image", "br"]).withColumn("within", F.col("line_at") + F.coalesce(F.sum("size").over(inside), F.lit(0))).drop("line_at")


def _directory(tags: dict[int, list[int]], at: int, tables: dict[int, int], following: int) -> bytes:
    """A directory that stands at ``at``: ``tables`` tells where the values of long tags stand, others follow it."""
    head, extra = struct.pack("<Q", len(tags)), b""
    behind = at + 8 + 20 * len(tags) + 8
    for tag in sorted(tags):
        code, size = _SIZE[TAG_TYPES[tag]]
        n, values = (tags[tag][0], None) if tag in tables else (len(tags[tag]), struct.pack(f"<{len(tags[tag])}{code}", *tags[tag]))
        if values is None:
            field = struct.pack("<Q", tables[tag])
        elif len(values) <= 8:
            field = values.ljust(8, b"\0")
        else:
            field = struct.pack("<Q", behind + len(extra))
            extra += values + b"\0" * (-len(values) % 8)
        head += struct.pack("<HHQ", tag, TAG_TYPES[tag], n) + field
    return head + struct.pack("<Q", following) + extra


def write_tiff(blocks: DataFrame, target: str, compress: bool = False, work: str | None = None) -> int:
    """Writes a block table as one TIFF file by as many tasks as the table has partitions; gives its bytes.

    Images come in the order of their keys, tiles have the size of block (0, 0), which the format wants in steps of 16, and
    blocks that are missing stay holes.  ``compress``: tiles are deflated first, into a table in the folder ``work`` (by
    default a hidden one beside the target), for then their sizes are known only afterwards.
    """
    spark = blocks.sparkSession
    path = local_path(target)
    shapes = blocks.groupBy("key", "level").agg(
        F.max("bands").alias("bands"), F.max("dtype").alias("dtype"), F.count_distinct("dtype", "bands").alias("kinds"), F.max("rows").alias("bh"), F.max("cols").alias("bw"),
        F.max_by("rows", "br").alias("last_rows"), F.max_by("cols", "bc").alias("last_cols"), F.max("br").alias("br"), F.max("bc").alias("bc"), F.count(F.lit(1)).alias("blocks"), F.count_distinct("br", "bc").alias("places"),
    ).orderBy("key").collect()  # fmt: skip  # a row for each image of the file
    if not shapes:
        raise FormatError("no blocks to write")
    images, at = [], HEADER
    for s in shapes:
        if s.kinds != 1 or s.blocks != s.places:
            raise FormatError(f"{s.key}: blocks of one type, one for each place, are needed")
        if (s.bh % 16 and s.br) or (s.bw % 16 and s.bc):
            raise FormatError(f"{s.key}: tiles of {s.bh} x {s.bw} aren't in steps of 16")
        tile = (-(-s.bh // 16) * 16, -(-s.bw // 16) * 16)
        dtype = np.dtype(s.dtype)
        if dtype.kind not in "uif":
            raise FormatError(f"samples of type {s.dtype} aren't supported")
        images.append({"key": s.key, "level": s.level, "tile": tile, "grid": (s.br + 1, s.bc + 1), "rows": s.br * s.bh + s.last_rows, "cols": s.bc * s.bw + s.last_cols, "bands": s.bands, "dtype": dtype})
    headers = []
    for i, m in enumerate(images):  # directories and tables of places first, tiles after them
        kind = {"u": 1, "i": 2, "f": 3}[m["dtype"].kind]
        n = m["grid"][0] * m["grid"][1]
        tags = {
            254: [int(m["level"] > 0)], 256: [m["cols"]], 257: [m["rows"]], 258: [m["dtype"].itemsize * 8] * m["bands"], 259: [8 if compress else 1], 262: [2 if m["bands"] == 3 else 1], 277: [m["bands"]], 284: [1],
            322: [m["tile"][1]], 323: [m["tile"][0]], 324: [n], 325: [n], 339: [kind] * m["bands"],
        }
        if n == 1:
            raise FormatError(f"{m['key']}: an image of one tile needs no tasks; use sinks.encoded")
        size = len(_directory(tags, at, {324: 0, 325: 0}, 0))
        m["entries"], m["counts"] = at + size, at + size + 8 * n
        following = at + size + 16 * n
        headers.append((at, _directory(tags, at, {324: m["entries"], 325: m["counts"]}, following if i + 1 < len(images) else 0).hex()))
        at = following
    headers.append((0, struct.pack("<2sHHHQ", b"II", 43, 8, 0, HEADER).hex()))
    numbers = {m["key"]: i for i, m in enumerate(images)}

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for b in batch.itertuples(index=False):
                m = images[numbers[b.key]]
                px = np.zeros((*m["tile"], m["bands"]), m["dtype"].newbyteorder("<"))
                px[: b.rows, : b.cols] = np.frombuffer(b.payload, b.dtype).reshape(b.bands, b.rows, b.cols).transpose(1, 2, 0)
                data = px.tobytes()
                rows.append((numbers[b.key], b.br, b.bc, b.br * m["grid"][1] + b.bc, zlib.compress(data) if compress else data))
            yield pd.DataFrame(rows, columns=["image", "br", "bc", "nth", "data"])

    wide = blocks.select("key", "br", "bc", "bands", "rows", "cols", "dtype", "payload")
    folder, name = os.path.split(os.path.abspath(path))
    hidden = f"{folder}/.{name}.{uuid4().hex}"
    staged = None
    try:
        if compress:
            staged = work or f"{hidden}.tiles"
            wide.mapInPandas(encode, ENCODED).write.parquet(staged)
            tiles = spark.read.parquet(staged)
            sizes = tiles.select("image", "br", "bc", "nth", F.octet_length("data").cast("long").alias("size"))
            wholes = {r["image"]: r["whole"] for r in sizes.groupBy("image").agg(F.sum("size").alias("whole")).collect()}  # a row for each image
            starts = []
            for i in range(len(images)):
                starts.append(at)
                at += wholes[i]
            total = at
            first = F.get(F.array(*[F.lit(a).cast("long") for a in starts]), F.col("image"))
            placed = tiles.join(running_places(sizes).select("image", "nth", (first + F.col("within")).alias("offset")), ["image", "nth"])
        else:  # all tiles of an image have one size, so places need no sums
            tiles = wide.mapInPandas(encode, ENCODED)
            starts = []
            for m in images:
                tile = m["tile"][0] * m["tile"][1] * m["bands"] * m["dtype"].itemsize
                starts.append((at, tile))
                at += tile * m["grid"][0] * m["grid"][1]
            total = at
            base = F.array(*[F.struct(F.lit(a).cast("long").alias("at"), F.lit(t).cast("long").alias("tile")) for a, t in starts])
            placed = tiles.withColumn("offset", F.get(base, F.col("image"))["at"] + F.col("nth") * F.get(base, F.col("image"))["tile"])
        tables = F.array(*[F.struct(F.lit(m["entries"]).cast("long").alias("entries"), F.lit(m["counts"]).cast("long").alias("counts")) for m in images])
        mine = F.get(tables, F.col("image"))
        with open(hidden, "wb") as file:
            file.truncate(total)
        spark.dataSource.register(PlacedSource)
        rows = placed.select("offset", "data", (mine["entries"] + F.col("nth") * 8).alias("entry"), (mine["counts"] + F.col("nth") * 8).alias("counts"))
        rows.write.format("tileweave_placed").mode("append").option("hidden", hidden).option("headers", json.dumps(headers)).save(path)
    finally:
        if os.path.exists(hidden):
            os.remove(hidden)
        if staged and not work:
            import shutil

            shutil.rmtree(staged, ignore_errors=True)
    return total
