"""Short forms for whole images: info, read, save, tiles."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import level_checks
from ..operators.raster import tile_grid
from ..operators.segments import EXTENSIONS, default_asset
from ..operators.validate import ARRAY_TYPES
from .chips import assembled_windows, window_pieces
from .codecs import FORMATS
from .formats import FormatError
from .scan import files, scan_assets, scan_blocks, tile_index, with_pyramid
from .sinks import assembled, encoded, save_files


def image_info(spark: SparkSession, paths: str | Sequence[str], key: str | None = None, fmt: str | None = None) -> DataFrame:
    """Sizes, type and metadata of the wanted image of each file, else its first image with role data, else its first."""
    found = scan_assets(files(spark, paths), fmt).where("kind = 'image'")
    chosen = found.where(F.col("key") == key) if key else default_asset(found, ["path"], "roles", "key")
    return chosen.select("path", "format", "key", "rows", "cols", "bands", "dtype", "bh", "bw", "levels", "metadata")


def read_image(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, bands: Sequence[int] | None = None, key: str = "image:0", fmt: str | None = None, fill=0) -> np.ndarray:
    """A window (y, x, height, width) of one image as an array (bands, rows, cols); only the blocks that it meets are decoded.

    The window is clipped to the image; blocks that aren't recorded hold ``fill``.
    """
    info = image_info(spark, path, key, fmt).first()
    if info is None:
        raise FormatError(f"{path} has no image {key}")
    y, x, h, w = window or (0, 0, info["rows"], info["cols"])
    if y < 0 or x < 0 or h <= 0 or w <= 0 or y >= info["rows"] or x >= info["cols"]:
        raise FormatError(f"no window {window} in {info['rows']} x {info['cols']}")
    h, w = min(h, info["rows"] - y), min(w, info["cols"] - x)
    blocks = scan_blocks(files(spark, path), key, fmt, (y, y + h - 1), (x, x + w - 1), bands)
    out = np.full((len(bands) if bands is not None else info["bands"], h, w), fill, info["dtype"])
    for b in blocks.toLocalIterator():
        px = np.frombuffer(b["payload"], b["dtype"]).reshape(b["bands"], b["rows"], b["cols"])
        top, left = b["br"] * info["bh"], b["bc"] * info["bw"]
        y0, y1, x0, x1 = max(y, top), min(y + h, top + b["rows"]), max(x, left), min(x + w, left + b["cols"])
        out[:, y0 - y : y1 - y, x0 - x : x1 - x] = px[:, y0 - top : y1 - top, x0 - left : x1 - left]
    return out


#: Sample types that the encoders here have beyond those of ``ARRAY_TYPES``.
MORE_TYPES = {f: ("int8", "uint32", "int32", "uint64", "int64", "float64", "complex64") for f in ("nitf", "nsif", "tiff")}


def save_image(spark: SparkSession, path: str, image: np.ndarray, fmt: str, **options) -> None:
    """An array (rows, cols) or (bands, rows, cols) as a file."""
    image = image[None] if image.ndim == 2 else image
    if image.ndim != 3 or 0 in image.shape:
        raise FormatError("an image has two or three dimensions, none of them zero")
    if image.dtype.name not in ARRAY_TYPES.get("nitf" if fmt == "nsif" else fmt, ()) and image.dtype.name not in MORE_TYPES.get(fmt, ()):
        raise FormatError(f"{fmt} has no samples of type {image.dtype.name}")
    folder, _, name = path.rpartition("/")
    row = (name, "image:0", 0, 0, 0, *map(int, image.shape), image.dtype.name, bytearray(np.ascontiguousarray(image).tobytes()))
    blocks = spark.createDataFrame([row], "path string, key string, level int, br int, bc int, bands int, rows int, cols int, dtype string, payload binary")
    save_files(encoded(blocks, fmt, **options), folder).collect()


def image_tiles(spark: SparkSession, path: str, size: tuple[int, int], overlap: tuple[int, int] = (0, 0), bands: Sequence[int] | None = None, key: str | None = "image:0", fmt: str | None = None, fill=0) -> Iterator[tuple[int, int, np.ndarray]]:
    """Tiles (row, column, array) of an image in row-major order; tiles at the edge are clipped.

    All tiles are one table of windows and one job; the iterator holds a partition of them.
    """
    info = image_info(spark, path, key, fmt).first()
    if info is None:
        raise FormatError(f"{path} has no image {key}")
    one = spark.createDataFrame([(info["path"], info["key"], info["rows"], info["cols"])], "path string, key string, rows int, cols int")
    tiles = tile_grid(one, *size, overlap).select("path", "key", "tr", "tc", "y", "x", "h", "w")
    made = assembled_windows(window_pieces(spark, tiles), ["tr", "tc"], fill).select("tr", "tc", "payload")
    placed = tiles.select("tr", "tc", "h", "w").join(made, ["tr", "tc"], "left").orderBy("tr", "tc")
    for t in placed.toLocalIterator():
        shape = (info["bands"], t["h"], t["w"])
        px = np.full(shape, fill, info["dtype"]) if t["payload"] is None else np.frombuffer(t["payload"], info["dtype"]).reshape(shape)
        yield t["tr"], t["tc"], px if bands is None else px[list(bands)]


_ROLE = re.compile(r"^(data|metadata|thumbnail|overview:[1-9]\d*)$")


def normalised_roles(roles, sources: int) -> list[list[str]] | None:
    """Roles by source: a list of names for one source, or a list of such lists, one for each."""
    if roles is None:
        return None
    lists = [list(roles)] if all(isinstance(r, str) for r in roles) else [list(r) for r in roles]
    if len(lists) != sources:
        raise ValueError(f"roles of {len(lists)} sources for {sources}")
    for role in (r for own in lists for r in own):
        if not _ROLE.match(role):
            raise ValueError(f"no role {role!r}")
    if sum("data" in own for own in lists) > 1:
        raise ValueError("several sources have the role data")
    return lists


def format_for(path: str, explicit: str | None = None) -> str:
    """A format by name, else by the extension under any ``.rN``."""
    if explicit:
        if explicit not in FORMATS:
            raise ValueError(f"no format {explicit!r}")
        return explicit
    name = re.sub(r"\.r\d+$", "", path.rstrip("/").rsplit("/", 1)[-1])
    found = EXTENSIONS.get(name.rpartition(".")[2].lower())
    if found is None:
        raise ValueError(f"no format is known by the name {name!r}")
    return found


class Dataset:
    """One or several files opened for reading: tables of assets, blocks and byte ranges.

    Several paths are levels of one dataset: the source of role data (else the first) is its base, and the
    others are overviews, by their roles or by ``.rN``.
    """

    def __init__(self, spark: SparkSession, paths: list[str], fmt: str | None, roles: list[list[str]] | None):
        self.spark, self.paths, self.format, self.roles = spark, paths, fmt, roles
        self.files = files(spark, paths)

    def assets(self, kind: str | None = None) -> DataFrame:
        found = with_pyramid(scan_assets(self.files, self.format))
        if self.roles:
            roles, place = F.col("roles"), F.regexp_replace("path", "^file:/+", "/")
            for path, own in zip(self.paths, self.roles):
                whole = path if "://" in path and not path.startswith("file:") else os.path.abspath(re.sub("^file:/+", "/", path))
                roles = F.when(place == whole, F.array(*[F.lit(r) for r in own])).otherwise(roles)
            found = found.withColumn("roles", roles)
        return found if kind is None else found.where(F.col("kind") == kind)

    def levels(self) -> DataFrame:
        """Images by base, key of the full one and level, with their scale to the base and whether each nests in the level before."""
        found = self.assets("image").withColumn("image", F.regexp_replace("key", ":overview:\\d+$", ""))
        number = F.coalesce(F.regexp_extract("key", ":overview:(\\d+)$", 1).try_cast("int"), F.lit(0))
        placed = found.select("base", "image", "path", "key", number.alias("level"), "rows", "cols")
        base = placed.where("level = 0").select("base", "image", F.col("rows").alias("_full"))
        scaled = placed.join(base, ["base", "image"], "left").withColumn("scale", F.col("_full") / F.col("rows")).drop("_full")
        return level_checks(scaled, ["base", "image"], "level", "rows", "cols")

    def blocks(self, key: str | None = None, **window) -> DataFrame:
        return scan_blocks(self.files, key, self.format, **window)

    def tile_index(self) -> DataFrame:
        return tile_index(self.files, self.format)


class Target:
    """A file, or a level of files, opened for writing; ``save`` takes a table of blocks."""

    def __init__(self, spark: SparkSession, paths: list[str], fmt: str | None, roles: list[list[str]] | None):
        self.spark, self.paths, self.roles = spark, paths, roles
        self.formats = [format_for(p, fmt) for p in paths]
        if len(set(self.formats)) > 1:
            raise ValueError("levels of one dataset have one format")

    def save(self, blocks: DataFrame, **options) -> None:
        """Blocks of level n go to the n-th path (a single path takes all levels)."""
        if blocks.groupBy("key", "level", "br", "bc").count().where("count > 1").limit(1).count():
            raise ValueError("a block stands twice")
        for n, path in enumerate(self.paths):
            folder, _, name = path.rpartition("/")
            own = blocks.where(F.col("level") == n) if len(self.paths) > 1 else blocks
            if len(self.paths) > 1:
                own = own.withColumns({"key": F.regexp_replace("key", ":overview:\\d+$", ""), "level": F.lit(0)})
            save_files(encoded(own.withColumn("path", F.lit(name)), self.formats[n], **options), folder or ".").collect()


def open_dataset(spark: SparkSession, paths: str | Sequence[str], mode: str = "r", fmt: str | None = None, roles=None) -> Dataset | Target:
    """A dataset of one or several paths for reading (``r``) or writing (``w``)."""
    if mode not in ("r", "w"):
        raise ValueError(f"no mode {mode!r}")
    listed = [paths] if isinstance(paths, str) else list(paths)
    if not listed:
        raise ValueError("a dataset needs a path")
    return (Dataset if mode == "r" else Target)(spark, listed, fmt, normalised_roles(roles, len(listed)))


__all__ = ["Dataset", "Target", "open_dataset", "normalised_roles", "format_for", "assembled", "image_info", "image_tiles", "read_image", "save_image"]
