"""``spark.read.format("tileweave")``: blocks of files on any file system, with pushed-down filters.

Options: ``format`` (else by the first bytes) and ``key``.  The driver lists names and
sizes only, sub-folders included; a file becomes a partition for each ``SPLIT`` bytes, and each task
reads the file's headers itself and takes its share of the blocks that filters leave, by ranges.

Equality, ``IN`` and comparisons on ``br``, ``bc`` and ``level`` become ranges of blocks,
equality and ``IN`` on ``key`` choose images, and equality, ``IN`` and prefixes of ``path`` leave files
unopened.  A schema given to the reader (``.schema("path string, br int, bc int")``) names the wanted columns: without
``payload`` nothing but headers is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from .ranged import Ranged, file_system
from .scan import BLOCKS

#: Bytes of a file for each of its partitions.
SPLIT = 64 << 20
NUMBERS, NAMES = ("level", "br", "bc"), ("path", "key")
#: Columns that need a block's samples.
DECODED = frozenset(("bands", "rows", "cols", "dtype", "payload"))


@dataclass
class Wanted:
    """What pushed filters leave: values of names, ranges and values of numbers, prefixes of paths."""

    values: dict[str, set] = field(default_factory=dict)
    low: dict[str, int] = field(default_factory=dict)
    high: dict[str, int] = field(default_factory=dict)
    prefixes: list[str] = field(default_factory=list)

    def take(self, f: Filter) -> bool:
        """Whether the filter is dealt with here."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if isinstance(f, (EqualTo, In)) and name in NUMBERS + NAMES:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.values[name] = self.values.get(name, values) & values
        elif isinstance(f, StringStartsWith) and name == "path":
            self.prefixes.append(f.value)
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and name in NUMBERS:
            self.low[name] = max(self.low.get(name, 0), f.value + isinstance(f, GreaterThan))
        elif isinstance(f, (LessThan, LessThanOrEqual)) and name in NUMBERS:
            most = f.value - isinstance(f, LessThan)
            self.high[name] = min(self.high.get(name, most), most)
        else:
            return False
        return True

    def holds(self, name: str, value) -> bool:
        fits = name not in self.values or value in self.values[name]
        return fits and (name not in self.low or value >= self.low[name]) and (name not in self.high or value <= self.high[name])

    def path(self, path: str) -> bool:
        return self.holds("path", path) and all(path.startswith(p) for p in self.prefixes)

    def numbers(self, name: str, size: int):
        """The numbers below ``size`` that are left, in order."""
        if name in self.values:
            return sorted(v for v in self.values[name] if v is not None and 0 <= v < size and self.holds(name, v))
        return range(max(0, self.low.get(name, 0)), min(size, self.high.get(name, size - 1) + 1))


@dataclass
class FileShare(InputPartition):
    """Every ``of``-th wanted block of a file, from block ``share`` on."""

    path: str
    share: int
    of: int

    def __init__(self, path: str, share: int, of: int):
        super().__init__(None)
        self.path, self.share, self.of = path, share, of


class BlockReader(DataSourceReader):
    def __init__(self, options, columns: list[str], codecs: dict | None = None):
        self.options, self.columns, self.wanted, self.codecs = options, columns, Wanted(), codecs or {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def files(self) -> list[tuple[str, int]]:
        """Paths and sizes of the files that may hold wanted blocks; names that start with _ or . aren't data."""
        from pyarrow import fs

        path = self.options["path"]
        system, at = file_system(path)
        info = system.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
        scheme = path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
        hidden = lambda f: any(step.startswith(("_", ".")) for step in f.path[len(at) :].split("/"))
        listed = sorted((scheme + f.path, f.size) for f in found if f.type == fs.FileType.File and (f.path == at or not hidden(f)))
        return [(p, size) for p, size in listed if self.wanted.path(p)]

    def partitions(self):
        out = []
        for path, size in self.files():
            shares = max(1, -(-size // SPLIT))
            out += [FileShare(path, i, shares) for i in range(shares)]
        return out or [FileShare("", 0, 1)]

    def read(self, partition: FileShare):
        from .codecs import FORMATS, sniffed, using

        if not partition.path:
            return
        using(self.codecs)
        decoded = not DECODED.isdisjoint(self.columns)
        with Ranged(partition.path) as data:
            module = FORMATS[self.options.get("format") or sniffed(data[:16])]
            n = -1
            for asset in module.assets(data):
                level = int(asset.key.rsplit(":", 1)[1]) if ":overview:" in asset.key else 0
                if asset.kind != "image" or not self.wanted.holds("key", asset.key) or self.options.get("key", asset.key) != asset.key or not self.wanted.holds("level", level):
                    continue
                for br in self.wanted.numbers("br", asset.grid[0]):
                    for bc in self.wanted.numbers("bc", asset.grid[1]):
                        if hasattr(module, "has_block") and not module.has_block(asset, br, bc):
                            continue
                        n += 1
                        if n % partition.of != partition.share:
                            continue
                        row = {"path": partition.path, "key": asset.key, "level": level, "br": br, "bc": bc}
                        if decoded:
                            px = module.block(data, asset, br, bc)
                            row |= {"bands": int(px.shape[0]), "rows": int(px.shape[1]), "cols": int(px.shape[2]), "dtype": px.dtype.name, "payload": px.tobytes() if "payload" in self.columns else None}
                        yield tuple(row[c] for c in self.columns)


class TileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tileweave"

    def schema(self) -> str:
        return BLOCKS

    def codecs(self) -> dict:
        return {}

    def reader(self, schema) -> BlockReader:
        known = [c.split()[0] for c in BLOCKS.split(", ")]
        if unknown := [f.name for f in schema.fields if f.name not in known]:
            raise ValueError(f"no columns {unknown}; there are {known}")
        return BlockReader(self.options, [f.name for f in schema.fields], self.codecs())


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, with filters pushed down to it and the codecs that are registered now."""
    from .codecs import registered_codecs

    known = registered_codecs()

    class Source(TileSource):  # made here, so that it is sent with its codecs: Spark plans in a process of its own
        def codecs(self) -> dict:
            return known

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Source)
