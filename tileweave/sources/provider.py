"""Images that a user's own object provides, as a Spark data source.

A provider lists its images and gives single blocks; Spark asks it only for blocks that
filters leave, in tasks that each take a range of an image's blocks.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .datasource import DECODED, Wanted
from .scan import BLOCKS

#: Blocks of a partition, at most.
BLOCKS_AT_ONCE = 256


@dataclass(frozen=True)
class ProvidedImage:
    """What a provider says of an image; ``path`` and ``key`` name it."""

    path: str
    key: str
    rows: int
    cols: int
    bh: int
    bw: int
    level: int = 0

    @property
    def grid(self) -> tuple[int, int]:
        return -(-self.rows // self.bh), -(-self.cols // self.bw)


class Provider(Protocol):
    """What a user's object has; it is pickled and sent to the tasks, so it holds no open files."""

    def images(self) -> Iterable[ProvidedImage]:
        """Called on the driver, once a plan."""

    def block(self, image: ProvidedImage, br: int, bc: int) -> np.ndarray | None:
        """Samples (bands, rows, cols) of a block, or nothing where none is recorded; called in tasks, and again if one is lost."""


class BlockRange(InputPartition):
    """Blocks ``first`` to ``last`` - 1 of an image's wanted blocks, row by row."""

    def __init__(self, image: ProvidedImage, first: int, last: int):
        super().__init__(None)
        self.image, self.first, self.last = image, first, last


class ProvidedReader(DataSourceReader):
    def __init__(self, provider: Provider, columns: list[str]):
        self.provider, self.columns, self.wanted = provider, columns, Wanted()

    def pushFilters(self, filters):
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def _places(self, image: ProvidedImage):
        return self.wanted.numbers("br", image.grid[0]), self.wanted.numbers("bc", image.grid[1])

    def partitions(self):
        out = []
        for image in self.provider.images():
            if self.wanted.path(image.path) and self.wanted.holds("key", image.key) and self.wanted.holds("level", image.level):
                rows, cols = self._places(image)
                n = len(rows) * len(cols)
                out += [BlockRange(image, i, min(n, i + BLOCKS_AT_ONCE)) for i in range(0, n, BLOCKS_AT_ONCE)]
        return out or [BlockRange(None, 0, 0)]

    def read(self, partition: BlockRange):
        image = partition.image
        if image is None:
            return
        rows, cols = self._places(image)
        decoded = not DECODED.isdisjoint(self.columns)
        for i in range(partition.first, partition.last):
            br, bc = rows[i // len(cols)], cols[i % len(cols)]
            row = {"path": image.path, "key": image.key, "level": image.level, "br": br, "bc": bc}
            if decoded:
                px = self.provider.block(image, br, bc)
                if px is None:
                    continue
                if px.ndim != 3:
                    raise ValueError(f"block {br}, {bc} of {image.key}: three dimensions wanted, {px.ndim} given")
                row |= {"bands": px.shape[0], "rows": px.shape[1], "cols": px.shape[2], "dtype": px.dtype.name, "payload": np.ascontiguousarray(px).tobytes()}
            yield tuple(row[c] for c in self.columns)


def register_provider(spark: SparkSession, name: str, provider: Provider) -> None:
    """Makes ``spark.read.format(name)`` a table of the provider's blocks; filters and a given schema work as for files."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return BLOCKS

        def reader(self, schema) -> ProvidedReader:
            return ProvidedReader(provider, [f.name for f in schema.fields])

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Source)


def provided_blocks(spark: SparkSession, provider: Provider, name: str = "provided") -> DataFrame:
    """All blocks of a provider; filters on path, key, level, br and bc reach it."""
    register_provider(spark, name, provider)
    return spark.read.format(name).load()
