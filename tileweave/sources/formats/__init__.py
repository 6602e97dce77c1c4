"""Container formats over plain bytes: headers, blocks and encoders."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np


class FormatError(ValueError):
    """Bytes that aren't of the format, or use a part of it that isn't supported."""


def unpacked(code: str, data, at: int) -> tuple:
    """Numbers at a place of bytes, or of a file that is read by ranges."""
    return struct.unpack(code, data[at : at + struct.calcsize(code)])


_PLUGINS: dict[str, tuple[Callable | None, Callable | None]] = {}


def register_codec(name: str, decode: Callable | None = None, encode: Callable | None = None) -> None:
    """Hooks for coded blocks by name: a NITF compression as ``nitf:C3``, a TIFF one as ``tiff:7``, or a format.

    ``decode(data, asset, block_row, block_col)`` gives an array (bands, rows, cols) of at least the
    block's recorded size; ``encode(array, metadata)`` gives the block's bytes.  Scans, sinks and the data
    source take the functions known when they are made along to the workers, so they must be picklable.
    """
    _PLUGINS[name] = decode, encode


def registered_codecs() -> dict[str, tuple[Callable | None, Callable | None]]:
    """The codecs known now, to be sent to where they are used."""
    return dict(_PLUGINS)


def using(codecs: dict[str, tuple[Callable | None, Callable | None]]) -> None:
    """Makes codecs that came with a task known in its worker; those of an earlier task give way."""
    _PLUGINS.clear()
    _PLUGINS.update(codecs)


def registered(name: str) -> bool:
    return name in _PLUGINS


def plugin(name: str) -> Callable:
    decode = _PLUGINS.get(name, (None, None))[0]
    if decode is None:
        raise FormatError(f"no codec is registered for {name}")
    return decode


def plugin_encode(name: str) -> Callable:
    encode = _PLUGINS.get(name, (None, None))[1]
    if encode is None:
        raise FormatError(f"no encoder is registered for {name}")
    return encode


@dataclass
class Asset:
    """One asset of a container; ``ranges`` lists the byte ranges of each (band plane,) block row and column."""

    key: str
    kind: str = "image"
    roles: tuple[str, ...] = ("data",)
    rows: int = 0
    cols: int = 0
    bands: int = 0
    bh: int = 0
    bw: int = 0
    levels: int = 1
    dtype: str = ""
    bits: int = 0
    offset: int = 0
    length: int = 0
    metadata: dict = field(default_factory=dict)
    private: dict = field(default_factory=dict)

    @property
    def grid(self) -> tuple[int, int]:
        return (-(-self.rows // self.bh) if self.bh else 1, -(-self.cols // self.bw) if self.bw else 1)

    def extent(self, br: int, bc: int) -> tuple[int, int]:
        """Rows and columns of a block that lie in the image."""
        if not (0 <= br < self.grid[0] and 0 <= bc < self.grid[1]):
            raise FormatError(f"{self.key} has no block {br}, {bc}")
        return min(self.bh, self.rows - br * self.bh), min(self.bw, self.cols - bc * self.bw)


def padded(tile: np.ndarray, height: int, width: int, value=0) -> np.ndarray:
    """A tile (bands, rows, cols) filled up to its nominal size."""
    return np.pad(tile, ((0, 0), (0, height - tile.shape[1]), (0, width - tile.shape[2])), constant_values=value)
