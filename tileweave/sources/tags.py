"""TIFF tags by name, with named values and own names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formats.tiff import TAGS

#: Names of tag values.
VALUES = {
    "Compression": {"none": 1, "ccittrle": 2, "ccittfax3": 3, "ccittfax4": 4, "lzw": 5, "ojpeg": 6, "jpeg": 7, "deflate": 8, "packbits": 32773, "adobe_deflate": 32946},
    "PhotometricInterpretation": {"miniswhite": 0, "white_is_zero": 0, "minisblack": 1, "black_is_zero": 1, "rgb": 2, "palette": 3, "mask": 4, "ycbcr": 6},
    "Orientation": {"topleft": 1, "topright": 2, "bottomright": 3, "bottomleft": 4, "lefttop": 5, "righttop": 6, "rightbottom": 7, "leftbottom": 8},
    "PlanarConfiguration": {"chunky": 1, "planar": 2, "separate": 2},
    "Predictor": {"none": 1, "horizontal": 2, "floatingpoint": 3, "float": 3},
    "SampleFormat": {"uint": 1, "int": 2, "float": 3, "void": 4},
}


class TagNames:
    """Names to numbers; own names win over the standard ones."""

    def __init__(self, own: Mapping[str, int] | None = None):
        self.numbers = {**TAGS, **(own or {})}

    def key(self, name: str) -> str:
        """The key of a tag in metadata: its number as text; other names pass through."""
        return str(self.numbers[name]) if name in self.numbers else name

    def value(self, name: str, value):
        """A value, or the number of a named one, whose case doesn't count."""
        return VALUES.get(name, {}).get(value.lower(), value) if isinstance(value, str) else value

    def get(self, entries: Mapping, name: str, default=None):
        return entries.get(self.key(name), default)

    def set(self, entries: dict, name: str, value) -> None:
        entries[self.key(name)] = self.value(name, value)

    def column(self, entries: Column, name: str) -> Column:
        """The tag's entry of a map column; null without it."""
        return F.try_element_at(entries, F.lit(self.key(name)))


def inferred(value) -> tuple[str, list]:
    """TIFF type and values of a metadata value: text, 16 or 32-bit integers, doubles; ``{value, type}`` states the type."""
    if isinstance(value, Mapping) and "value" in value and "type" in value:
        values = value["value"]
        return str(value["type"]).upper(), values if isinstance(values, list) else [values]
    if isinstance(value, str):
        return "ASCII", [value]
    values = value if isinstance(value, list) else [value]
    if all(isinstance(v, bool) or isinstance(v, int) for v in values):
        if all(0 <= v < 65536 for v in values):
            return "SHORT", values
        return ("LONG" if all(0 <= v < 1 << 32 for v in values) else "DOUBLE"), values
    return "DOUBLE", [float(v) for v in values]


def custom(entries: Mapping) -> dict:
    """Entries that a writer passes on: numbers from 32768 up that aren't structural."""
    return {k: v for k, v in entries.items() if str(k).isdigit() and int(k) >= 32768}
