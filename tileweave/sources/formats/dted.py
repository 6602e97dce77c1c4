"""DTED: three header records, then one checked record of elevations per longitude."""

from __future__ import annotations

import numpy as np

from . import Asset, FormatError

UHL, DSI, ACC = 80, 648, 2700
#: Fixed value: the elevation that stands for no data.
NO_DATA = -32767


def _angle(text: str, degrees: int) -> float:
    value = int(text[:degrees]) + int(text[degrees : degrees + 2]) / 60 + float(text[degrees + 2 : -1]) / 3600
    return -value if text[-1] in "SW" else value


def _shown(value: float, degrees: int, hemispheres: str) -> str:
    seconds = round(abs(value) * 3600)
    return f"{seconds // 3600:0{degrees}d}{seconds // 60 % 60:02d}{seconds % 60:02d}{hemispheres[value < 0]}"


def assets(data: bytes) -> list[Asset]:
    if data[:3] != b"UHL" or len(data) < UHL + DSI + ACC:
        raise FormatError("no user header label")
    text = data[:UHL].decode("latin-1")
    number = lambda a, b: int(text[a:b])
    cols, rows = number(47, 51), number(51, 55)
    accuracy = text[28:32].strip()
    meta = {
        "dted:origin_longitude": _angle(text[4:12], 3), "dted:origin_latitude": _angle(text[12:20], 3),
        "dted:longitude_interval": number(20, 24) / 10, "dted:latitude_interval": number(24, 28) / 10,
        "dted:vertical_accuracy": None if accuracy in ("NA", "") else int(accuracy), "dted:security_code": text[32:35].strip(), "dted:unique_reference": text[35:47].strip(),
        "dted:longitude_lines": cols, "dted:latitude_points": rows, "dted:multiple_accuracy": text[55:56],
    }
    return [Asset("image:0", rows=rows, cols=cols, bands=1, bh=rows, bw=cols, dtype="int16", bits=16, offset=UHL + DSI + ACC, length=cols * (12 + 2 * rows), metadata=meta)]


def to_elevation(raw: np.ndarray) -> np.ndarray:
    """Sign and magnitude to numbers; all bits set means no data."""
    raw = raw.astype(np.int32)
    value = np.where(raw & 0x8000, -(raw & 0x7FFF), raw)
    return np.where(raw == 0xFFFF, NO_DATA, value).astype(np.int16)


def from_elevation(value: np.ndarray) -> np.ndarray:
    value = value.astype(np.int32)
    raw = np.where(value < 0, -value | 0x8000, value)
    return np.where(value == NO_DATA, 0xFFFF, raw).astype(">u2")


def columns(data: bytes, asset: Asset, first: int, count: int, check: bool = True) -> np.ndarray:
    """Elevations (rows from north to south, columns) of some longitude records."""
    size = 12 + 2 * asset.rows
    at = asset.offset + first * size
    raw = np.frombuffer(data[at : at + count * size], np.uint8, count * size).reshape(count, size)
    if check:
        if (raw[:, 0] != 0xAA).any():
            raise FormatError("a record without its sentinel")
        sums = raw[:, :-4].sum(axis=1, dtype=np.int64)
        stated = raw[:, -4:].astype(np.int64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1])
        if (sums != stated).any():
            raise FormatError(f"checksum of record {first + int(np.flatnonzero(sums != stated)[0])}")
    posts = raw[:, 8:-4].copy().view(">u2")
    return to_elevation(posts)[:, ::-1].T


def block(data: bytes, asset: Asset, br: int, bc: int) -> np.ndarray:
    asset.extent(br, bc)
    return columns(data, asset, 0, asset.cols)[None]


def ranges(asset: Asset) -> dict[tuple[int, int], list[tuple[int, int]]]:
    return {(0, 0): [(asset.offset, asset.length)]}


def encode(image: np.ndarray, metadata: dict | None = None) -> bytes:
    """One band of int16, rows from north to south."""
    if image.dtype != np.int16 or image.ndim != 3 or image.shape[0] != 1:
        raise FormatError("DTED holds one band of int16")
    meta = metadata or {}
    rows, cols = image.shape[1:]
    lon, lat = meta.get("dted:origin_longitude", 0.0), meta.get("dted:origin_latitude", 0.0)
    steps = [meta.get(f"dted:{k}_interval", 3600 / max(1, n - 1)) for k, n in (("longitude", cols), ("latitude", rows))]
    accuracy = meta.get("dted:vertical_accuracy")
    uhl = f"UHL1{_shown(lon, 3, 'EW')}{_shown(lat, 3, 'NS')}{round(steps[0] * 10):04d}{round(steps[1] * 10):04d}{'NA  ' if accuracy is None else f'{accuracy:04d}'}{meta.get('dted:security_code', 'U'):<3}{meta.get('dted:unique_reference', ''):<12}{cols:04d}{rows:04d}0"
    out = bytearray(uhl.ljust(UHL).encode() + b"DSIU".ljust(DSI) + b"ACC".ljust(ACC))
    posts = from_elevation(image[0])[::-1]
    for c in range(cols):
        body = b"\xaa" + c.to_bytes(3, "big") + c.to_bytes(2, "big") + b"\0\0" + posts[:, c].tobytes()
        out += body + sum(body).to_bytes(4, "big")
    return bytes(out)
