"""PNG: chunks, inflated and unfiltered rows; palettes stay indexes."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from . import Asset, FormatError, unpacked

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel of a colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: First row and column, and steps, of each pass of an interlaced image.
PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def _chunks(data: bytes):
    at = 8
    while at + 8 <= len(data):
        size, kind = unpacked(">I4s", data, at)
        yield kind, data[at + 8 : at + 8 + size], at + 8
        at += 12 + size


def assets(data: bytes) -> list[Asset]:
    if data[:8] != SIGNATURE:
        raise FormatError("no PNG signature")
    meta: dict = {}
    header, first, total = None, 0, 0
    for kind, body, at in _chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            first, total = first or at, total + len(body)
        elif kind == b"tEXt":
            k, _, v = body.partition(b"\0")
            meta[k.decode("latin-1")] = v.decode("latin-1")
        elif kind == b"zTXt":
            k, _, v = body.partition(b"\0")
            meta[k.decode("latin-1")] = zlib.decompress(v[1:]).decode("latin-1")
        elif kind == b"iTXt":
            k, _, rest = body.partition(b"\0")
            packed, rest = rest[0], rest[2:].split(b"\0", 2)[2]
            meta[k.decode("latin-1")] = (zlib.decompress(rest) if packed else rest).decode()
        elif kind == b"gAMA":
            meta["gAMA"] = struct.unpack(">I", body)[0] / 100000
        elif kind == b"pHYs":
            meta["pHYs"] = list(struct.unpack(">IIB", body))
        elif kind == b"PLTE":
            meta["PLTE"] = [list(body[i : i + 3]) for i in range(0, len(body), 3)]
    if header is None:
        raise FormatError("no header chunk")
    cols, rows, depth, colour, _, _, interlace = header
    meta["IHDR"] = {"width": cols, "height": rows, "bit_depth": depth, "color_type": colour, "interlace": interlace}
    return [Asset("image:0", rows=rows, cols=cols, bands=SAMPLES[colour], bh=rows, bw=cols, dtype="uint16" if depth == 16 else "uint8", bits=depth, offset=first, length=total, metadata=meta, private={"interlace": interlace})]


def _unfiltered(raw: bytes, rows: int, stride: int, step: int) -> np.ndarray:
    lines = np.frombuffer(raw, np.uint8, rows * (stride + 1)).reshape(rows, stride + 1)
    out = np.zeros((rows + 1, stride + step), np.uint8)  # a row above and samples to the left, all zero
    for y in range(rows):
        kind, line, above, own = int(lines[y, 0]), lines[y, 1:], out[y], out[y + 1]
        if kind == 0:
            own[step:] = line
        elif kind == 1:
            padded = np.zeros(-(-stride // step) * step, np.uint8)
            padded[:stride] = line
            own[step:] = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:stride]
        elif kind == 2:
            own[step:] = line + above[step:]
        elif kind in (3, 4):
            up, cur = above.tolist(), own.tolist()
            for x, v in enumerate(line.tolist(), step):
                a, b = cur[x - step], up[x]
                if kind == 3:
                    cur[x] = (v + (a + b) // 2) & 255
                else:
                    c = up[x - step]
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    cur[x] = (v + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
            own[:] = cur
        else:
            raise FormatError(f"no row filter {kind}")
    return out[1:, step:]


def _samples(raw: bytes, rows: int, cols: int, bands: int, bits: int) -> np.ndarray:
    """Samples (rows, cols, bands) of filtered rows."""
    stride = -(-cols * bands * bits // 8)
    lines = _unfiltered(raw, rows, stride, max(1, bands * bits // 8))
    if bits == 16:
        px = np.ascontiguousarray(lines).view(">u2").astype(np.uint16)
    elif bits == 8:
        px = lines
    else:
        ones = np.unpackbits(np.ascontiguousarray(lines), axis=1)[:, : cols * bits].reshape(rows, cols, bits)
        px = ones @ (1 << np.arange(bits - 1, -1, -1)).astype(np.uint8)
    return px.reshape(rows, cols, bands)


def block(data: bytes, asset: Asset, br: int, bc: int) -> np.ndarray:
    asset.extent(br, bc)
    raw = zlib.decompress(b"".join(body for kind, body, _ in _chunks(data) if kind == b"IDAT"))
    if asset.private.get("interlace"):
        px, at = np.zeros((asset.rows, asset.cols, asset.bands), asset.dtype), 0
        for y, x, dy, dx in PASSES:
            rows, cols = -(-(asset.rows - y) // dy), -(-(asset.cols - x) // dx)
            if rows > 0 and cols > 0:
                size = rows * (1 + -(-cols * asset.bands * asset.bits // 8))
                px[y::dy, x::dx] = _samples(raw[at : at + size], rows, cols, asset.bands, asset.bits)
                at += size
    else:
        px = _samples(raw, asset.rows, asset.cols, asset.bands, asset.bits)
    if asset.bits < 8 and asset.metadata["IHDR"]["color_type"] == 0:
        px = px * (255 // ((1 << asset.bits) - 1))
    return np.ascontiguousarray(px.transpose(2, 0, 1)).astype(asset.dtype)


def ranges(asset: Asset) -> dict[tuple[int, int], list[tuple[int, int]]]:
    return {(0, 0): [(asset.offset, asset.length)]}


def encode(image: np.ndarray, metadata: dict | None = None, bits: int | None = None) -> bytes:
    """One to four bands of uint8 or uint16; string metadata become text chunks, PLTE a palette.

    ``bits`` (1, 2 or 4) packs one band of small values, or of grey levels that so few bits can say.
    """
    bands, rows, cols = image.shape
    if image.dtype not in (np.uint8, np.uint16) or not 1 <= bands <= 4:
        raise FormatError("PNG holds one to four bands of uint8 or uint16")
    meta = metadata or {}
    colour = 3 if "PLTE" in meta and bands == 1 else {1: 0, 2: 4, 3: 2, 4: 6}[bands]
    samples = np.ascontiguousarray(image.transpose(1, 2, 0)).astype(">u2" if image.dtype == np.uint16 else np.uint8)
    lines = samples.reshape(rows, -1).view(np.uint8).reshape(rows, -1)
    if bits in (1, 2, 4):
        step = 1 if colour == 3 else 255 // ((1 << bits) - 1)
        if bands != 1 or image.dtype != np.uint8 or (lines % step).any() or (lines // step >> bits).any():
            raise FormatError(f"these samples don't fit {bits} bits")
        ones = (lines // step)[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8) & 1
        lines = np.packbits(ones.reshape(rows, -1), axis=1)
    elif bits not in (None, image.dtype.itemsize * 8):
        raise FormatError(f"PNG has no {bits} bits of {image.dtype}")
    raw = np.hstack([np.zeros((rows, 1), np.uint8), lines]).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    out = SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", cols, rows, bits or image.dtype.itemsize * 8, colour, 0, 0, 0))
    if colour == 3:
        out += chunk(b"PLTE", bytes(v for entry in meta["PLTE"] for v in entry))
    for k, v in meta.items():
        if isinstance(v, str):
            out += chunk(b"tEXt", k.encode("latin-1") + b"\0" + v.encode("latin-1", "replace"))
    return out + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
