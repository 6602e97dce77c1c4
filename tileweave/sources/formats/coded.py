"""JPEG 2000 and JPEG: headers and byte ranges; entropy decoding is left to plug-ins."""

from __future__ import annotations

import struct

from . import Asset, FormatError, unpacked

JP2 = b"\x00\x00\x00\x0cjP  \r\n\x87\n"


def codestream(data: bytes) -> tuple[int, int]:
    """Place of the codestream in a JP2 file; a bare codestream is all of it."""
    if data[:2] == b"\xff\x4f":
        return 0, len(data)
    if data[:12] != JP2:
        raise FormatError("no JPEG 2000 signature")
    at = 0
    while at + 8 <= len(data):
        size, kind = unpacked(">I4s", data, at)
        head = 8
        if size == 1:
            size, head = unpacked(">Q", data, at + 8)[0], 16
        if size == 0:
            size = len(data) - at
        if kind == b"jp2c":
            return at + head, at + size
        if size < head:
            break
        at += size
    raise FormatError("no codestream box")


def main_header(code: bytes) -> dict:
    """Sizes and levels of the main header, and where the first tile-part starts."""
    at, out = 2, {}
    while at + 4 <= len(code):
        marker, size = unpacked(">HH", code, at)
        if marker == 0xFF90:
            out["first"] = at
            return out
        if marker == 0xFF51:
            x1, y1, x0, y0, tw, th, tx, ty, bands = unpacked(">IIIIIIIIH", code, at + 6)
            depth = code[at + 40]
            out |= {"cols": x1 - x0, "rows": y1 - y0, "bw": tw, "bh": th, "bands": bands, "bits": (depth & 127) + 1, "signed": bool(depth & 128), "tiles": (-(-(y1 - ty) // th), -(-(x1 - tx) // tw))}
        elif marker == 0xFF52:
            out["levels"] = code[at + 9] + 1
        elif marker == 0xFF55:
            out.setdefault("tlm", []).append((at, size))
        at += 2 + size
    raise FormatError("no tile-part")


def tile_parts(code: bytes, first: int) -> list[tuple[int, int, int]]:
    """Tile, offset and length of each tile-part; a length of 0 reaches to the end of the data."""
    out, at = [], first
    while code[at : at + 2] == b"\xff\x90":
        tile, size = unpacked(">HI", code, at + 4)
        size = size or len(code) - at - (2 if code[-2:] == b"\xff\xd9" else 0)
        out.append((tile, at, size))
        at += size
    return out


def tile_lengths(body: bytes, start: int) -> list[tuple[int, int, int]]:
    """As ``tile_parts``, from the body of a TLM marker: index and length of each part, running offsets."""
    form = body[1]
    index_size, size_size = (form >> 4) & 3, 4 if form & 0x40 else 2
    out, at, n = [], 2, 0
    while at < len(body):
        tile = int.from_bytes(body[at : at + index_size], "big") if index_size else n
        size = int.from_bytes(body[at + index_size : at + index_size + size_size], "big")
        out.append((tile, start, size))
        start, at, n = start + size, at + index_size + size_size, n + 1
    return out


def minimal(code: bytes, header_end: int, parts: list[tuple[int, int]]) -> bytes:
    """A codestream of one tile: the main header, the parts renumbered to tile 0, and the end marker."""
    out = bytearray(code[:header_end])
    for at, size in parts:
        part = bytearray(code[at : at + size])
        part[4:6] = b"\0\0"
        out += part
    return bytes(out + b"\xff\xd9")


def with_tile_size(code: bytes, rows: int, cols: int) -> bytes:
    """A codestream whose SIZ describes one tile of the given size at the origin; a full tile stays as it is."""
    at = 2
    while at + 4 <= len(code):
        marker, size = unpacked(">HH", code, at)
        if marker == 0xFF51:
            tw, th = unpacked(">II", code, at + 22)
            if (rows, cols) == (th, tw):
                return code
            out = bytearray(code)
            struct.pack_into(">IIIIIIII", out, at + 6, cols, rows, 0, 0, cols, rows, 0, 0)
            return bytes(out)
        at += 2 + size
    raise FormatError("no SIZ marker")


def decompositions(wanted: int, rows: int, cols: int) -> int:
    """Decomposition levels that a tile of this size can have."""
    return max(0, min(wanted, min(rows, cols).bit_length() - 1))


def band_sequential(px):
    """Samples by pixel (rows, cols, bands) as planes."""
    return px.transpose(2, 0, 1).copy()


def assets(data: bytes) -> list[Asset]:
    if data[:2] == b"\xff\xd8":
        return [_jpeg(data)]
    start, end = codestream(data)
    code = bytes(data[start:end])
    head = main_header(code)
    bits = head["bits"]
    dtype = ("int" if head["signed"] else "uint") + ("8" if bits <= 8 else "16" if bits <= 16 else "32")
    parts = [(t, start + o, n) for t, o, n in tile_parts(code, head["first"])]
    return [Asset("image:0", rows=head["rows"], cols=head["cols"], bands=head["bands"], bh=min(head["bh"], head["rows"]), bw=min(head["bw"], head["cols"]), levels=head.get("levels", 1), dtype=dtype, bits=bits, offset=start, length=end - start, private={"parts": parts, "tiles": head["tiles"], "kind": "j2k"})]


def _jpeg(data: bytes) -> Asset:
    at = 2
    while at + 4 <= len(data):
        marker, size = unpacked(">HH", data, at)
        if 0xFFC0 <= marker <= 0xFFCF and marker not in (0xFFC4, 0xFFC8, 0xFFCC):
            bits, rows, cols, parts = unpacked(">BHHB", data, at + 4)
            return Asset("image:0", rows=rows, cols=cols, bands=1 if parts == 1 else 3, bh=rows, bw=cols, dtype="uint8", bits=bits, offset=0, length=len(data), private={"kind": "jpeg"})
        at += 2 + size
    raise FormatError("no frame header")


def ranges(asset: Asset) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Byte ranges of each tile: its parts in codestream order."""
    if asset.private["kind"] == "jpeg":
        return {(0, 0): [(asset.offset, asset.length)]}
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for tile, at, size in asset.private["parts"]:
        out.setdefault(divmod(tile, asset.private["tiles"][1]), []).append((at, size))
    return out


def block(data: bytes, asset: Asset, br: int, bc: int):
    """Decoded by the plug-in registered for the kind."""
    from ..codecs import plugin

    return plugin(asset.private["kind"])(data, asset, br, bc)
