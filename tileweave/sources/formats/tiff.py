"""TIFF, GeoTIFF and COG: directories of tags, tiles or strips; classic and BigTIFF."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from . import _PLUGINS, Asset, FormatError, padded, plugin, registered, unpacked

#: Tag numbers by the names of the standard and its extensions.
TAGS = {
    "NewSubfileType": 254, "SubfileType": 255, "ImageWidth": 256, "ImageLength": 257, "BitsPerSample": 258, "Compression": 259, "PhotometricInterpretation": 262, "Threshholding": 263,
    "CellWidth": 264, "CellLength": 265, "FillOrder": 266, "DocumentName": 269, "ImageDescription": 270, "Make": 271, "Model": 272, "StripOffsets": 273, "Orientation": 274,
    "SamplesPerPixel": 277, "RowsPerStrip": 278, "StripByteCounts": 279, "MinSampleValue": 280, "MaxSampleValue": 281, "XResolution": 282, "YResolution": 283, "PlanarConfiguration": 284,
    "PageName": 285, "FreeOffsets": 288, "FreeByteCounts": 289, "GrayResponseUnit": 290, "GrayResponseCurve": 291, "ResolutionUnit": 296, "PageNumber": 297, "Software": 305, "DateTime": 306,
    "Artist": 315, "HostComputer": 316, "Predictor": 317, "WhitePoint": 318, "PrimaryChromaticities": 319, "ColorMap": 320, "HalftoneHints": 321, "TileWidth": 322, "TileLength": 323,
    "TileOffsets": 324, "TileByteCounts": 325, "SubIFDs": 330, "InkSet": 332, "InkNames": 333, "NumberOfInks": 334, "DotRange": 336, "TargetPrinter": 337, "ExtraSamples": 338,
    "SampleFormat": 339, "SMinSampleValue": 340, "SMaxSampleValue": 341, "JPEGTables": 347, "Copyright": 33432,
    "ModelPixelScale": 33550, "ModelTiepoint": 33922, "ModelTransformation": 34264, "GeoKeyDirectory": 34735, "GeoDoubleParams": 34736, "GeoAsciiParams": 34737,
    "GDALMetadata": 42112, "GDALNoData": 42113, "GDAL_METADATA": 42112, "GDAL_NODATA": 42113,
}
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: Sample format and bits to pixel type.
DTYPES = {(1, 1): "uint8", (1, 2): "uint8", (1, 4): "uint8", (1, 8): "uint8", (1, 16): "uint16", (1, 32): "uint32", (2, 8): "int8", (2, 16): "int16", (2, 32): "int32", (3, 32): "float32", (3, 64): "float64"}
SUPPORTED = (1, 5, 7, 8, 32773, 32946)
#: Raw bytes beyond which offsets take 64 bits.
BIG = 3_500_000_000


def _directories(data: bytes):
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None:
        raise FormatError("no TIFF byte order")
    version = unpacked(order + "H", data, 2)[0]
    if version not in (42, 43):
        raise FormatError("no TIFF version")
    big = version == 43
    at = unpacked(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    seen = set()
    while at and at not in seen:
        seen.add(at)
        n = unpacked(order + ("Q" if big else "H"), data, at)[0]
        start, step = at + (8 if big else 2), 20 if big else 12
        tags: dict[int, object] = {}
        for i in range(n):
            entry = start + i * step
            tag, kind, count = unpacked(order + ("HHQ" if big else "HHI"), data, entry)
            code = _TYPES.get(kind)
            if code is None:
                continue
            size = struct.calcsize("<" + code) * count
            place = entry + (12 if big else 8)
            if size > (8 if big else 4):
                place = unpacked(order + ("Q" if big else "I"), data, place)[0]
            if kind == 2:
                tags[tag] = data[place : place + count].split(b"\0")[0].decode("utf-8", "replace")
            elif kind == 7:
                tags[tag] = bytes(data[place : place + count])
            else:
                values = unpacked(f"{order}{count * len(code)}{code[0]}", data, place)
                if len(code) == 2:
                    values = tuple(a / b if b else 0.0 for a, b in zip(values[::2], values[1::2]))
                tags[tag] = values[0] if count == 1 else list(values)
        yield order, tags
        at = unpacked(order + ("Q" if big else "I"), data, start + n * step)[0]


def _list(v) -> list:
    return v if isinstance(v, list) else [v]


def assets(data: bytes) -> list[Asset]:
    """Images in directory order; reduced ones are overviews of the last full one."""
    out: list[Asset] = []
    full, overview = -1, 0
    for order, tags in _directories(data):
        reduced = bool(tags.get(254, 0) & 1) and full >= 0
        full, overview = (full, overview + 1) if reduced else (full + 1, 0)
        compression = tags.get(259, 1)
        if compression not in SUPPORTED and f"tiff:{compression}" not in _PLUGINS:
            raise FormatError(f"compression {compression} isn't supported")
        bits, form = _list(tags.get(258, 1))[0], _list(tags.get(339, 1))[0]
        if (form, bits) not in DTYPES:
            raise FormatError(f"sample format {form} of {bits} bits isn't supported")
        rows, cols, tiled = tags[257], tags[256], 322 in tags
        bh, bw = (tags[323], tags[322]) if tiled else (min(tags.get(278, rows), rows), cols)
        offsets, sizes = _list(tags[324 if tiled else 273]), _list(tags[325 if tiled else 279])
        names = {n: k for k, n in TAGS.items()}
        meta = {str(t): v if not isinstance(v, bytes) else v.hex() for t, v in tags.items()}
        out.append(Asset(
            f"image:{full}:overview:{overview}" if reduced else f"image:{full}", roles=("overview",) if reduced else ("data",), rows=rows, cols=cols, bands=tags.get(277, 1), bh=bh, bw=bw,
            dtype=DTYPES[form, bits], bits=bits, offset=min(offsets), length=sum(sizes), metadata=meta,
            private={"order": order, "offsets": offsets, "sizes": sizes, "compression": compression, "planar": tags.get(284, 1), "predictor": tags.get(317, 1), "tiled": tiled, "names": names, "tables": tags.get(347) if isinstance(tags.get(347), bytes) else None},
        ))
    return out


def lzw(data: bytes) -> bytes:
    """Variable-width codes, most significant bit first, early change."""
    out = bytearray()
    table: list[bytes] = []
    bits = have = at = 0
    width, last = 9, None
    while True:
        while have < width:
            if at == len(data):
                return bytes(out)
            bits, have, at = bits << 8 | data[at], have + 8, at + 1
        code = bits >> (have - width)
        have -= width
        bits &= (1 << have) - 1
        if code == 257:
            return bytes(out)
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out += entry
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12


def lzw_packed(data: bytes) -> bytes:
    """Inverse of ``lzw``."""
    out, bits, have = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    width, size = 9, 258

    def put(code: int) -> None:
        nonlocal bits, have
        bits, have = bits << width | code, have + width
        while have >= 8:
            out.append(bits >> (have - 8) & 255)
            have -= 8
        bits &= (1 << have) - 1

    put(256)
    prefix = b""
    for byte in data:
        longer = prefix + bytes([byte])
        if len(longer) == 1 or longer in table:
            prefix = longer
            continue
        put(prefix[0] if len(prefix) == 1 else table[prefix])
        table[longer] = size
        size += 1
        if size == 4094:
            put(256)
            table, width, size = {}, 9, 258
        else:
            width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        prefix = bytes([byte])
    if prefix:
        put(prefix[0] if len(prefix) == 1 else table[prefix])
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    if have:
        out.append(bits << (8 - have) & 255)
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run > 2:
            out += bytes([257 - run, data[at]])
            at += run
            continue
        end = at + run
        while end < len(data) and end - at < 128 and not (end + 2 < len(data) and data[end] == data[end + 1] == data[end + 2]):
            end += 1
        out += bytes([end - at - 1]) + data[at:end]
        at = end
    return bytes(out)


def _decoded(raw: bytes, compression: int) -> bytes:
    if compression == 1:
        return raw
    if compression in (8, 32946):
        return zlib.decompress(raw)
    if compression == 5:
        return lzw(raw)
    if compression == 32773:
        return unpack_bits(raw)
    raise FormatError(f"compression {compression} isn't decoded here")


def ranges(asset: Asset) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Byte ranges of each block; with separate planes one for each band."""
    gr, gc = asset.grid
    planes = asset.bands if asset.private["planar"] == 2 else 1
    pairs = list(zip(asset.private["offsets"], asset.private["sizes"]))
    return {(r, c): [pairs[p * gr * gc + r * gc + c] for p in range(planes)] for r in range(gr) for c in range(gc)}


def decode_tile(raw: bytes, asset: Asset, rows: int, samples: int) -> np.ndarray:
    """One tile or strip of ``rows`` nominal rows as (samples, rows, width); short data are filled with zeros."""
    dtype = np.dtype(asset.dtype).newbyteorder(asset.private["order"])
    body = _decoded(raw, asset.private["compression"])
    if asset.bits < 8:
        line, n = -(-asset.bw * samples * asset.bits // 8), asset.bw * samples
        body = body.ljust(rows * line, b"\0")
        ones = np.unpackbits(np.frombuffer(body, np.uint8, rows * line).reshape(rows, line), axis=1)[:, : n * asset.bits].reshape(rows, n, asset.bits)
        return (ones @ (1 << np.arange(asset.bits - 1, -1, -1)).astype(np.uint8)).reshape(rows, asset.bw, samples).transpose(2, 0, 1)
    need = rows * asset.bw * samples * dtype.itemsize
    if asset.private["predictor"] == 3:  # differences of the bytes of a row, most significant bytes first
        planes = np.cumsum(np.frombuffer(body[:need].ljust(need, b"\0"), np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8)
        body = np.ascontiguousarray(planes.reshape(rows, dtype.itemsize, asset.bw * samples).transpose(0, 2, 1)).tobytes()
        dtype = dtype.newbyteorder(">")
    px = np.frombuffer(body[:need].ljust(need, b"\0"), dtype).reshape(rows, asset.bw, samples).astype(dtype.newbyteorder("="))
    if asset.private["predictor"] == 2:
        px = np.cumsum(px, axis=1, dtype=px.dtype)
    return px.transpose(2, 0, 1)


def jpeg_tile(data: bytes, asset: Asset, br: int, bc: int) -> np.ndarray:
    """A tile of baseline JPEG; tables that all tiles share go before its own segments."""
    from .jpeg import decode

    i = br * asset.grid[1] + bc
    body = bytes(data[asset.private["offsets"][i] : asset.private["offsets"][i] + asset.private["sizes"][i]])
    shared = asset.private.get("tables") or b""
    return decode(shared[:-2] + body[2:] if shared else body)


def block(data: bytes, asset: Asset, br: int, bc: int) -> np.ndarray:
    h, w = asset.extent(br, bc)
    if asset.private["compression"] == 7 and not registered("tiff:7"):
        return jpeg_tile(data, asset, br, bc)[:, :h, :w]
    if asset.private["compression"] not in SUPPORTED or asset.private["compression"] == 7:
        return plugin(f"tiff:{asset.private['compression']}")(data, asset, br, bc)[:, :h, :w]
    nominal = asset.bh if asset.private["tiled"] else h
    planar = asset.private["planar"] == 2
    gr, gc = asset.grid
    places = [p * gr * gc + br * gc + bc for p in range(asset.bands if planar else 1)]
    offsets, sizes = asset.private["offsets"], asset.private["sizes"]
    parts = [decode_tile(data[offsets[i] : offsets[i] + sizes[i]], asset, nominal, 1 if planar else asset.bands) for i in places]
    return np.ascontiguousarray(np.concatenate(parts)[:, :h, :w])


def encode(images: list[tuple[np.ndarray, dict]], tile: tuple[int, int] = (256, 256), compression: int = 8, predictor: int = 1, big: bool | None = None) -> bytes:
    """Images (array, metadata) as tiled directories; ``overview`` in the metadata marks reduced ones, which stand behind their image, largest first."""
    if compression not in (1, 5, 8, 32946, 32773) or predictor not in (1, 2):
        raise FormatError("no such encoding")
    th, tw = ((x + 15) & ~15 for x in tile)
    groups: list[list[tuple[np.ndarray, dict]]] = []
    for image, meta in images:
        if meta.get("overview") and groups:
            groups[-1].append((image, meta))
        else:
            groups.append([(image, meta)])
    ordered = [x for g in groups for x in (g[0], *sorted(g[1:], key=lambda x: -x[0].shape[1] * x[0].shape[2]))]
    big = sum(i.nbytes for i, _ in ordered) > BIG if big is None else big
    out = bytearray(b"II" + (struct.pack("<HHHQ", 43, 8, 0, 16) if big else struct.pack("<HI", 42, 8)))
    link = 8 if big else 4
    for image, meta in ordered:
        bands, rows, cols = image.shape
        kind = image.dtype.kind
        offsets, sizes = [], []
        for r in range(0, rows, th):
            for c in range(0, cols, tw):
                px = padded(image[:, r : r + th, c : c + tw], th, tw).transpose(1, 2, 0)
                if predictor == 2 and kind != "f":
                    px = np.concatenate([px[:, :1], px[:, 1:] - px[:, :-1]], axis=1)
                raw = np.ascontiguousarray(px).astype(image.dtype.newbyteorder("<")).tobytes()
                raw = zlib.compress(raw) if compression in (8, 32946) else pack_bits(raw) if compression == 32773 else lzw_packed(raw) if compression == 5 else raw
                offsets.append(len(out))
                sizes.append(len(raw))
                out += raw + b"\0" * (len(raw) % 2)
        tags: dict[int, tuple[int, list]] = {
            254: (4, [1 if meta.get("overview") else 0]), 256: (4, [cols]), 257: (4, [rows]), 258: (3, [image.dtype.itemsize * 8] * bands), 259: (3, [compression]), 262: (3, [2 if bands == 3 else 1]),
            277: (3, [bands]), 284: (3, [1]), 317: (3, [predictor if kind != "f" else 1]), 322: (4, [tw]), 323: (4, [th]),
            324: (16 if big else 4, offsets), 325: (16 if big else 4, sizes), 339: (3, [{"u": 1, "i": 2, "f": 3}[kind]] * bands),
        }
        for name, value in meta.items():
            number = TAGS.get(name, int(name) if str(name).isdigit() else None)
            if number is None or number in tags or (number < 32768 and number not in (270, 305, 306)) or (meta.get("overview") and number in (33550, 33922, 34264, 34735, 34736, 34737)):
                continue
            values = _list(value)
            if isinstance(value, str):
                tags[number] = (2, list(value.encode() + b"\0"))
            elif all(isinstance(v, int) for v in values):
                tags[number] = (3 if all(0 <= v < 65536 for v in values) else 4, values)
            else:
                tags[number] = (12, [float(v) for v in values])
        at = len(out)
        entry = 20 if big else 12
        extra_at = at + (8 if big else 2) + entry * len(tags) + (8 if big else 4)
        head, extra = bytearray(struct.pack("<Q" if big else "<H", len(tags))), bytearray()
        for number in sorted(tags):
            code, values = tags[number]
            body = struct.pack(f"<{len(values)}{'B' if code == 2 else _TYPES[code]}", *values)
            if len(body) > (8 if big else 4):
                shown = struct.pack("<Q" if big else "<I", extra_at + len(extra))
                extra += body + b"\0" * (len(body) % 2)
            else:
                shown = body.ljust(8 if big else 4, b"\0")
            head += struct.pack("<HHQ" if big else "<HHI", number, code, len(values)) + shown
        struct.pack_into("<Q" if big else "<I", out, link, at)
        link = at + (8 if big else 2) + entry * len(tags)
        out += head + bytes(8 if big else 4) + extra
    return bytes(out)
