"""Baseline JPEG: sequential Huffman-coded images of 8 bits, one or three bands.

Entropy coding runs over the coefficients of one block at a time; transforms, colours and
sampling run over all blocks at once.
"""

from __future__ import annotations

import math

import numpy as np

from . import Asset, FormatError, coded, unpacked

#: The standard's example tables of quantisation, rows from low to high frequency.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMINANCE = (17, 18, 24, 47, 18, 21, 26, 66, 24, 26, 56, 99, 47, 66, 99, 99)  # upper left 4 x 4; 99 elsewhere
#: Places of a block's coefficients in the order in which they are coded: along diagonals, to and fro.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_COSINE = np.array([[math.sqrt(1 / 8) if k == 0 else 0.5 * math.cos((2 * n + 1) * k * math.pi / 16) for n in range(8)] for k in range(8)])
#: Full-range YCbCr from RGB.
_YCC = np.array([[0.299, 0.587, 0.114], [-0.299 / 1.772, -0.587 / 1.772, 0.5], [0.5, -0.587 / 1.402, -0.114 / 1.402]])


def quantisation(quality: int, colour: bool = False) -> np.ndarray:
    """The example table scaled by a quality of 1 to 100."""
    if not 1 <= quality <= 100:
        raise FormatError("quality lies between 1 and 100")
    table = np.full((8, 8), 99) if colour else np.array(LUMINANCE).reshape(8, 8)
    if colour:
        table[:4, :4] = np.array(CHROMINANCE).reshape(4, 4)
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((table * scale + 50) // 100, 1, 255)


def _lookup(counts: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """Length and symbol of the code that each 16 bits begin with."""
    length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code = at = 0
    for size, n in enumerate(counts, 1):
        for _ in range(n):
            first = code << (16 - size)
            length[first : first + (1 << 16 - size)], symbol[first : first + (1 << 16 - size)] = size, symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return length.tolist(), symbol.tolist()


class _Bits:
    """Bits of one restart interval, stuffed zeros taken out."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.value = data.replace(b"\xff\0", b"\xff") + b"\xff" * 8, 0, 0, 0

    def need(self) -> None:
        while self.held < 32:
            self.value = (self.value & (1 << self.held) - 1) << 32 | int.from_bytes(self.data[self.at : self.at + 4].ljust(4, b"\xff"), "big")
            self.at, self.held = self.at + 4, self.held + 32

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        self.need()
        first = self.value >> (self.held - 16) & 0xFFFF
        size = table[0][first]
        if not size:
            raise FormatError("no such Huffman code")
        self.held -= size
        return table[1][first]

    def number(self, size: int) -> int:
        """A signed number of so many bits; a leading zero makes it negative."""
        if not size:
            return 0
        self.need()
        self.held -= size
        v = self.value >> self.held & (1 << size) - 1
        return v if v >> size - 1 else v - (1 << size) + 1


def decode(data: bytes) -> np.ndarray:
    """An image (bands, rows, cols) of uint8; three components become red, green and blue."""
    tables: dict[tuple[int, int], tuple] = {}
    quant: dict[int, np.ndarray] = {}
    frame, restart, adobe, at = None, 0, None, 2
    if bytes(data[:2]) != b"\xff\xd8":
        raise FormatError("no JPEG")
    while True:
        marker, size = unpacked(">HH", data, at)
        body = bytes(data[at + 4 : at + 2 + size])
        at += 2 + size
        if marker == 0xFFDB:
            while body:
                wide = body[0] >> 4
                step = 64 * (1 + wide)
                quant[body[0] & 15], body = np.frombuffer(body[1 : 1 + step], ">u2" if wide else np.uint8).astype(np.int64), body[1 + step :]
        elif marker == 0xFFC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15], body = _lookup(body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif marker in (0xFFC0, 0xFFC1):
            bits, rows, cols, n = unpacked(">BHHB", body, 0)
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if bits != 8 or n not in (1, 3):
                raise FormatError("only one or three bands of 8 bits are decoded")
        elif 0xFFC2 <= marker <= 0xFFCF and marker != 0xFFC8 and marker != 0xFFCC:
            raise FormatError("only sequential Huffman-coded images are decoded")
        elif marker == 0xFFDD:
            restart = unpacked(">H", body, 0)[0]
        elif marker == 0xFFEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif marker == 0xFFDA:
            break
    if frame is None or body[0] != len(frame):
        raise FormatError("one scan of all bands is decoded")
    used = {body[1 + 2 * i]: (tables[0, body[2 + 2 * i] >> 4], tables[1, body[2 + 2 * i] & 15]) for i in range(body[0])}
    if len(frame) == 1:
        frame = [(frame[0][0], 1, 1, frame[0][3])]
    most_h, most_v = max(f[1] for f in frame), max(f[2] for f in frame)
    wide, high = -(-cols // (8 * most_h)), -(-rows // (8 * most_v))
    coefficients = [np.zeros((high * v, wide * h, 64), np.int64) for _, h, v, _ in frame]
    end = bytes(data).find(b"\xff\xd9", at) if isinstance(data, bytes) else len(data)
    scan = bytes(data[at : end if end >= 0 else len(data)])
    parts, begin, i = [], 0, scan.find(b"\xff")
    while i >= 0:
        if i + 1 < len(scan) and 0xD0 <= scan[i + 1] <= 0xD7:
            parts.append(scan[begin:i])
            begin = i + 2
        i = scan.find(b"\xff", i + 2)
    parts.append(scan[begin:])
    total, each = wide * high, restart or wide * high
    for k, part in enumerate(parts):
        bits, before = _Bits(part), [0] * len(frame)
        for unit in range(k * each, min(total, (k + 1) * each)):
            my, mx = divmod(unit, wide)
            for c, (name, h, v, _) in enumerate(frame):
                dc, ac = used[name]
                for y in range(v):
                    for x in range(h):
                        block = coefficients[c][my * v + y, mx * h + x]
                        before[c] += bits.number(bits.symbol(dc))
                        block[0], n = before[c], 1
                        while n < 64:
                            s = bits.symbol(ac)
                            if not s & 15:
                                if s != 0xF0:
                                    break
                                n += 16
                                continue
                            n += s >> 4
                            if n > 63:
                                raise FormatError("a block has too many coefficients")
                            block[n] = bits.number(s & 15)
                            n += 1
    planes = []
    for (_, h, v, q), found in zip(frame, coefficients):
        natural = np.zeros(found.shape)
        natural[..., ZIGZAG] = found * quant[q]
        px = np.einsum("ki,yxkl,lj->yixj", _COSINE, natural.reshape(*found.shape[:2], 8, 8), _COSINE, optimize=True).reshape(found.shape[0] * 8, found.shape[1] * 8) + 128
        planes.append(np.repeat(np.repeat(px, most_v // v, 0), most_h // h, 1)[:rows, :cols])
    image = np.stack(planes)
    if len(planes) == 3 and adobe != 0:
        image = np.tensordot(np.linalg.inv(_YCC), image - np.array([0, 128, 128]).reshape(3, 1, 1), 1)
    return np.clip(np.round(image), 0, 255).astype(np.uint8)


def encode(image: np.ndarray, metadata: dict | None = None, quality: int | None = None) -> bytes:
    """One or three bands of uint8 at full sampling; all codes of a table have one length, so no counts are needed."""
    bands, rows, cols = image.shape
    if image.dtype != np.uint8 or bands not in (1, 3):
        raise FormatError("JPEG holds one or three bands of uint8")
    quality = int((metadata or {}).get("quality", 75)) if quality is None else quality
    px = image.astype(float)
    if bands == 3:
        px = np.tensordot(_YCC, px, 1) + np.array([0, 128, 128]).reshape(3, 1, 1)
    px = np.pad(px, ((0, 0), (0, -rows % 8), (0, -cols % 8)), mode="edge") - 128
    blocks = px.reshape(bands, px.shape[1] // 8, 8, px.shape[2] // 8, 8)
    spectrum = np.einsum("ki,byixj,lj->yxbkl", _COSINE, blocks, _COSINE, optimize=True)
    quant = [quantisation(quality, c > 0) for c in range(bands)]
    levels = np.round(spectrum / np.stack(quant)).astype(int).reshape(-1, bands, 64)[..., ZIGZAG]
    sizes = [r << 4 | s for r in range(16) for s in range(1, 11)] + [0, 0xF0]
    code = {s: n for n, s in enumerate(sorted(sizes))}  # eight bits each
    out: list[str] = []
    before = [0] * bands

    def number(v: int, size: int) -> str:
        return format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    for unit in levels.tolist():
        for c, block in enumerate(unit):
            step, before[c] = block[0] - before[c], block[0]
            size = abs(step).bit_length()
            out.append(format(size, "04b") + number(step, size))
            run = 0
            last = max((n for n in range(63, 0, -1) if block[n]), default=0)
            for v in block[1 : last + 1]:
                if v == 0:
                    run += 1
                    continue
                while run > 15:
                    out.append(format(code[0xF0], "08b"))
                    run -= 16
                size = abs(v).bit_length()
                out.append(format(code[run << 4 | size], "08b") + number(v, size))
                run = 0
            if last < 63:
                out.append(format(code[0], "08b"))
    shown = "".join(out)
    shown += "1" * (-len(shown) % 8)
    scan = int(shown, 2).to_bytes(len(shown) // 8, "big").replace(b"\xff", b"\xff\0") if shown else b""
    segment = lambda marker, body: bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body
    tables = b"".join(segment(0xDB, bytes([c]) + bytes(quant[c].ravel()[ZIGZAG].astype(np.uint8))) for c in range(min(2, bands)))
    frame = segment(0xC0, b"\x08" + rows.to_bytes(2, "big") + cols.to_bytes(2, "big") + bytes([bands]) + b"".join(bytes((c + 1, 0x11, min(c, 1))) for c in range(bands)))
    huffman = segment(0xC4, b"\0" + bytes(12 if n == 4 else 0 for n in range(1, 17)) + bytes(range(12))) + segment(0xC4, b"\x10" + bytes(len(code) if n == 8 else 0 for n in range(1, 17)) + bytes(sorted(sizes)))
    start = segment(0xDA, bytes([bands]) + b"".join(bytes((c + 1, 0)) for c in range(bands)) + b"\0\x3f\0")
    return b"\xff\xd8" + tables + frame + huffman + start + scan + b"\xff\xd9"


def streams(data: bytes, start: int, end: int) -> list[tuple[int, int]]:
    """First byte and length of the images that follow each other in a run of bytes, each up to its end marker."""
    body, out, at = bytes(data[start:end]), [], 0
    while (first := body.find(b"\xff\xd8", at)) >= 0:
        stop = body.find(b"\xff\xd9", first)
        if stop < 0:
            raise FormatError("an image without an end")
        out.append((start + first, stop + 2 - first))
        at = stop + 2
    return out


def assets(data: bytes) -> list[Asset]:
    return coded.assets(data)


def ranges(asset: Asset) -> dict[tuple[int, int], list[tuple[int, int]]]:
    return coded.ranges(asset)


def block(data: bytes, asset: Asset, br: int, bc: int) -> np.ndarray:
    asset.extent(br, bc)
    return decode(data[:])
