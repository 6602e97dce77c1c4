import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tileweave.sources.codecs import codec_json, codec_of_json, plugin, register_codec, sniffed
from tileweave.sources.formats import FormatError, coded, dted, nitf, png, tiff


def image(shape, dtype, seed=0):
    return (np.random.default_rng(seed).random(shape) * 200).astype(dtype)


def whole(module, data, asset):
    out = np.zeros((asset.bands, asset.rows, asset.cols), asset.dtype)
    for r in range(asset.grid[0]):
        for c in range(asset.grid[1]):
            px = module.block(data, asset, r, c)
            out[:, r * asset.bh : r * asset.bh + px.shape[1], c * asset.bw : c * asset.bw + px.shape[2]] = px
    return out


def test_dted():
    e = np.random.default_rng(1).integers(-500, 3000, (1, 21, 13)).astype(np.int16)
    e[0, 3, 4] = dted.NO_DATA
    data = dted.encode(e, {"dted:origin_longitude": -71.5, "dted:origin_latitude": 42.25})
    asset = dted.assets(data)[0]
    assert (dted.block(data, asset, 0, 0) == e).all()
    assert asset.metadata["dted:origin_longitude"] == -71.5 and asset.metadata["dted:origin_latitude"] == 42.25
    broken = bytearray(data)
    broken[-7] ^= 1
    with pytest.raises(FormatError, match="checksum"):
        dted.block(bytes(broken), asset, 0, 0)


@pytest.mark.parametrize("dtype", ["uint8", "uint16"])
@pytest.mark.parametrize("bands", [1, 2, 3, 4])
def test_png(dtype, bands):
    px = image((bands, 17, 23), dtype)
    data = png.encode(px, {"Title": "x"})
    asset = png.assets(data)[0]
    assert (whole(png, data, asset) == px).all() and asset.metadata["Title"] == "x"


def test_png_interlaced_and_filtered():
    import struct
    import zlib

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    px = image((3, 19, 21), "uint8")

    def filtered(part, kind):
        """Rows of (rows, cols, 3) with one filter."""
        out, above = b"", np.zeros(part.shape[1] * 3, int)
        for row in part.reshape(len(part), -1).astype(int):
            left, corner = np.r_[0, 0, 0, row[:-3]], np.r_[0, 0, 0, above[:-3]]
            p = left + above - corner
            pa, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
            paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))
            guess = [0, left, above, (left + above) // 2, paeth][kind]
            out += bytes([kind]) + ((row - guess) & 255).astype(np.uint8).tobytes()
            above = row
        return out

    hwc = px.transpose(1, 2, 0)
    for kind in range(5):
        for interlace in (0, 1):
            parts = [hwc[y::dy, x::dx] for y, x, dy, dx in png.PASSES] if interlace else [hwc]
            raw = b"".join(filtered(p, kind) for p in parts if p.size)
            data = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 21, 19, 8, 2, 0, 0, interlace)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
            assert (png.block(data, png.assets(data)[0], 0, 0) == px).all(), (kind, interlace)


@pytest.mark.parametrize("dtype", ["uint8", "int16", "uint32", "float32", "float64"])
@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff(dtype, compression, predictor):
    px = image((3, 70, 45), dtype)
    data = tiff.encode([(px, {"ImageDescription": "hi", "ModelPixelScale": [1.0, 1.0, 0.0]}), (px[:, ::4, ::4], {"overview": True}), (px[:, ::2, ::2], {"overview": True})], (32, 32), compression, predictor)
    full, first, second = tiff.assets(data)
    assert (whole(tiff, data, full) == px).all()
    assert (first.key, second.key) == ("image:0:overview:1", "image:0:overview:2") and first.rows > second.rows
    assert full.metadata["270"] == "hi" and "33550" in full.metadata and "33550" not in first.metadata


def test_big_tiff():
    px = image((1, 40, 40), "uint16")
    data = tiff.encode([(px, {})], (16, 16), 8, 1, big=True)
    assert data[2] == 43 and (whole(tiff, data, tiff.assets(data)[0]) == px).all()


@pytest.mark.parametrize("size", [0, 1, 2, 255, 300, 600, 5000, 70_000])
@pytest.mark.parametrize("values", [2, 256])
def test_lzw_round_trip(size, values):
    data = np.random.default_rng(size).integers(0, values, size).astype(np.uint8).tobytes()
    assert tiff.lzw(tiff.lzw_packed(data)) == data


@given(st.binary(max_size=400))
@settings(max_examples=60)
def test_pack_bits(data):
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data


def test_lzw():
    # codes 256 7 258 8 8 258 6 6 257, nine bits each
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw(packed) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


@pytest.mark.parametrize("mode", list("BPRS"))
@pytest.mark.parametrize("dtype", ["uint8", "int16", "float32", "complex64"])
@pytest.mark.parametrize("masked", [False, True])
def test_nitf(mode, dtype, masked):
    px = image((4, 50, 70), dtype)
    present = (lambda k, r, c: (r + c) % 2 == 0) if masked else None
    data = nitf.encode([(px, {"records": b"ABCDEF00003xyz"})], [("a\nb", {})], [(b"<x/>", {})], (32, 32), mode, present)
    asset, text, des = nitf.assets(data)
    assert [asset.key, text.key, des.key] == ["image:0", "text:0", "des:0"]
    assert data[text.offset : text.offset + text.length] == b"a\r\nb" and data[des.offset :] == b"<x/>"
    assert asset.metadata["ABCDEF"] == {"_raw": b"xyz".hex(), "_length": 3}
    for r in range(2):
        for c in range(3):
            part = nitf.block(data, asset, r, c)
            wanted = px[:, r * 32 : (r + 1) * 32, c * 32 : (c + 1) * 32]
            if masked and (r + c) % 2:
                assert not nitf.has_block(asset, r, c) and (part == 0).all() and (r, c) not in nitf.ranges(asset)
            else:
                assert (part == wanted).all()


@pytest.mark.parametrize("bits", [1, 5, 12])
def test_nitf_packed_bits(bits):
    px = np.random.default_rng(2).integers(0, 1 << bits, (1, 20, 20)).astype(np.uint8 if bits <= 8 else np.uint16)
    data = nitf.encode([(px, {"NBPP": bits})], block_size=(20, 20))
    assert (nitf.block(data, nitf.assets(data)[0], 0, 0) == px).all()


def test_nitf_unknown_length():
    px = image((1, 8, 8), "uint8")
    data = nitf.encode([(px, {})], block_size=(8, 8))
    at = 360 + 3 + 6
    assert data[at : at + 10] == b"0000000064"
    streamed = data[:at] + b"9999999999" + data[at + 10 :]
    assert nitf.assets(streamed)[0].length == 64


def test_jpeg_2000_headers():
    import struct

    siz = struct.pack(">HHHIIIIIIIIH", 0xFF51, 41, 0, 100, 60, 0, 0, 64, 64, 0, 0, 1) + b"\x0b\x01\x01"
    cod = struct.pack(">HHBBHBB", 0xFF52, 12, 0, 0, 1, 0, 5) + bytes(4)
    parts = b"".join(struct.pack(">HHHIBB", 0xFF90, 10, t, 14 + n, 0, 1) + b"\xff\x93" + bytes(n) for t, n in ((0, 5), (1, 7)))
    code = b"\xff\x4f" + siz + cod + parts + b"\xff\xd9"
    asset = coded.assets(code)[0]
    assert (asset.rows, asset.cols, asset.bits, asset.levels, asset.grid) == (60, 100, 12, 6, (1, 2))
    found = coded.ranges(asset)
    assert [n for _, n in found[0, 0] + found[0, 1]] == [19, 21]
    one = coded.minimal(code, coded.main_header(code)["first"], found[0, 1])
    assert coded.tile_parts(one, coded.main_header(one)["first"])[0][0] == 0 and one[-2:] == b"\xff\xd9"
    edge = coded.assets(coded.with_tile_size(one, 60, 36))[0]
    assert (edge.rows, edge.cols) == (60, 36) and coded.with_tile_size(one, 64, 64) == one
    assert coded.decompositions(5, 20, 300) == 4 and coded.decompositions(3, 1024, 1024) == 3
    boxed = coded.JP2 + struct.pack(">I4s", 0, b"jp2c") + code
    assert coded.assets(boxed)[0].offset == 20
    assert coded.tile_lengths(bytes([0, 0x10, 0, 0, 9, 1, 0, 8]), 100) == [(0, 100, 9), (1, 109, 8)]


def test_codecs():
    with pytest.raises(FormatError):
        plugin("none")
    register_codec("own", lambda data, asset, r, c: 1)
    assert plugin("own")(b"", None, 0, 0) == 1
    assert codec_of_json(codec_json("x", {"b": 1})) == ("x", {"b": 1})
    with pytest.raises(FormatError):
        sniffed(b"plain")
