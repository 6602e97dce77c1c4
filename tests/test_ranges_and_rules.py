"""Ranged reads, overflow records, coded blocks, small samples, open rules."""

import base64
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tileweave.functions import location
from tileweave.operators import raster, segments
from tileweave.sources import api
from tileweave.sources.formats import Asset, FormatError, jpeg, nitf, png, register_codec, tiff
from tileweave.sources.memory import image_blocks
from tileweave.sources.ranged import PAGE, Ranged
from tileweave.sources.scan import files, range_bytes, reference_bytes, scan_assets, scan_blocks, tile_index
from tileweave.structure.codec import record
from tileweave.structure.layout import LayoutError, load


def image(shape, dtype, seed=0):
    return (np.random.default_rng(seed).random(shape) * 200).astype(dtype)


def whole(module, data, asset):
    out = np.zeros((asset.bands, asset.rows, asset.cols), asset.dtype)
    for r in range(asset.grid[0]):
        for c in range(asset.grid[1]):
            px = module.block(data, asset, r, c)
            out[:, r * asset.bh : r * asset.bh + px.shape[1], c * asset.bw : c * asset.bw + px.shape[2]] = px
    return out


def test_slices_of_a_ranged_file(tmp_path):
    body = np.random.default_rng(1).integers(256, size=9 * PAGE + 77, dtype=np.uint8).tobytes()
    (tmp_path / "f").write_bytes(body)
    with Ranged(str(tmp_path / "f")) as data:
        assert len(data) == len(body) and data[-1] == body[-1] and data[5] == body[5]
        for start, stop in ((0, 4), (PAGE - 3, PAGE + 3), (0, len(body)), (len(body) - 5, len(body) + 9), (7, 7), (PAGE, 8 * PAGE), (-4, None)):
            assert data[start:stop] == body[start:stop]
        with pytest.raises(IndexError):
            data[len(body)]


def test_an_index_reads_headers_only(tmp_path):
    for name, module in (("a.ntf", nitf), ("a.tif", tiff)):
        read = []
        for size in (64, 2048):
            path = tmp_path / f"{size}{name}"
            path.write_bytes(module.encode([(image((1, size, size), "uint16"), {})], **({"compression": 1} if module is tiff else {})))
            with Ranged(f"file://{path}") as data:
                assert module.ranges(module.assets(data)[0])
                read.append(data.read)
        assert read[1] <= 4 * PAGE


def test_scans_by_ranges(spark, tmp_path):
    px = image((2, 100, 90), "uint16")
    (tmp_path / "x.ntf").write_bytes(nitf.encode([(px, {})], block_size=(32, 32)))
    listed = files(spark, str(tmp_path / "x.ntf"))
    assert listed.columns == ["path", "length"]
    assert [(r["rows"], r["bands"]) for r in scan_assets(listed).collect()] == [(100, 2)]
    index = tile_index(listed)
    raw = {(r["br"], r["bc"]): bytes(r["data"]) for r in range_bytes(index).collect()}
    asset = nitf.assets((tmp_path / "x.ntf").read_bytes())[0]
    assert len(raw) == 12 and (nitf.decode_samples(raw[1, 1], asset, 2) == px[:, 32:64, 32:64]).all()
    one = scan_blocks(listed, rows=(0, 0), cols=(0, 0)).collect()
    assert len(one) == 1 and (np.frombuffer(one[0]["payload"], "uint16").reshape(2, 32, 32) == px[:, :32, :32]).all()


def test_references(spark, tmp_path):
    (tmp_path / "r").write_bytes(b"0123456789")
    url = str(tmp_path / "r")
    refs = ["plain", "base64:" + base64.b64encode(b"\0\1").decode(), json.dumps([url]), json.dumps([url, 2, 3]), json.dumps([url, [[8, 2], [0, 1]]]), None]
    df = spark.createDataFrame(list(enumerate(refs)), "key int, reference string")
    got = {r["key"]: r["data"] and bytes(r["data"]) for r in reference_bytes(df, keep=["key"]).collect()}
    assert got == {0: b"plain", 1: b"\0\1", 2: b"0123456789", 3: b"234", 4: b"890", 5: None}


@pytest.mark.parametrize(("dtype", "bits"), [("int16", 12), ("int16", 9), ("int32", 20), ("uint16", 11), ("uint64", 64), ("int64", 64), ("int64", 40), ("uint8", 3)])
@pytest.mark.parametrize("mode", ["B", "P", "R", "S"])
def test_samples_of_any_bits(dtype, bits, mode):
    low = -(1 << bits - 1) if dtype.startswith("int") else 0
    high = (1 << bits - 1) - 1 if low else (1 << min(bits, 63)) - 1
    px = np.random.default_rng(bits).integers(low, high, (2, 20, 24), dtype=np.int64).astype(dtype)
    px[0, 0, 0], px[0, 0, 1] = low, high
    data = nitf.encode([(px, {"NBPP": bits})], block_size=(8, 8), mode=mode)
    asset = nitf.assets(data)[0]
    assert asset.dtype == dtype and (whole(nitf, data, asset) == px).all()


def test_justified_samples():
    asset = Asset("image:0", bits=16, dtype="uint16", private={"actual": 12, "left": True})
    px = np.array([0xABC0, 0x1230], np.uint16)
    assert nitf.aligned(px, asset).tolist() == [0xABC, 0x123]
    asset.private["left"] = False
    assert nitf.aligned(np.array([0xFABC], np.uint16), asset).tolist() == [0xABC]


def test_overflow_records():
    px = image((1, 8, 8), "uint8")
    long = b"".join(record(f"OWN{i:03d}", bytes([65 + i]) * 40_000) for i in range(4))
    data = nitf.encode([(px, {"records": long}), (px, {"records": record("LAST", b"z")})], data=[(b"body", {"DESID": "MINE"})])
    first, second, *rest = nitf.assets(data)
    assert {f"OWN{i:03d}" for i in range(4)} <= set(first.metadata) and "OWN000" not in second.metadata and "LAST" in second.metadata
    assert [a.metadata["DESID"] for a in rest] == ["MINE", "TRE_OVERFLOW"] and (nitf.block(data, first, 0, 0) == px).all()
    stated, expected = nitf.expected_length(data)
    assert stated == expected == len(data)
    at = data.index(record("OWN000", b"A" * 40_000)) - 3
    with pytest.raises(FormatError, match="names data segment 7 of 2"):
        nitf.assets(data[:at] + b"007" + data[at + 3 :])
    for wrong in ({"DESID": ""}, {"DESID": "x" * 26}, {"DESVER": "1"}, {"DESVER": 123}):
        with pytest.raises(FormatError):
            nitf.encode([], data=[(b"", wrong)])


def test_graphics_tables_and_levels():
    px = image((1, 8, 8), "uint8")
    table = bytes(range(256))
    data = nitf.encode([(px, {"LUTS": [table, table[::-1], table], "ABPP": 7, "PJUST": "L"})], graphics=[(b"CGM body", {"SID": "G1", "SDLVL": 5})], texts=[("t", {})])
    first, graphic, text = nitf.assets(data)
    assert [bytes(t) for t in first.private["tables"]] == [table, table[::-1], table] and first.metadata["IREP"] == "RGB/LUT"
    assert first.private["actual"] == 7 and first.private["left"] and (nitf.block(data, first, 0, 0) == px).all()
    assert (graphic.kind, graphic.metadata["SID"], graphic.metadata["SDLVL"]) == ("graphics", "G1", "005") and data[graphic.offset : graphic.offset + graphic.length] == b"CGM body"
    assert text.kind == "text" and nitf.segments(data)[1][1]["sub_len"] == 258
    assert [nitf.complexity([(1, n, 3)]) for n in (1, 2048, 2049, 8193, 65537)] == [3, 3, 5, 6, 7]
    with pytest.raises(FormatError):
        nitf.encode([(image((2, 4, 4), "uint8"), {"LUTS": [table]})])


def test_coded_blocks_go_through_hooks():
    px = image((1, 40, 50), "uint8")
    with pytest.raises(FormatError, match="no encoder"):
        nitf.encode([(px, {})], compression="C5")

    def decode(data, asset, br, bc):
        at, size = nitf.coded_range(asset, br, bc)
        return np.frombuffer(zlib.decompress(data[at : at + size]), np.uint8).reshape(1, asset.bh, asset.bw)

    register_codec("nitf:C4", decode, lambda px, meta: zlib.compress(np.ascontiguousarray(px).tobytes()))
    data = nitf.encode([(px, {})], block_size=(16, 16), compression="C4")
    asset = nitf.assets(data)[0]
    assert asset.private["ic"] == "M4" and (whole(nitf, data, asset) == px).all()
    ends = sorted(r[0] for r in nitf.ranges(asset).values())
    assert len(ends) == 12 and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))


def smooth(shape):
    y, x = np.mgrid[: shape[1], : shape[2]]
    return np.stack([(128 + 100 * np.sin(x / (9 + b)) * np.cos(y / (7 + b))) for b in range(shape[0])]).astype(np.uint8)


@pytest.mark.parametrize("bands", [1, 3])
@pytest.mark.parametrize("size", [(8, 8), (37, 51), (64, 40)])
def test_jpeg_round_trip(bands, size):
    px = smooth((bands, *size))
    for quality, most in ((95, 6), (60, 30)):
        back = jpeg.decode(jpeg.encode(px, quality=quality)).astype(int)
        assert back.shape == px.shape and abs(back - px).max() <= most and abs(back - px).mean() < most / 4
    assert (jpeg.decode(jpeg.encode(np.full((bands, *size), 77, np.uint8))) == 77).all()
    noise = image((bands, *size), "uint8")
    assert abs(jpeg.decode(jpeg.encode(noise, quality=100)).astype(int) - noise).max() <= 4


def test_jpeg_blocks_in_containers():
    px = smooth((1, 40, 50))
    data = nitf.encode([(px, {"quality": 95})], block_size=(16, 16), compression="C3")
    asset = nitf.assets(data)[0]
    assert asset.private["ic"] == "M3" and abs(whole(nitf, data, asset).astype(int) - px).max() <= 6
    found = jpeg.streams(data, asset.offset, asset.offset + asset.length)
    assert [(o, n) for o, n in found] == sorted(r[0] for r in nitf.ranges(asset).values())
    asset.private["mask"] = None  # as in files without a mask table
    assert abs(whole(nitf, data, asset).astype(int) - px).max() <= 6
    one = jpeg.assets(jpeg.encode(px))[0]
    assert (one.rows, one.cols, one.bands) == (40, 50, 1)
    with pytest.raises(FormatError):
        jpeg.encode(px.astype(np.uint16))
    with pytest.raises(FormatError):
        jpeg.quantisation(0)


def test_float_differences_and_small_samples():
    px = np.random.default_rng(3).normal(size=(6, 16, 2)).astype(">f4")
    planes = np.frombuffer(px.tobytes(), np.uint8).reshape(6, 32, 4).transpose(0, 2, 1).reshape(6, -1, 2).astype(np.int16)
    stored = np.concatenate([planes[:, :1], planes[:, 1:] - planes[:, :-1]], axis=1).astype(np.uint8).tobytes()
    asset = Asset("image:0", rows=6, cols=16, bands=2, bh=6, bw=16, dtype="float32", bits=32, private={"order": "<", "compression": 1, "predictor": 3, "tiled": True, "planar": 1})
    assert (tiff.decode_tile(stored, asset, 6, 2) == px.transpose(2, 0, 1)).all()
    for bits in (1, 2, 4):
        small = np.random.default_rng(bits).integers(1 << bits, size=(5, 11)).astype(np.uint8)
        ones = (small[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1
        asset = Asset("image:0", rows=5, cols=11, bands=1, bh=5, bw=11, dtype="uint8", bits=bits, private={"order": "<", "compression": 1, "predictor": 1, "tiled": True, "planar": 1})
        assert (tiff.decode_tile(np.packbits(ones.reshape(5, -1), axis=1).tobytes(), asset, 5, 1)[0] == small).all()
        grey = small[None] * (255 // ((1 << bits) - 1))
        data = png.encode(grey, bits=bits)
        assert png.assets(data)[0].bits == bits and (png.block(data, png.assets(data)[0], 0, 0) == grey).all()
    with pytest.raises(FormatError):
        png.encode(np.full((1, 2, 2), 3, np.uint8), bits=1)


def test_open_rules(spark, tmp_path):
    with pytest.raises(ValueError):
        api.open_dataset(spark, "x", "a")
    with pytest.raises(ValueError):
        api.open_dataset(spark, [])
    for roles in ([["data"], ["data"]], [["data"]], ["nothing", "overview:0"]):
        with pytest.raises(ValueError):
            api.open_dataset(spark, ["a.tif", "b.tif"], roles=roles)
    assert [api.format_for(p) for p in ("a/b.TIF.r2", "x.hr3", "y.nsf")] == ["tiff", "nitf", "nsif"] and api.format_for("z", "png") == "png"
    for wrong in (("z.what", None), ("z.tif", "what")):
        with pytest.raises(ValueError):
            api.format_for(*wrong)
    px = image((1, 40, 30), "uint8")
    blocks = image_blocks(spark, px, (16, 16))
    api.open_dataset(spark, f"{tmp_path}/out.png", "w").save(blocks)
    with pytest.raises(ValueError, match="twice"):
        api.open_dataset(spark, f"{tmp_path}/out.png", "w").save(blocks.union(blocks))
    found = api.open_dataset(spark, f"{tmp_path}/out.png", roles=["thumbnail"])
    assert [(r["rows"], r["roles"]) for r in found.assets("image").collect()] == [(40, ["thumbnail"])]
    assert found.tile_index().count() == 1 and (np.frombuffer(found.blocks().first()["payload"], np.uint8).reshape(1, 40, 30) == px).all()
    half = image_blocks(spark, px[:, ::2, ::2].copy(), (16, 16)).withColumn("level", F.lit(1))
    api.open_dataset(spark, [f"{tmp_path}/p.tif", f"{tmp_path}/p.tif.r1"], "w").save(blocks.unionByName(half))
    levels = api.open_dataset(spark, [f"{tmp_path}/p.tif", f"{tmp_path}/p.tif.r1"]).assets().collect()
    assert sorted((r["level"], r["key"], r["rows"]) for r in levels) == [(0, "image:0", 40), (1, "image:0:overview:1", 20)]


def test_types_must_be_there():
    with pytest.raises(LayoutError, match="no type"):
        load({"meta": {"id": "x"}, "seq": [{"id": "a", "type": "missing"}]})


def test_fields_that_do_not_fit(spark):
    df = spark.createDataFrame([("A", "xé"), ("TOOLONG", "x"), ("B", "y" * 100_000), ("É", "x")], "tag string, data string")
    got = [r[0] for r in df.select(segments.record(F.col("tag"), F.col("data"))).collect()]
    assert got == ["A     00003xé", None, None, None]
    ids = spark.createDataFrame([("BE12", "S", "US"), ("B" * 11, "", "")], "be string, suffix string, country string")
    made = ids.select(location.target_id(F.col("be"), F.col("suffix"), F.col("country")).alias("t")).select("t", location.target_parts(F.col("t")).alias("p")).collect()
    assert len(made[0]["t"]) == 17 and tuple(made[0]["p"]) == ("BE12", "S", "US") and made[1]["t"] is None and made[1]["p"] is None
    far = spark.createDataFrame([(140_000_000, 5, 1.0), (140_000_000, 3_000_000, 2.0)], "row long, col long, v double")
    assert sorted(tuple(r) for r in raster.retile(far, (32, 16), (1 << 30, 1 << 30)).collect()) == [(0, 0, 2, 2.0, 2)]
