import json

import numpy as np
import pytest

from tileweave.sources import datasource
from tileweave.sources.api import image_info, image_tiles, read_image, save_image
from tileweave.sources.formats import FormatError, nitf, png, tiff
from tileweave.sources.scan import block_pixels, files, range_bytes, scan_assets, scan_blocks, tile_index, with_pyramid
from tileweave.sources.sinks import encoded, references, save_files, write_tile_index
from tileweave.streaming.landing import landed_assets, landed_counts, landed

PX = (np.random.default_rng(0).random((3, 70, 90)) * 250).astype(np.uint8)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("images")
    (at / "a.ntf").write_bytes(nitf.encode([(PX, {})], [("note", {})], block_size=(32, 32), present=lambda k, r, c: (r, c) != (1, 1)))
    (at / "b.tif").write_bytes(tiff.encode([(PX, {}), (PX[:, ::2, ::2], {"overview": True})], (32, 32)))
    (at / "c.png").write_bytes(png.encode(PX))
    (at / "c.png.r1").write_bytes(png.encode(PX[:, ::2, ::2]))
    (at / "junk.bin").write_bytes(b"nothing")
    return at


def test_assets(spark, folder):
    found = {(r["path"].rsplit("/", 1)[1], r["key"]): r for r in scan_assets(files(spark, str(folder))).collect()}
    assert found["a.ntf", "image:0"]["rows"] == 70 and found["a.ntf", "text:0"]["kind"] == "text"
    assert found["b.tif", "image:0:overview:1"]["roles"] == ["overview"]
    assert found["junk.bin", None]["warning"].startswith("FormatError")
    assert json.loads(found["a.ntf", "image:0"]["metadata"])["IC"] == "NM"
    levels = {r["key"]: r["level"] for r in with_pyramid(scan_assets(files(spark, str(folder / "c.png*")))).collect()}
    assert levels == {"image:0": 0, "image:0:overview:1": 1}


def test_blocks_and_index(spark, folder):
    contents = files(spark, str(folder / "a.ntf"))
    blocks = scan_blocks(contents, "image:0")
    assert blocks.count() == 8
    assert block_pixels(blocks).count() == 8 * 0 + sum(b["bands"] * b["rows"] * b["cols"] for b in blocks.collect())
    index = tile_index(contents)
    raw = {(r["br"], r["bc"]): bytes(r["data"]) for r in range_bytes(index, contents).collect()}
    assert len(raw) == 8 and raw[0, 0] == np.ascontiguousarray(PX[:, :32, :32]).tobytes()


def test_index_sinks(spark, folder, tmp_path):
    index = tile_index(files(spark, str(folder / "b.tif")))
    for form in ("parquet", "json"):
        write_tile_index(index, str(tmp_path / form), ["image:0"], form)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 9
    refs = references(index).where("key = 'image:0'").collect()
    assert len(refs) == 9 and all(len(json.loads(r["reference"])) == 3 for r in refs)


def test_windows(spark, folder):
    assert (read_image(spark, str(folder / "b.tif"), (10, 20, 40, 50)) == PX[:, 10:50, 20:70]).all()
    assert (read_image(spark, str(folder / "b.tif"), (60, 80, 99, 99), [2, 0, 2]) == PX[[2, 0, 2], 60:, 80:]).all()
    masked = read_image(spark, str(folder / "a.ntf"), fill=7)
    assert (masked[:, 32:64, 32:64] == 7).all() and (masked[:, :32] == PX[:, :32]).all()
    with pytest.raises(FormatError):
        read_image(spark, str(folder / "b.tif"), (70, 0, 1, 1))
    assert image_info(spark, str(folder / "b.tif")).first()["key"] == "image:0"
    tiles = list(image_tiles(spark, str(folder / "c.png"), (40, 60)))
    assert [(r, c) for r, c, _ in tiles] == [(0, 0), (0, 1), (1, 0), (1, 1)] and tiles[3][2].shape == (3, 30, 30)


@pytest.mark.parametrize("fmt", ["tiff", "nitf", "nsif", "png"])
def test_save(spark, tmp_path, fmt):
    save_image(spark, str(tmp_path / f"x.{fmt}"), PX, fmt)
    assert (read_image(spark, str(tmp_path / f"x.{fmt}"), fmt=fmt) == PX).all()


def test_convert_in_bulk(spark, folder, tmp_path):
    blocks = scan_blocks(files(spark, str(folder / "b.tif")), "image:0").withColumnRenamed("path", "p").selectExpr("concat(p, '.ntf') path", "*").drop("p")
    done = save_files(encoded(blocks, "nitf", block_size=(64, 64), mode="P"), str(tmp_path)).collect()
    assert (read_image(spark, done[0]["path"]) == PX).all()


def test_data_source(spark, folder):
    datasource.register(spark)
    df = spark.read.format("tileweave").load(str(folder / "a.ntf"))
    assert df.count() == 8
    one = df.where("br = 0 AND bc = 2").collect()
    assert len(one) == 1 and bytes(one[0]["payload"]) == np.ascontiguousarray(PX[:, :32, 64:]).tobytes()


def test_landing(spark, folder, tmp_path):
    query = landed_assets(spark, str(folder)).writeStream.format("memory").queryName("landed_assets").option("checkpointLocation", str(tmp_path / "a")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("landed_assets").where("kind = 'image'").count() == 5
    counts = landed_counts(landed(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("landed_counts").option("checkpointLocation", str(tmp_path / "b")).start()
    counts.processAllAvailable()
    counts.stop()
    assert sum(r["files"] for r in spark.table("landed_counts").collect()) == 5
