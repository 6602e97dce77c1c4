import numpy as np
import pytest

from tileweave.sources import georef, tags
from tileweave.sources.formats import FormatError
from tileweave.sources.memory import data_asset, derived, image_blocks, mapped, retiled, text_asset, with_block
from tileweave.sources.sinks import assembled

PX = (np.random.default_rng(3).random((2, 37, 53)) * 99).astype(np.int16)


def test_blocks_in_memory(spark):
    blocks = image_blocks(spark, PX, (16, 16))
    assert (assembled(blocks.toPandas()) == PX).all()
    changed = with_block(blocks, 0, 1, PX[:, :16, :16] * 2)
    assert changed.count() == 12 and (assembled(changed.toPandas())[:, :16, 16:32] == PX[:, :16, :16] * 2).all()
    assert (assembled(mapped(blocks, lambda px: px + 1).toPandas()) == PX + 1).all()
    whole = derived(blocks.where("br = 1"), mapped(blocks, lambda px: px * 0))
    got = assembled(whole.toPandas())
    assert (got[:, 16:32] == PX[:, 16:32]).all() and (got[:, :16] == 0).all()
    with pytest.raises(FormatError):
        image_blocks(spark, PX[0], (16, 16))


@pytest.mark.parametrize("target", [(16, 16), (10, 24), (40, 60), (8, 8)])
def test_retiled(spark, target):
    got = retiled(image_blocks(spark, PX, (16, 16)), (16, 16), target)
    assert (assembled(got.toPandas()) == PX).all()
    assert got.count() == -(-37 // target[0]) * -(-53 // target[1])


def test_other_assets(spark):
    assert bytes(text_asset(spark, "é", encoding="latin-1").first()["content"]) == b"\xe9"
    assert data_asset(spark, b"<x/>", "text/xml").first()["media_type"] == "text/xml"


def test_georeferencing():
    assert georef.geo_keys(4326) == [1, 1, 1, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326]
    assert georef.parsed_geo_keys(georef.geo_keys(32633))[3072] == 32633
    assert georef.parsed_geo_keys([1, 1, 0, 2, 2057, 34736, 1, 1, 1026, 34737, 4, 0], [1.0, 6378137.0], "abc|") == {2057: 6378137.0, 1026: "abc"}
    assert georef.tiff_georef(4326, (0.5, 0.0, 10.0, 0.0, -0.5, 50.0))["ModelPixelScale"] == [0.5, 0.5, 0.0]
    assert len(georef.transform_tags((1, 0.1, 0, 0.1, -1, 0))["ModelTransformation"]) == 16
    assert georef.nitf_georef(4326, [(-71.5, 42.25), (0, 0), (0, -1), (1, 1)])["IGEOLO"][:15] == "421500N0713000W"
    assert georef.nitf_georef(32733, None) == {"ICORDS": "S"}
    with pytest.raises(FormatError):
        georef.checked_transform({"ModelTiepoint": [1.0]})
    with pytest.raises(FormatError):
        georef.parsed_geo_keys([1, 1, 0, 2])


def test_tags():
    names, entries = tags.TagNames({"Mine": 50000}), {}
    names.set(entries, "Compression", "Deflate")
    names.set(entries, "Mine", 7)
    assert entries == {"259": 8, "50000": 7} and names.get(entries, "Mine") == 7 and names.key("x") == "x"
    assert tags.inferred("a") == ("ASCII", ["a"]) and tags.inferred([1, 70000])[0] == "LONG" and tags.inferred(1.5) == ("DOUBLE", [1.5]) and tags.inferred({"value": 3, "type": "byte"}) == ("BYTE", [3])
    assert tags.custom({"259": 1, "50000": 2, "x": 3}) == {"50000": 2}
