"""Tables of windows, pushed ranges, coalesced requests, providers, codecs on workers, compiled definitions, levels."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tileweave.functions import numeric
from tileweave.operators import blocks, raster, segments, windows
from tileweave.plans import catalogue, records
from tileweave.sources import chips, datasource, provider, ranged, scan
from tileweave.sources.formats import nitf, register_codec, registered_codecs, tiff
from tileweave.structure import codec, columns
from tileweave.structure.expression import ExpressionError, evaluate
from tileweave.structure.layout import load

RNG = np.random.default_rng(7)

# --- windows ------------------------------------------------------------------


def rects(n, seed, images=3, span=300):
    rng = np.random.default_rng(seed)
    return [(i, int(rng.integers(images)), *(int(v) for v in rng.integers(-20, span, 2)), *(int(v) for v in rng.integers(0, 90, 2))) for i in range(n)]


@pytest.mark.parametrize("cell", [(1, 7), (16, 16), (64, 100), (1000, 1000)])
def test_overlaps_equal_brute_force(spark, cell):
    w, b = rects(60, 1), rects(80, 2)
    left = spark.createDataFrame(w, "id int, image int, y int, x int, h int, w int")
    right = spark.createDataFrame(b, "block int, image int, y int, x int, h int, w int")
    got = sorted(tuple(r) for r in windows.overlaps(left, right, ["image"], cell).select("id", "block", "oy", "ox", "oh", "ow").collect())
    wanted = []
    for i, m, y, x, h, v in w:
        for j, n, by, bx, bh, bv in b:
            oy, ox = max(y, by), max(x, bx)
            oh, ow = min(y + h, by + bh) - oy, min(x + v, bx + bv) - ox
            if m == n and oh > 0 and ow > 0:
                wanted.append((i, j, oy, ox, oh, ow))
    assert got == sorted(wanted) and len(got) > 50


def test_windows_join_by_keys(spark):
    """No nested loop, and a window of many images' windows doesn't gather them in one task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = spark.range(40_000).select("id", F.lit(1).alias("image"), (F.col("id") * 37 % 20_000).alias("y"), (F.col("id") * 91 % 20_000).alias("x"), F.lit(40).alias("h"), F.lit(40).alias("w"))
        tiles = raster.tile_grid(spark.createDataFrame([(1, 20_000, 20_000)], "image int, rows int, cols int"), 256, 256).select("image", "tr", "tc", "y", "x", "h", "w")
        met = windows.overlaps(many, tiles, ["image"])
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        cells = windows.covered(many, (256, 256)).repartition(16, "image", "cy", "cx").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in cells) < 2 * sum(r["count"] for r in cells) / len(cells)
        assert met.count() >= 40_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_exploded_table_is_broadcast(spark, sf_dir):
    """Catalyst takes tiles and cells for as small as the table they come from, and would send all of them to every worker."""
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    left = spark.range(60).select("id", F.lit(1).alias("image"), (F.col("id") * 7).alias("y"), F.col("id").alias("x"), F.lit(40).alias("h"), F.lit(40).alias("w"))
    met = windows.overlaps(left, left.withColumnRenamed("id", "block"), ["image"], (16, 16))
    assert "Generate" in plan_of(met) and "Broadcast" not in plan_of(met)
    plan = plan_of(catalogue.QUERIES["window_tiles"](spark, sf_dir))
    assert "Generate" in plan and "Generate" not in plan[plan.index("Join") :]


@pytest.mark.parametrize(("size", "lap"), [((16, 40), (0, 0)), ((16, 40), (4, 39)), ((7, 1), (3, 0)), ((500, 500), (16, 0))])
def test_window_tiles_equal_brute_force(spark, size, lap):
    shapes = [(0, 200, 130), (1, 96, 17), (2, 1, 1), (2, 30, 45), (3, 0, 50), (4, 16, 16), (None, 90, 90)]
    odd = [(900, 0, None, 5, 9, 9), (901, 0, 5, None, 9, 9), (902, 0, 5, 5, None, 9), (903, None, 5, 5, 9, 9), (904, 7, 5, 5, 9, 9), (905, 3, -5, 5, 20, 20), (906, 0, -50, -50, 2**31 - 1, 2**31 - 1)]
    w = rects(200, 3, 5, 220) + odd
    images = spark.createDataFrame(shapes, "image int, rows int, cols int")
    left = spark.createDataFrame(w, "id int, image int, y long, x long, h long, w long")
    got = sorted(tuple(r) for r in windows.window_tiles(left, images, ["image"], size, lap).select("id", "tr", "tc", "oy", "ox", "oh", "ow").collect())
    tiles = [tuple(r) for r in raster.tile_grid(images, *size, lap).select("image", "tr", "tc", "y", "x", "h", "w").collect()]
    wanted = []
    for i, m, y, x, h, v in w:
        for n, tr, tc, ty, tx, th, tw in tiles if None not in (m, y, x, h, v) else []:
            oy, ox = max(y, ty), max(x, tx)
            oh, ow = min(y + h, ty + th) - oy, min(x + v, tx + tw) - ox
            if m == n and oh > 0 and ow > 0 and h > 0 and v > 0:
                wanted.append((i, tr, tc, oy, ox, oh, ow))
    assert got == sorted(wanted) and len({r[0] for r in got}) > 30


def test_window_blocks_edges(spark):
    grids = spark.createDataFrame([("a", 100, 70, 32, 32), ("b", 10, 10, 64, 64)], "path string, rows int, cols int, bh int, bw int")
    wanted = [(1, "a", -5, -5, 10, 10), (2, "a", 95, 60, 50, 50), (3, "a", 100, 0, 5, 5), (4, "a", 0, 0, 0, 9), (5, "a", 0, 0, 1000, 1000), (6, "b", 3, 3, 2, 2), (7, "none", 0, 0, 9, 9), (8, None, 0, 0, 9, 9)]
    w = spark.createDataFrame(wanted, "id int, path string, y int, x int, h int, w int")
    got = {}
    for r in windows.window_blocks(w, grids, ["path"]).collect():
        got.setdefault(r.id, []).append((r.br, r.bc, r.oy, r.ox, r.oh, r.ow))
    assert sorted(got) == [1, 2, 5, 6] and got[1] == [(0, 0, 0, 0, 5, 5)] and got[6] == [(0, 0, 3, 3, 2, 2)]
    assert sorted(got[2]) == [(2, 1, 95, 60, 1, 4), (2, 2, 95, 64, 1, 6), (3, 1, 96, 60, 4, 4), (3, 2, 96, 64, 4, 6)]
    assert len(got[5]) == 12 and sum(oh * ow for *_, oh, ow in got[5]) == 7000


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    made = tmp_path_factory.mktemp("images")
    os.makedirs(made / "sub")
    images = {}
    for name, module in (("a.tif", tiff), ("b.ntf", nitf), ("sub/c.tif", tiff)):
        px = RNG.integers(0, 60_000, (2, 150, 200)).astype(np.uint16)
        data = module.encode([(px, {})], tile=(64, 64)) if module is tiff else module.encode([(px, {})], block_size=(64, 64))
        (made / name).write_bytes(data)
        images[str(made / name)] = px
    (made / "_hidden.tif").write_bytes(b"no image")
    return made, images


def test_many_windows_of_many_files(spark, folder):
    _, images = folder
    rng = np.random.default_rng(3)
    rows = [(i, p, "image:0" if p.endswith("tif") else None, int(rng.integers(-10, 140)), int(rng.integers(-10, 190)), int(rng.integers(1, 90)), int(rng.integers(1, 90))) for i, p in enumerate(list(images) * 12)]
    keys = {r.path: r.key for r in scan.scan_assets(spark.createDataFrame([(p,) for p in images], "path string")).where("kind = 'image'").collect()}
    rows = [(i, p, keys[p], *rest) for i, p, _, *rest in rows]
    wanted = spark.createDataFrame(rows, "id int, path string, key string, y int, x int, h int, w int")
    pieces = chips.window_pieces(spark, wanted)
    got = {r.id: np.frombuffer(r.payload, r.dtype).reshape(r.bands, r.rows, r.cols) for r in chips.assembled_windows(pieces, ["id"]).collect()}
    for i, p, _, y, x, h, w in rows:
        whole = np.zeros((2, 400, 500), np.uint16)
        whole[:, 100:250, 100:300] = images[p]
        assert np.array_equal(got[i], whole[:, 100 + y : 100 + y + h, 100 + x : 100 + x + w])


# --- pushed filters -----------------------------------------------------------


def test_filters_reach_the_source(spark, folder):
    made, images = folder
    datasource.register(spark)
    every = spark.read.format("tileweave").load(str(made))
    assert every.count() == 3 * 12 and {r.path for r in every.select("path").distinct().collect()} == set(images)
    for condition in ("br BETWEEN 1 AND 2", "br > 0 AND bc <= 1", "bc IN (0, 3)", "br = 1 AND bc = 1", "br >= 5", "level < 1 AND br < 1", f"path = '{made}/a.tif'", f"path IN ('{made}/a.tif', '{made}/b.ntf') AND br = 2", f"path LIKE '{made}/sub%'", "br % 2 = 1", "br IN (1, 2) AND br > 1", "br = 1 OR bc = 2"):
        got = sorted(map(tuple, every.where(condition).select("path", "br", "bc", "payload").collect()))
        listed = spark.createDataFrame(every.select("path", "level", "br", "bc", "payload").collect(), "path string, level int, br int, bc int, payload binary")
        assert got == sorted(map(tuple, listed.where(condition).select("path", "br", "bc", "payload").collect())), condition
    assert spark.read.format("tileweave").schema("bc int, path string, br int").load(str(made)).where("br = 1").count() == 12


def _reader(made, columns, *filters):
    found = datasource.BlockReader({"path": str(made)}, columns)
    assert list(found.pushFilters(list(filters))) == []
    return found


def test_what_is_read_follows_the_filters(folder, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThanOrEqual

    made, _ = folder
    read = []
    close = ranged.Ranged.__exit__
    monkeypatch.setattr(ranged.Ranged, "__exit__", lambda self, *a: (read.append(self.read), close(self, *a))[1])
    monkeypatch.setattr(ranged, "PAGE", 1 << 10)
    names = [c.split()[0] for c in scan.BLOCKS.split(", ")]

    def run(columns, *filters):
        read.clear()
        reader = _reader(made, columns, *filters)
        parts = reader.partitions()
        rows = [r for p in parts for r in reader.read(p)]
        return len(parts), len(rows), sum(read)

    parts, rows, whole = run(names)
    assert (parts, rows) == (3, 36)
    parts, rows, some = run(names, GreaterThanOrEqual(("br",), 1), LessThanOrEqual(("br",), 1))
    assert (parts, rows) == (3, 12) and some < 0.5 * whole
    parts, rows, one = run(names, In(("path",), (f"{made}/a.tif", "/nowhere.tif")))
    assert (parts, rows) == (1, 12) and one < 0.4 * whole
    parts, rows, bare = run(["path", "br", "bc"])
    assert (parts, rows) == (3, 36) and bare < 0.1 * whole
    assert run(names, EqualTo(("br",), 99))[1] == 0


# --- coalesced requests -------------------------------------------------------


def test_coalesced_bytes(spark, folder):
    _, images = folder
    index = scan.tile_index(spark.createDataFrame([(p,) for p in images], "path string"))
    one = {(r.path, r.br, r.bc): bytes(r.data) for r in scan.range_bytes(index).collect()}
    keys = ["path", "key", "level", "br", "bc"]
    for gap, extent, most in ((64, 1 << 24, 3), (1 << 20, 1 << 24, 3), (1 << 20, 30_000, 18), (-1, 1 << 24, 36), (0, 1 << 24, 36)):
        got = scan.coalesced_bytes(index, gap, extent).collect()
        assert {(r.path, r.br, r.bc): bytes(r.data) for r in got} == one
        assert len({(r.path, s) for r in got for s in r.requests}) <= most
    # A block of several ranges, in order, across requests.
    path = next(iter(images))
    held = open(path, "rb").read()
    odd = spark.createDataFrame([(path, "k", 0, 0, 0, [(5000, 10), (100, 20), (60_000, 5)]), (path, "k", 0, 0, 1, [(110, 30)])], scan.RANGES)
    got = {r.bc: (bytes(r.data), list(r.requests)) for r in scan.coalesced_bytes(odd, 16).select(*keys, "requests", "data").collect()}
    assert got[0] == (held[5000:5010] + held[100:120] + held[60_000:60_005], [5000, 100, 60_000]) and got[1] == (held[110:140], [100])
    assert scan.coalesced_bytes(odd.limit(0)).count() == 0


# --- providers and codecs -----------------------------------------------------


class Counting:
    """A provider that leaves a file for each block it is asked for."""

    def __init__(self, folder):
        self.folder = str(folder)

    def images(self):
        return [provider.ProvidedImage("mem", f"image:{k}", 1000, 640, 64, 64) for k in range(2)]

    def block(self, image, br, bc):
        import uuid

        open(f"{self.folder}/{image.key}-{br}-{bc}-{uuid.uuid4().hex}", "w").close()
        return None if (br, bc) == (0, 0) else np.full((1, 4, 4), br * 100 + bc, np.int32)


def test_providers_are_asked_for_wanted_blocks(spark, tmp_path):
    found = provider.provided_blocks(spark, Counting(tmp_path), "counting")
    got = found.where("br BETWEEN 2 AND 3 AND bc IN (1, 5) AND key = 'image:1'").collect()
    assert sorted((r.br, r.bc, np.frombuffer(r.payload, r.dtype)[0]) for r in got) == [(b, c, b * 100 + c) for b in (2, 3) for c in (1, 5)]
    assert sorted(f.rsplit("-", 1)[0] for f in os.listdir(tmp_path)) == [f"image:1-{b}-{c}" for b in (2, 3) for c in (1, 5)]
    assert spark.read.format("counting").schema("key string, br int").load().count() == 2 * 16 * 10 and len(os.listdir(tmp_path)) == 4
    assert found.where("br = 0 AND key = 'image:0'").count() == 9  # one isn't recorded


def test_codecs_reach_fresh_workers(spark, folder):
    made, images = folder
    before = registered_codecs()
    path = str(made / "a.tif")
    data = bytearray(open(path, "rb").read())
    # The file says that its tiles are of a compression nobody knows.
    asset = next(a for a in tiff.assets(bytes(data)) if a.kind == "image")
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(order + "I", data[4:8])[0]
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        place = at + 2 + 12 * k
        if struct.unpack(order + "H", data[place : place + 2])[0] == 259:
            data[place + 8 : place + 10] = struct.pack(order + "H", 60_001)
    (made / "sub" / "_own").mkdir(exist_ok=True)
    own = made / "sub" / "_own" / "own.tif"
    own.write_bytes(bytes(data))
    one = spark.createDataFrame([(str(own),)], "path string")

    def decode(data, asset, br, bc):
        return np.full((2, 64, 64), br * 10 + bc, np.uint16)

    try:
        register_codec("tiff:60001", decode)
        got = {(r.br, r.bc): np.frombuffer(r.payload, r.dtype)[0] for r in scan.scan_blocks(one).collect()}
        assert got == {(b, c): b * 10 + c for b in range(3) for c in range(4)} and asset.grid == (3, 4)
        datasource.register(spark)
        assert spark.read.format("tileweave").load(str(own)).where("br = 1").count() == 4
    finally:
        from tileweave.sources.formats import using

        using(before)
    with pytest.raises(Exception, match="60001"):
        scan.scan_blocks(one).collect()


# --- expressions and definitions as Columns -----------------------------------

VALUES = {"a": 7, "b": -3, "z": 0, "f": 2.5, "s": " 12 ", "t": "xy", "yes": True, "no": False, "big": 2**62}
TEXTS = [
    "a + b * 2", "a / b", "b / a", "a % b", "b % a", "a / z", "a % z", "f / 2", "f / z", "a + f", "s + t", "a + t", "a - -b", "~a", "-f", "not yes", "not a", "a & b | 4 ^ 1", "a << 3 >> 1", "a << 64", "a << b", "f & 1", "a < f", "a >= 7", "t < s",
    "a == 7.0", "a == t", "a != t", "t == 'xy'", "yes == no", "yes == a", "yes and no", "yes or no", "no and a", "yes and a", "a and yes", "yes or a / z == 1", "no and a / z == 1", "no or a / z == 1", "s.to_i + 1", "t.to_i", "f.to_i", "a.to_s + t", "s.strip",
    "t.length + s.length", "(a + b) * (a - b) == a * a - b * b", "0x1F & a", "a > b and (f > 2 or no)", "big + big", "big * 4", "yes.to_s",
]


def test_compiled_expressions_equal_the_evaluator(spark):
    kinds = {int: "int", float: "float", str: "str", bool: "bool"}
    given = columns.scope({k: (F.lit(v), kinds[type(v)]) for k, v in VALUES.items()})
    made = [columns.compiled(t, given).column.alias(f"c{i}") for i, t in enumerate(TEXTS)]
    got = spark.range(1).select(*made).first()
    for text, value in zip(TEXTS, got):
        try:
            wanted = evaluate(text, VALUES)
            if isinstance(wanted, int) and not isinstance(wanted, bool) and abs(wanted) >= 2**63:
                wanted = None  # beyond a long
        except ExpressionError:
            wanted = None
        assert value == wanted and type(value) is type(wanted), text
    for text in ("nothing + 1", "a.nothing", "a[0]"):
        with pytest.raises(ExpressionError):
            columns.compiled(text, given)


def plain(value):
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    return [plain(v) for v in value] if isinstance(value, list) else bytes(value) if isinstance(value, (bytes, bytearray)) else value


def full(layout, values):
    """The reader's values with nulls for what is absent, as Columns have them."""
    out = {}
    for f in layout.fields:
        v = values.get(f.id)
        inner = layout.types.get(f.type)
        if inner is not None and v is not None:
            v = [full(inner, x) for x in v] if f.repeat else full(inner, v)
        out[f.id] = str(v) if f.enum and v is not None else v
    return out


EVERY = load("""
meta: {id: every, endian: le}
seq:
  - {id: a, type: u2}
  - {id: b, type: s3}
  - {id: c, type: f4}
  - {id: d, type: f8}
  - {id: e, type: u8}
  - {id: n, type: u1}
  - {id: pairs, type: pair, repeat: expr, repeat-expr: n % 4}
  - {id: raw, size: n % 3}
  - {id: text, type: str, size: 4, encoding: UTF-8, if: raw.length > 0 or pairs.length > 1}
  - {id: sized, type: tail, size: 5}
  - {id: first, type: u1, if: "pairs[0].x > 9"}
  - {id: rest, type: pair, repeat: eos}
types:
  pair: {seq: [{id: x, type: u1}, {id: y, type: s2, if: x % 2 == 0}]}
  tail: {seq: [{id: head, type: u1}, {id: left, size-eos: true}]}
""")


@pytest.mark.parametrize("layout", [EVERY, records.ORDER], ids=lambda x: x.id)
def test_compiled_definitions_equal_the_reader(spark, layout):
    rng = np.random.default_rng(11)
    data = [bytes(rng.integers(0, 256, int(n)).astype(np.uint8)) for n in rng.integers(0, 60, 150)]
    data += [b"\x01\x00\xff\xff\xff\x00\x00\xc0\x7f" + struct.pack("<dQB", v, 2**63 + 5, 0) + b"wxyz!" for v in (0.0, -0.0, 1e-310, -1.5, 1e308, float("inf"))]
    data += [b"\x01\x02" + b"033-M\x00\x00\x00\x09\x00\x02\x02q\x03rs\xff\xff\xff\xfe\x05\x00\x00\x00\x04\x80\x00end"[:k] for k in range(0, 40, 3)]
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "id int, data binary")
    right = 0
    for r in columns.parsed(df, layout, "data").collect():
        body = data[r.id]
        try:
            wanted, end = codec.read(layout, body, 0, places := {})
        except (codec.StructureError, ExpressionError, ValueError):
            assert r.record.error is not None, (r.id, body)
            continue
        if r.record.error is not None:
            assert "without bytes" in r.record.error or "gives no count" in r.record.error, (r.record.error, body)
            continue
        right += 1
        got = plain(r.record.value)
        same = full(layout, wanted)
        if layout is EVERY:
            same["e"] = same["e"] - (1 << 64) if same["e"] >= 1 << 63 else same["e"]  # longs
            for k in ("c", "d"):
                assert got[k] == same[k] or (got[k] != got[k] and same[k] != same[k])
                got[k] = same[k] = None
            got["text"] = same["text"] = None if got["text"] is None else "".join(got["text"].split("�"))
        assert got == same and r.record.end == end
        for name, place in plain(r.record.place).items():
            assert (place["start"], place["length"]) == places[name] if name in places else place is None
    assert right > 4
    assert columns.parsed(spark.createDataFrame([(None,)], "data binary"), layout, "data").first().record is None


def test_walked_chains(spark):
    chain = b"ABC   00003xyzDEF_1 00000GHI   00002\xff\x00"
    rows = [chain, chain + b"  \0\0 ", chain[:-1], chain + b"?", b"", b" ", b"\0" * 40, chain[:15], b"toolonglength", b"ABC   -0001xyz", None]
    df = spark.createDataFrame([(i, bytearray(c) if c is not None else None) for i, c in enumerate(rows)], "id int, data binary")
    got = {r.id: None if r.r is None else [(x.at, x.tag, None if x.data is None else bytes(x.data), x.error) for x in r.r] for r in df.select("id", segments.walked_records(F.col("data")).alias("r")).collect()}
    three = [(0, "ABC", b"xyz", None), (14, "DEF_1", b"", None), (25, "GHI", b"\xff\x00", None)]
    assert got[0] == got[1] == three
    assert got[2] == three[:2] + [(25, None, None, "the record is cut")] and got[3] == three + [(38, None, None, "no tagged record")]
    assert got[4] == got[5] == got[6] == [] and got[7] == three[:1] + [(14, None, None, "no tagged record")]
    assert got[8] == [(0, None, None, "no tagged record")] == got[9] and not got[10]


def test_numbers_of_every_size(spark):
    data = bytes(range(250, 256)) + bytes(range(10))
    df = spark.createDataFrame([(bytearray(data),)], "d binary")
    for size in range(1, 9):
        for little in (False, True):
            for at in range(len(data) + 2):
                part = data[at : at + size]
                order = "little" if little else "big"
                got = df.select(numeric.read_signed(F.col("d"), at, size, little), numeric.read_unsigned(F.col("d"), at, size, little)).first() if at in (0, 3, 8, 9, 15, 16, 17) else None
                if got is not None:
                    whole = len(part) == size
                    assert got[0] == (int.from_bytes(part, order, signed=True) if whole else None) and (None if got[1] is None else int(got[1])) == (int.from_bytes(part, order) if whole else None)


def test_floats_of_every_kind(spark):
    values = [0.0, -0.0, 1.0, -1.5, 2.0**-1022, 2.0**-1030, 5e-324, 1.7976931348623157e308, 0.1, 1 - 2**-53, 8.0, 7.999999999999999, float("inf"), float("-inf"), 1e-45, 3.4028235e38, 1e-40, 2.0**-126, None]
    rng = np.random.default_rng(2)
    values += [float(v) for v in rng.normal(size=60) * 10.0 ** rng.integers(-300, 300, 60)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    both = [numeric.write_float(F.col("v"), size, little).alias(f"b{size}{little}") for size in (4, 8) for little in (False, True)]
    for r in df.select("id", "v", *both).collect():
        for size in (4, 8):
            for little in (False, True):
                got = r[f"b{size}{little}"]
                if r.v is None:
                    assert got is None
                    continue
                with np.errstate(over="ignore", under="ignore"):
                    wanted = np.array(r.v).astype(("<" if little else ">") + f"f{size}").tobytes()
                assert bytes(got) == wanted, (r.v, size)
    back = df.select("v", numeric.read_float(numeric.write_float(F.col("v"), 8), 0, 8).alias("b")).collect()
    assert all(r.v == r.b for r in back)
    nan = spark.range(1).select(numeric.write_float(F.lit(float("nan")), 8).alias("b"), numeric.read_float(F.lit(b"abc"), 0, 4).alias("short")).first()
    assert bytes(nan.b) == struct.pack(">d", float("nan")) and nan.short is None


def test_uris_and_keys(spark):
    given = ["image.ntf", "/path/to/image.ntf", "file:///path/to/image.ntf", "s3://bucket/key/image.ntf", "/path/to/image", "/path.d/to/image", "/p/.hidden", "S3A://b/x.TIF.r1", "", None, "a://", "c:\\x.tif"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(given)], "id int, u string")
    got = {r.id: None if r.p is None else tuple(r.p) for r in df.select("id", segments.uri_parts(F.col("u")).alias("p")).collect()}
    assert [got[i] for i in range(11)] == [
        ("file", "image.ntf", "ntf"), ("file", "/path/to/image.ntf", "ntf"), ("file", "/path/to/image.ntf", "ntf"), ("s3", "bucket/key/image.ntf", "ntf"), ("file", "/path/to/image", None),
        ("file", "/path.d/to/image", None), ("file", "/p/.hidden", "hidden"), ("s3a", "b/x.TIF.r1", "r1"), ("file", "", None), None, ("a", "", None),
    ]


# --- similarity and levels ----------------------------------------------------


def test_window_similarity_equals_numpy(spark):
    left, right = RNG.integers(0, 200, (40, 33)), RNG.integers(0, 200, (40, 33))
    rows = [("i", y, x, int(left[y, x]), int(right[y, x])) for y in range(40) for x in range(33)]
    px = spark.createDataFrame(rows, "image string, row int, col int, l long, r long")
    view = lambda a: np.lib.stride_tricks.sliding_window_view(a.astype(float), (7, 7)).reshape(34, 27, 49)
    a, b = view(left), view(right)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    cov = ((a - a.mean(-1, keepdims=True)) * (b - b.mean(-1, keepdims=True))).sum(-1) / 48
    wanted = (2 * a.mean(-1) * b.mean(-1) + c1) * (2 * cov + c2) / ((a.mean(-1) ** 2 + b.mean(-1) ** 2 + c1) * (a.var(-1, ddof=1) + b.var(-1, ddof=1) + c2))
    for block in ((8, 8), (5, 64), (128, 128)):
        got = {(r.row, r.col): r.ssim for r in raster.window_similarity(px, ["image"], "l", "r", 255, 7, block).collect()}
        assert len(got) == 34 * 27 and all(abs(got[y + 3, x + 3] - wanted[y, x]) < 1e-9 for y in range(34) for x in range(27))
    halo = raster.with_halo(px, (8, 8), 3).groupBy("br", "bc").count()
    assert halo.agg(F.max("count")).first()[0] <= 14 * 14


def test_levels(spark):
    levels = spark.createDataFrame([("a", 0, 1.0, 100), ("a", 1, 2.0, 50), ("a", 2, 4.0, 26), ("b", 1, 2.0, 9), ("c", 0, 1.0, 1), ("c", 1, 2.0, 1), ("d", 0, None, 7), ("d", 2, 4.0, 2)], "image string, level int, scale double, size int")
    requests = spark.createDataFrame([(i, im, s) for i, (im, s) in enumerate([("a", 0.5), ("a", 1.0), ("a", 3.9), ("a", 99.0), ("b", 1.0), ("d", 9.0), ("x", 1.0), ("a", None)])], "id int, image string, wanted double")
    got = {r.id: r.level for r in blocks.level_choice(requests, levels, ["image"], "wanted", "scale", ["level"]).collect()}
    assert [got[i] for i in range(7)] == [0, 0, 1, 2, 1, 2, None] and len(got) == 8
    nests = {(r.image, r.level): r.nests for r in blocks.level_checks(levels, ["image"], "level", "size", "size").collect()}
    assert nests == {("a", 0): True, ("a", 1): True, ("a", 2): False, ("b", 1): False, ("c", 0): True, ("c", 1): True, ("d", 0): True, ("d", 2): False}


# --- files by many tasks ------------------------------------------------------


def made_blocks(spark, image, size, parts=6, path="x.tif", key="image:0", level=0):
    from tileweave.sources.memory import image_blocks

    return image_blocks(spark, image, size, path, key).withColumn("level", F.lit(level)).repartition(parts)


@pytest.mark.parametrize("compress", [False, True])
def test_files_by_many_tasks(spark, tmp_path, compress):
    from tileweave.sources import placed
    from tileweave.sources.sinks import assembled

    base, half = RNG.integers(0, 60_000, (3, 200, 333)).astype(np.uint16), RNG.integers(0, 60_000, (3, 100, 167)).astype(np.uint16)
    table = made_blocks(spark, base, (64, 48)).unionByName(made_blocks(spark, half, (64, 48), 3, key="image:0:overview:1", level=1))
    target = str(tmp_path / "out.tif")
    size = placed.write_tiff(table, target, compress)
    assert os.path.getsize(target) == size and os.listdir(tmp_path) == ["out.tif"]
    found = scan.scan_blocks(spark.createDataFrame([(target,)], "path string")).toPandas()
    assert np.array_equal(assembled(found[found["level"] == 0]), base) and np.array_equal(assembled(found[found["level"] == 1]), half)
    # Again, with fewer blocks and over the old file: what isn't given is a hole.
    placed.write_tiff(table.where("level = 0 AND NOT (br = 1 AND bc = 2)"), target, compress)
    with open(target, "rb") as file:
        asset = tiff.assets(file.read())[0]
    assert [i for i, n in enumerate(asset.private["sizes"]) if n == 0] == [1 * 7 + 2]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    from tileweave.sources import placed
    from tileweave.sources.formats import FormatError

    (tmp_path / "out.tif").write_bytes(b"old")
    image = np.zeros((1, 128, 128), np.uint8)
    broken = made_blocks(spark, image, (32, 32)).withColumn("payload", F.when((F.col("br") == 2) & (F.col("bc") == 1), F.lit(b"short")).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="reshape|size"):
        placed.write_tiff(broken, str(tmp_path / "out.tif"))
    assert os.listdir(tmp_path) == ["out.tif"] and (tmp_path / "out.tif").read_bytes() == b"old"
    for table in (made_blocks(spark, image, (20, 32)), made_blocks(spark, image, (32, 32)).unionByName(made_blocks(spark, image, (32, 32)))):
        with pytest.raises(FormatError):
            placed.write_tiff(table, str(tmp_path / "out.tif"))
    with pytest.raises(FormatError):
        placed.write_tiff(made_blocks(spark, image, (32, 32)), "s3a://bucket/out.tif")


def test_a_file_above_two_gigabytes(spark, tmp_path):
    """2.3 GB of tiles from eight partitions, made where they are written; places are checked at the ends and across 2^31."""
    from tileweave.sources import placed

    def tiles(batches):
        import pandas as pd

        for batch in batches:
            for i in batch["id"]:
                px = np.full((1, 1024, 1024), i, np.uint32)
                yield pd.DataFrame([("x.tif", "image:0", 0, int(i) // 24, int(i) % 24, 1, 1024, 1024, "uint32", px.tobytes())], columns=[c.split()[0] for c in scan.BLOCKS.split(", ")])

    table = spark.range(0, 552, 1, 8).mapInPandas(tiles, scan.BLOCKS)
    target = str(tmp_path / "large.tif")
    size = placed.write_tiff(table, target)
    assert size > 2_300_000_000 and os.path.getsize(target) == size
    with ranged.Ranged(target) as data:
        asset = tiff.assets(data)[0]
        assert asset.grid == (23, 24)
        for i in (0, 1, 23, 24, 510, 511, 512, 513, 551):
            assert (tiff.block(data, asset, i // 24, i % 24) == i).all()
    os.remove(target)


# --- codestreams, rules, levels of files --------------------------------------


def test_walked_tile_parts(spark):
    from tileweave.operators import chains
    from tileweave.sources.formats import coded

    part = lambda tile, n, body, told=None: b"\xff\x90\x00\x0a" + struct.pack(">HIBB", tile, 12 + len(body) if told is None else told, n, 1) + body
    head = b"\xff\x4f\xff\x51"
    good = head + part(0, 0, b"abc") + part(7, 1, b"") + part(65535, 2, b"x" * 300) + b"\xff\xd9"
    rows = [good, good[:-2], good[:-3], head + part(0, 0, b"abc") + b"\xff\x93" + b"z" * 20, head + part(3, 0, b"abcd", 0) + b"\xff\xd9", head + b"\xff\x90\x00\x0b" + b"\0" * 20, head + part(0, 0, b"abc", 5), head + b"\xff\x90\x00", head, b"", None]
    df = spark.createDataFrame([(i, bytearray(c) if c is not None else None) for i, c in enumerate(rows)], "id int, data binary")
    got = {r.id: None if r.r is None else [tuple(x) for x in r.r] for r in df.select("id", chains.walked_tile_parts(F.col("data"), F.lit(4)).alias("r")).collect()}
    three = [(4, 0, 0, 15, None), (19, 7, 1, 12, None), (31, 65535, 2, 312, None)]
    assert got[0] == got[1] == three and got[2] == three[:2] + [(31, None, None, None, "the tile part is longer than the codestream")]
    assert got[3] == three[:1] and got[4] == [(4, 3, 0, 18, None)] and got[5] == [(4, None, None, None, "no tile part header")]
    assert got[6] == [(4, None, None, None, "the tile part is longer than the codestream")] and got[7] == [(4, None, None, None, "the tile part is cut")] and not got[8] and not got[9] and not got[10]
    assert [(r.off, r.len) for r in spark.range(1).select(chains.running_places(F.array(F.lit(15), F.lit(12), F.lit(312)), F.lit(4)).alias("p")).first().p] == [(a, n) for a, _, _, n, _ in three]
    assert coded is not None


def test_rules_of_geo_tags_and_arrays(spark):
    from tileweave.functions import location
    from tileweave.operators import validate
    from tileweave.sources import georef

    given = ['{"34735": [1,1,1,1, 1024,0,1,2], "34736": [1.5, 2], "34737": "WGS|"}', '{"34735": "text"}', '{"34735": [1,1,1]}', '{"34735": [1,1,1,70000]}', '{"34735": [1,1,1,1.5]}', '{"34735": [1,1,1,-1]}', '{"34735": [1,1,1,0], "34736": ["x"]}', '{"34737": [1]}', "{}", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "id int, t string")
    got = {r.id: r.p for r in df.select("id", validate.geo_tag_rules(F.col("t")).alias("p")).collect()}
    assert got[0] == [] and got[1] == ["the key directory is no list"] and got[2] == ["keys come in fours"] and got[3] == got[4] == got[5] == ["a key isn't a number of 16 bits"]
    assert got[6] == ["a parameter isn't a number"] and got[7] == ["the text is none"] and got[8] == got[9] == []
    for code in (4326, 32601, 32760, 32761, 2000, 2001, 3857):
        assert spark.range(1).select(location.geo_directory(F.lit(f"EPSG:{code}")).alias("d")).first().d == georef.geo_keys(code)
    odd = spark.createDataFrame([([4, 5], "uint8", "jpeg"), ([4], "uint8", "png"), ([1, 0, 3], "int16", "dted"), ([2, 2], "float32", "png"), ([2, 2], "uint8", "none")], "s array<int>, d string, f string")
    assert [len(r.p) for r in odd.select(validate.array_rules(F.col("s"), F.col("d"), F.col("f")).alias("p")).collect()] == [0, 1, 1, 1, 1]


def test_levels_and_tiles_of_files(spark, tmp_path):
    from tileweave.sources.api import image_tiles, open_dataset, save_image
    from tileweave.sources.formats import FormatError

    px = RNG.integers(0, 60_000, (2, 100, 130)).astype(np.uint16)
    (tmp_path / "a.tif").write_bytes(tiff.encode([(px, {}), (px[:, ::2, ::2], {"overview": True}), (px[:, ::5, ::5], {"overview": True})], (32, 32)))
    found = {r.level: (r.scale, r.nests) for r in open_dataset(spark, str(tmp_path / "a.tif")).levels().collect()}
    assert found == {0: (1.0, True), 1: (2.0, True), 2: (5.0, False)}
    tiles = {(r, c): t for r, c, t in image_tiles(spark, str(tmp_path / "a.tif"), (48, 40), (8, 4))}
    assert list(tiles) == [(r, c) for r in range(3) for c in range(4)]
    assert all(np.array_equal(t, px[:, r * 40 : r * 40 + 48, c * 36 : c * 36 + 40]) for (r, c), t in tiles.items())
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.tif").write_bytes(tiff.encode([(px, {})], (32, 32)))
    roles = {r.path[-len("x/a.tif") :]: r.roles for r in open_dataset(spark, [str(tmp_path / "a.tif"), str(tmp_path / "x" / "a.tif")], roles=[["data"], ["thumbnail"]]).assets("image").where("key = 'image:0'").collect()}
    assert roles.pop("x/a.tif") == ["thumbnail"] and list(roles.values()) == [["data"]]
    with pytest.raises(FormatError):
        save_image(spark, str(tmp_path / "no.png"), np.zeros((4, 4), np.float32), "png")
