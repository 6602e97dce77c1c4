"""Queries over imagery-shaped views, each with its SQL.

``embeddings`` is a raster of 64 columns, ``lineitem`` a sparse grid of blocks
(order x line), ``documents`` hold text segments, ``events`` metadata, ``orders``
acquisition times and tagged records, ``customer`` elevations and angles, ``part``
images.  Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import datetimes, location, numeric, rates, text
from ..operators import blocks, metadata, raster, segments, validate, windows
from ..sources import memory, scan, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


PIXELS_SQL = "(SELECT vec_id AS row, CAST(unnest(range(64)) AS INT) AS col, unnest(embedding) AS v FROM embeddings)"


def raster_view(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return raster.pixels(read(spark, sf_dir, "embeddings"), "embedding", "vec_id", keep)


def thousandths(v: Column) -> Column:
    """Whole thousandths of a sample.  The product keeps the sample's type, as in SQL: with an integer factor Spark makes it a double, and ties fall otherwise."""
    return F.round(v * F.lit(1000).cast("float")).cast("bigint")


# --- windows, tiles, bands ---------------------------------------------------


@query(f"SELECT row, col, v FROM {PIXELS_SQL}")
def raster_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster_view(spark, sf_dir)


@query(f"SELECT row, col, v FROM {PIXELS_SQL} WHERE row BETWEEN 10 AND 41 AND col BETWEEN 4 AND 11")
def window_chip(spark: SparkSession, sf_dir: str) -> DataFrame:
    chip = raster.window_chip(read(spark, sf_dir, "embeddings"), "embedding", "vec_id", 10, 4, 32, 8)
    return raster.pixels(chip, "embedding", "vec_id").withColumn("col", F.col("col") + 4)


@query(f"SELECT CAST(row // 64 AS INT) AS br, CAST(col // 8 AS INT) AS bc, min(v) AS low, max(v) AS high, count(*) AS n FROM {PIXELS_SQL} GROUP BY 1, 2")
def block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.block_stats(raster_view(spark, sf_dir), 64, 8)


@query("""
WITH i AS (SELECT p_partkey, p_size * 40 AS rows, p_size * 25 + 7 AS cols FROM part),
g AS (SELECT *, unnest(range(greatest(1, CAST(ceil((rows - 16) / 240.0) AS INT)))) AS tr FROM i),
h AS (SELECT *, unnest(range(greatest(1, CAST(ceil((cols - 16) / 240.0) AS INT)))) AS tc FROM g)
SELECT p_partkey, CAST(tr AS INT) AS tr, CAST(tc AS INT) AS tc, CAST(tr * 240 AS INT) AS y, CAST(tc * 240 AS INT) AS x,
    CAST(least(256, rows - tr * 240) AS INT) AS h, CAST(least(256, cols - tc * 240) AS INT) AS w FROM h
""")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 40).alias("rows"), (F.col("p_size") * 25 + 7).alias("cols"))
    return raster.tile_grid(images, 256, 256, (16, 16)).select("p_partkey", "tr", "tc", "y", "x", "h", "w")


IMAGES_SQL = "(SELECT p_partkey AS image, p_size * 40 AS rows, p_size * 25 + 7 AS cols FROM part)"
WINDOWS_SQL = f"""(SELECT l_orderkey, l_linenumber, l_partkey AS image, l_orderkey * 31 % rows AS y, l_suppkey * 57 % cols AS x,
    CAST(l_quantity AS INT) * (1 + l_linenumber) AS h, CAST(l_quantity AS INT) * 9 % 400 AS w FROM lineitem JOIN {IMAGES_SQL} ON l_partkey = image)"""


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("image"), (F.col("p_size") * 40).alias("rows"), (F.col("p_size") * 25 + 7).alias("cols"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of an image for each line of an order; the images that many orders name have many."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("image"), "l_suppkey", F.col("l_quantity").cast("int").alias("n"))
    placed = lines.join(_images(spark, sf_dir), "image")
    y, x = F.col("l_orderkey") * 31 % F.col("rows"), F.col("l_suppkey") * 57 % F.col("cols")
    return placed.select("l_orderkey", "l_linenumber", "image", y.alias("y"), x.alias("x"), (F.col("n") * (1 + F.col("l_linenumber"))).alias("h"), (F.col("n") * 9 % 400).alias("w"))


@query(f"""
WITH g AS (SELECT *, unnest(range(greatest(1, CAST(ceil((rows - 16) / 80.0) AS INT)))) AS tr FROM {IMAGES_SQL}),
b AS (SELECT *, unnest(range(greatest(1, CAST(ceil((cols - 16) / 112.0) AS INT)))) AS tc FROM g),
t AS (SELECT image, tr, tc, tr * 80 AS ty, tc * 112 AS tx, least(96, rows - tr * 80) AS th, least(128, cols - tc * 112) AS tw FROM b),
m AS (SELECT l_orderkey, l_linenumber, greatest(y, ty) AS oy, least(y + h, ty + th) - greatest(y, ty) AS oh, greatest(x, tx) AS ox, least(x + w, tx + tw) - greatest(x, tx) AS ow, tr, tc
    FROM {WINDOWS_SQL} JOIN t USING (image))
SELECT l_orderkey, l_linenumber, CAST(tr AS INT) AS tr, CAST(tc AS INT) AS tc, oy, ox, oh, ow FROM m WHERE oh > 0 AND ow > 0
""")
def window_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = windows.window_tiles(_windows(spark, sf_dir), _images(spark, sf_dir), ["image"], (96, 128), (16, 16))
    return met.select("l_orderkey", "l_linenumber", "tr", "tc", *[F.col(c).cast("long").alias(c) for c in ("oy", "ox", "oh", "ow")])


@query(f"""
WITH i AS (SELECT *, 64 AS bh, 48 AS bw FROM {IMAGES_SQL}),
m AS (SELECT l_orderkey, l_linenumber, image, unnest(range(CAST(y // 64 AS INT), CAST((least(y + h, rows) - 1) // 64 + 1 AS INT))) AS br, x, w, y, h, rows, cols FROM {WINDOWS_SQL} JOIN i USING (image) WHERE h > 0 AND w > 0),
n AS (SELECT *, unnest(range(CAST(x // 48 AS INT), CAST((least(x + w, cols) - 1) // 48 + 1 AS INT))) AS bc FROM m)
SELECT image, CAST(br AS INT) AS br, CAST(bc AS INT) AS bc, count(*) AS windows,
    CAST(sum((least(y + h, br * 64 + 64, rows) - greatest(y, br * 64)) * (least(x + w, bc * 48 + 48, cols) - greatest(x, bc * 48))) AS BIGINT) AS pixels FROM n GROUP BY ALL
""")
def window_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many windows want each block of a regular grid, and how many of its pixels they show."""
    grids = _images(spark, sf_dir).withColumns({"bh": F.lit(64), "bw": F.lit(48)})
    met = windows.window_blocks(_windows(spark, sf_dir), grids, ["image"])
    return met.groupBy("image", "br", "bc").agg(F.count(F.lit(1)).alias("windows"), F.sum(F.col("oh") * F.col("ow")).cast("long").alias("pixels"))


@query(f"""
WITH w AS (SELECT c_custkey, c_custkey * 7 % 480 AS y, c_nationkey * 3 - 6 AS x, c_custkey % 40 AS h, c_nationkey + 1 AS w FROM customer),
p AS (SELECT row, col, CAST(round(v * 1000) AS BIGINT) AS v FROM {PIXELS_SQL})
SELECT c_custkey, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, count(DISTINCT row) AS lines FROM w JOIN p ON row >= y AND row < y + h AND col >= x AND col < x + w GROUP BY c_custkey
""")
def window_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of many windows of one image of lines, in one job."""
    wanted = read(spark, sf_dir, "customer").select("c_custkey", F.lit(0).alias("image"), (F.col("c_custkey") * 7 % 480).alias("y"), (F.col("c_nationkey") * 3 - 6).alias("x"), (F.col("c_custkey") % 40).alias("h"), (F.col("c_nationkey") + 1).alias("w"))
    lines = read(spark, sf_dir, "embeddings").select(F.lit(0).alias("image"), "vec_id", "embedding")
    met = windows.window_rows(wanted, lines, ["image"], "vec_id", "embedding", 16)
    total = F.aggregate(F.transform("samples", thousandths), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return met.groupBy("c_custkey").agg(F.sum(F.size("samples")).alias("n"), F.sum(total).alias("total"), F.count(F.lit(1)).alias("lines"))


@query(f"""
SELECT CAST(row // 50 AS INT) AS tr, CAST(col // 24 AS INT) AS tc, count(*) AS n, max(v) AS high, count(DISTINCT (row // 32, col // 16)) AS sources
FROM {PIXELS_SQL} GROUP BY 1, 2
""")
def retile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.retile(raster_view(spark, sf_dir), (32, 16), (50, 24))


@query("SELECT vec_id, CAST(unnest(range(3)) AS INT) AS place, unnest([3, 0, 3]) AS band, unnest([embedding[4], embedding[1], embedding[4]]) AS v FROM embeddings")
def band_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.bands_selected(read(spark, sf_dir, "embeddings"), "embedding", [3, 0, 3], ["vec_id"])


def _interleave(mode: str, name: str, place: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        px = raster_view(spark, sf_dir)
        to = raster.sequential_index(F.col("col"), mode, 4, 4, 4)
        back = raster.interleaved_index(to, mode, 4, 4, 4)
        return px.select("row", F.col("col").alias("place"), to.cast("int").alias("to_place"), back.cast("int").alias("back"), "v")

    f.__name__ = name
    query(f"SELECT row, col AS place, CAST({place} AS INT) AS to_place, col AS back, v FROM {PIXELS_SQL}")(f)


_interleave("P", "pixel_to_band_sequential", "(col % 4) * 16 + col // 4")
_interleave("R", "row_to_band_sequential", "((col % 16) // 4) * 16 + (col // 16) * 4 + col % 4")


@query("""
SELECT p_partkey, CAST(CASE WHEN p_size % 5 = 0 THEN 1 ELSE ceil(p_size * 100 / (p_size % 5 * 32.0)) END AS INT) AS grid,
    CAST(least(64, p_size * 100 - (p_size * 100 - 1) // 64 * 64) AS INT) AS last_rows FROM part
""")
def grid_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = read(spark, sf_dir, "part").withColumn("rows", F.col("p_size") * 100).withColumn("last", F.floor((F.col("rows") - 1) / 64).cast("int"))
    return images.select("p_partkey", raster.grid_size(F.col("rows"), F.col("p_size") % 5 * 32).alias("grid"), raster.edge_block(images, "rows", 64, "last").alias("last_rows"))


@query(f"""
SELECT CAST(row // 2 AS INT) AS row, CAST(col // 2 AS INT) AS col, round(avg(CAST(round(v * 1000) AS BIGINT)), 4) AS v FROM {PIXELS_SQL} GROUP BY 1, 2
""")
def overview_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = raster_view(spark, sf_dir).withColumn("v", thousandths(F.col("v")))
    return raster.halved(px).withColumn("v", F.round("v", 4))


@query(f"""
WITH p AS (SELECT row, col, CAST(round(v * 1000) AS BIGINT) AS v FROM {PIXELS_SQL}), q AS (SELECT row, col, v - v % 7 AS v FROM p)
SELECT count(*) AS n, round(avg((p.v - q.v) ** 2), 6) AS mse, round(-10 * log10(avg((p.v - q.v) ** 2)), 6) AS psnr FROM p JOIN q USING (row, col)
""")
def image_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = raster_view(spark, sf_dir).withColumn("v", thousandths(F.col("v")))
    rough = px.withColumn("v", F.col("v") - F.col("v") % 7)
    return raster.squared_error(px, rough, ["row", "col"]).withColumns({"mse": F.round("mse", 6), "psnr": F.round("psnr", 6)})


@query("""
WITH p AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS l FROM embeddings), q AS (SELECT label, l, round(l, 1) AS r FROM p)
SELECT label, round((2 * avg(l) * avg(r) + 0.0001) / (avg(l) ** 2 + avg(r) ** 2 + 0.0001) * (2 * covar_pop(l, r) + 0.0009) / (var_pop(l) + var_pop(r) + 0.0009), 6) AS ssim
FROM q GROUP BY label
""")
def image_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = raster_view(spark, sf_dir, "label").select("label", F.col("v").cast("double").alias("l")).withColumn("r", F.round("l", 1))
    return px.groupBy("label").agg(F.round(raster.similarity_index(F.col("l"), F.col("r")), 6).alias("ssim"))


@query(f"""
WITH p AS (SELECT row // 500 AS image, row, col, CAST(round(v * 1000) AS BIGINT) AS x FROM {PIXELS_SQL}), q AS (SELECT *, x - x % 40 AS y FROM p),
h AS (SELECT image, row, col, sum(1) OVER w AS n, sum(x) OVER w AS x, sum(y) OVER w AS y, sum(x * x) OVER w AS xx, sum(y * y) OVER w AS yy, sum(x * y) OVER w AS xy
    FROM q WINDOW w AS (PARTITION BY image, row ORDER BY col RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
v AS (SELECT image, row, col, sum(n) OVER w AS n, sum(x) OVER w / 49 AS x, sum(y) OVER w / 49 AS y, sum(xx) OVER w / 49 AS xx, sum(yy) OVER w / 49 AS yy, sum(xy) OVER w / 49 AS xy
    FROM h WINDOW w AS (PARTITION BY image, col ORDER BY row RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
s AS (SELECT image, (2 * x * y + 100) / (x * x + y * y + 100) * (2 * 49 / 48.0 * (xy - x * y) + 900) / (49 / 48.0 * (xx - x * x + yy - y * y) + 900) AS ssim FROM v WHERE n = 49)
SELECT image, count(*) AS windows, round(avg(ssim), 6) AS ssim, round(min(ssim), 6) AS least FROM s GROUP BY image
""")
def sliding_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean structural similarity of each image of 500 lines to itself with coarser samples, over every window of 7 x 7."""
    px = raster_view(spark, sf_dir).select(F.floor(F.col("row") / 500).alias("image"), "row", "col", thousandths(F.col("v")).alias("x"))
    found = raster.window_similarity(px.withColumn("y", F.col("x") - F.col("x") % 40), ["image"], "x", "y", 1000.0, 7, (64, 32))
    return found.groupBy("image").agg(F.count(F.lit(1)).alias("windows"), F.round(F.avg("ssim"), 6).alias("ssim"), F.round(F.min("ssim"), 6).alias("least"))


LEVELS_SQL = "(SELECT l_orderkey AS image, l_linenumber - 1 AS level, pow(2, l_linenumber - 1) + l_discount AS scale, 4096 // (1 << (l_linenumber - 1)) + l_suppkey % 2 AS size FROM lineitem)"


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") - 1
    size = F.call_function("div", F.lit(4096), F.call_function("shiftleft", F.lit(1), n)) + F.col("l_suppkey") % 2
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), n.alias("level"), (F.pow(F.lit(2.0), n.cast("double")) + F.col("l_discount")).alias("scale"), size.alias("size"))


@query(f"""
WITH r AS (SELECT o_orderkey AS image, 0.5 + o_orderkey % 97 AS wanted FROM orders), l AS (SELECT image, scale, max(level) AS level FROM {LEVELS_SQL} GROUP BY ALL),
m AS (SELECT r.image, r.wanted, l.level FROM r ASOF LEFT JOIN l ON r.image = l.image AND r.wanted >= l.scale),
f AS (SELECT image, arg_min(level, (scale, level)) AS finest FROM l GROUP BY image)
SELECT m.image, wanted, CAST(coalesce(level, finest) AS INT) AS level FROM m LEFT JOIN f ON m.image = f.image
""")
def level_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coarsest level of each image that is as fine as a request asks for."""
    requests = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), (F.lit(0.5) + F.col("o_orderkey") % 97).alias("wanted"))
    return blocks.level_choice(requests, _levels(spark, sf_dir), ["image"], "wanted", "scale", ["level"])


@query(f"""
WITH l AS (SELECT image, level, max(size) AS size FROM {LEVELS_SQL} GROUP BY ALL), p AS (SELECT *, lag(size) OVER w AS before, lag(level) OVER w AS last FROM l WINDOW w AS (PARTITION BY image ORDER BY level))
SELECT image, level, CASE WHEN last IS NULL THEN level = 0 ELSE last = level - 1 AND (size = before // 2 OR size = (before + 1) // 2) END AS nests FROM p
""")
def level_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = _levels(spark, sf_dir).groupBy("image", "level").agg(F.max("size").alias("size"))
    return blocks.level_checks(levels, ["image"], "level", "size", "size").select("image", "level", "nests")


# --- blocks, masks, indexes --------------------------------------------------

LINES_SQL = "(SELECT l_orderkey AS image, l_linenumber AS line, count(*) AS n FROM lineitem GROUP BY 1, 2)"
GRID_SQL = "(SELECT o_orderkey AS image, CAST(unnest(range(1, 8)) AS INT) AS line FROM orders)"


def _line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("line")).agg(F.count(F.lit(1)).alias("n"))


def _line_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("line"))


@query(f"SELECT g.image, g.line, coalesce(b.n, -1) AS n FROM {GRID_SQL} g LEFT JOIN {LINES_SQL} b USING (image, line)")
def mask_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.filled(_line_grid(spark, sf_dir), _line_blocks(spark, sf_dir), ["image", "line"], "n", -1)


@query(f"SELECT g.image, g.line FROM {GRID_SQL} g WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = g.image AND l_linenumber = g.line)")
def mask_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.missing(_line_grid(spark, sf_dir), _line_blocks(spark, sf_dir), ["image", "line"])


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 4294967295 ELSE CAST(l_extendedprice AS BIGINT) END <> 4294967295 AS present FROM lineitem")
def block_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    offset = F.when(F.col("l_quantity") > 40, F.lit(blocks.ABSENT)).otherwise(F.round("l_extendedprice").cast("bigint"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", blocks.present(offset).alias("present"))


@query("""
WITH s AS (SELECT l_orderkey AS image, l_linenumber AS line, max(CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY ALL),
l AS (SELECT l_orderkey AS image, l_suppkey % 9 AS line, max(-CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY ALL)
SELECT image, line, coalesce(l.v, s.v) AS v, l.v IS NOT NULL AS local FROM s FULL JOIN l USING (image, line)
""")
def local_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides hold a block for every line: the source by its number, the local one by its supplier."""
    lines = read(spark, sf_dir, "lineitem").withColumns({"image": F.col("l_orderkey"), "v": F.col("l_quantity").cast("bigint")})
    source = lines.groupBy("image", F.col("l_linenumber").alias("line")).agg(F.max("v").alias("v"))
    local = lines.groupBy("image", (F.col("l_suppkey") % 9).alias("line")).agg(F.max(-F.col("v")).alias("v"))
    return blocks.overridden(source, local, ["image", "line"], "v")


@query("""
SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(round(value, 4), event_id) AS value FROM events GROUP BY ALL
""")
def last_written_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("value", F.round("value", 4))
    return blocks.latest(events, ["user_id", "event_type"], "event_id", ["event_id", "value"])


@query("SELECT l_orderkey, count(DISTINCT l_linenumber) AS blocks, 4 AS expected, count(DISTINCT l_linenumber) = 4 AS complete FROM lineitem GROUP BY 1")
def provided_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.completeness(read(spark, sf_dir, "lineitem"), ["l_orderkey"], F.first(F.lit(4)), ["l_linenumber"])


TILE_PARTS_SQL = """(SELECT l_orderkey, l_linenumber, l_suppkey, CAST(l_quantity AS BIGINT) AS len, CAST(CASE WHEN l_orderkey % 4 = 0 THEN (l_linenumber - 1) * 50 + CAST(l_quantity AS BIGINT) % 2
    ELSE sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) - CAST(l_quantity AS BIGINT) END AS BIGINT) AS off FROM lineitem)"""


def _tile_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").cast("bigint").alias("len"))
    running = segments.segment_offsets(lines.withColumn("_order", F.struct("l_linenumber", "l_suppkey", "len")), ["l_orderkey"], "_order", "len", 0)
    off = F.when(F.col("l_orderkey") % 4 == 0, (F.col("l_linenumber") - 1) * 50 + F.col("len") % 2).otherwise(F.col("offset")).cast("bigint")
    return blocks.tile_parts(running.withColumn("off", off), ["l_orderkey"], "_order", "off", "len")


@query(f"""
WITH n AS (SELECT *, lead(off) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, len) AS nxt FROM {TILE_PARTS_SQL}),
g AS (SELECT l_orderkey, count(*) AS parts, sum(len) AS total, arg_min(off, (l_linenumber, l_suppkey, len)) AS first_off, bool_and(nxt IS NULL OR off + len = nxt) AS joined FROM n GROUP BY 1)
SELECT l_orderkey, CAST(parts AS INT) AS parts, joined, CAST(CASE WHEN joined THEN 1 ELSE parts END AS INT) AS n_ranges, first_off, CAST(total AS BIGINT) AS total FROM g
""")
def chunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _tile_ranges(spark, sf_dir)
    one = blocks.merged(F.col("ranges"))
    total = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda a, r: a + r["len"])
    return found.select("l_orderkey", F.size("ranges").alias("parts"), blocks.contiguous(F.col("ranges")).alias("joined"), F.size(one).alias("n_ranges"), one[0]["off"].alias("first_off"), total.alias("total"))


@query("""
WITH r AS (SELECT l_suppkey AS path, l_orderkey * 700 + l_linenumber * 90 AS off, CAST(l_quantity AS BIGINT) * 3 AS len FROM lineitem),
m AS (SELECT *, off // 65536 AS extent, max(off + len) OVER (PARTITION BY path, off // 65536 ORDER BY off, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM r),
i AS (SELECT *, sum(CASE WHEN off <= reached + 512 THEN 0 ELSE 1 END) OVER (PARTITION BY path, extent ORDER BY off, len) AS island FROM m)
SELECT path, min(off) AS start, max(off + len) AS stop, count(*) AS ranges FROM i GROUP BY path, extent, island
""")
def coalesced_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for the ranges of files: neighbours up to 512 bytes apart share one, within extents of 64 KiB."""
    ranges = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("path"), (F.col("l_orderkey") * 700 + F.col("l_linenumber") * 90).alias("off"), (F.col("l_quantity").cast("bigint") * 3).alias("len"))
    return blocks.coalesced(ranges, ["path"], gap=512, extent=1 << 16).groupBy("path", "start", "stop").agg(F.count(F.lit(1)).alias("ranges"))


@query("SELECT l_suppkey, CAST(max(l_linenumber) AS INT) AS rows, CAST(max(l_orderkey % 11) + 1 AS INT) AS cols, count(*) AS chunks FROM lineitem GROUP BY 1")
def manifest_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = read(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_linenumber") - 1).alias("br"), (F.col("l_orderkey") % 11).cast("int").alias("bc"))
    return blocks.manifest_shape(index, ["l_suppkey"])


@query("SELECT l_orderkey, l_linenumber, '0.' || (l_linenumber - 1) || '.' || (l_partkey % 7) AS key FROM lineitem")
def chunk_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", blocks.chunk_key(F.col("l_linenumber") - 1, F.col("l_partkey") % 7).alias("key"))


@query("""
WITH n AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS n FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, n, coalesce(lag(n) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) / n, 1.0) AS scale FROM n
""")
def level_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("n"))
    return blocks.level_scale(levels, ["l_orderkey"], "l_linenumber", "n")


@query("""
SELECT p_partkey, p_brand, CAST(row_number() OVER (PARTITION BY p_brand, p_partkey // 64 ORDER BY p_type, p_size < 25, p_size DESC, p_partkey) AS INT) AS place FROM part
""")
def overview_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = read(spark, sf_dir, "part").withColumns({"is_overview": F.col("p_size") < 25, "file": F.floor(F.col("p_partkey") / 64)})
    return blocks.overview_order(assets, "p_type", "is_overview", "p_size", "p_partkey", ["p_brand", "file"]).select("p_partkey", "p_brand", "place")


@query("SELECT p_brand, arg_max(p_partkey, (p_size, -p_partkey)) AS p_partkey, max(p_size) AS p_size FROM part GROUP BY 1")
def largest_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.largest_parent(read(spark, sf_dir, "part"), ["p_brand"], "p_size", "p_partkey")


# --- containers: written from the tables and read back -----------------------


#: Images of 64 x 64 samples, one for 64 rows of ``embeddings``; the last one may be lower.
STORED_SQL = "(SELECT 'image' || (vec_id // 64) AS path, vec_id // 64 AS n, CAST(vec_id % 64 AS INT) AS y, CAST(unnest(range(64)) AS INT) AS x, CAST(round(CAST(unnest(embedding) AS DOUBLE) * 1000) AS INT) AS v FROM embeddings)"


def stored_files(spark: SparkSession, sf_dir: str, fmt: str, dtype: str, value: str = "v", **options) -> DataFrame:
    """path and content of a file of each image."""
    samples = F.transform(F.col("embedding"), lambda e: F.round(e.cast("double") * 1000).cast("int"))
    if value == "byte":
        samples = F.transform(samples, lambda v: F.abs(v) % 256)
    rows = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("image"), F.floor(F.col("vec_id") / 64).cast("string")).alias("path"), (F.col("vec_id") % 64).cast("int").alias("y"), samples.alias("samples"))
    return sinks.encoded(memory.strips(rows, "path", "y", "samples", dtype, 16), fmt, **options)


def _stored(name: str, fmt: str, dtype: str, value: str = "v", block: tuple[int, int] = (64, 64), where: str = "", **options) -> None:
    """A query of all samples of all images after a round through a container."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        px = scan.block_pixels(scan.scan_blocks(stored_files(spark, sf_dir, fmt, dtype, value, **options)))
        return px.select("path", (F.col("br") * block[0] + F.col("y")).alias("y"), (F.col("bc") * block[1] + F.col("x")).alias("x"), F.col("v").cast("int").alias("v"))

    f.__name__ = name
    shown = "v" if value == "v" else "abs(v) % 256"
    query(f"SELECT path, y, x, CAST({shown} AS INT) AS v FROM {STORED_SQL} {where}")(f)


_stored("nitf_pixels", "nitf", "int16", block=(16, 32), block_size=(16, 32))
_stored("nitf_row_interleaved_pixels", "nitf", "int32", block=(64, 64), mode="R")
_stored("nitf_packed_pixels", "nitf", "int16", image_metadata={"NBPP": 13}, block=(32, 32), block_size=(32, 32))
_stored("nsif_byte_pixels", "nsif", "uint8", "byte", mode="P")
_stored("nitf_masked_pixels", "nitf", "int16", block=(16, 16), where="WHERE (y // 16 + x // 16) % 2 = 1", block_size=(16, 16), present=lambda image, r, c: (r + c) % 2 == 1)
_stored("tiff_pixels", "tiff", "int16", block=(32, 16), tile=(32, 16), compression=8, predictor=2)
_stored("tiff_lzw_pixels", "tiff", "int32", block=(64, 64), tile=(64, 64), compression=5)
_stored("tiff_packbits_pixels", "tiff", "uint8", "byte", block=(16, 16), tile=(16, 16), compression=32773)
_stored("png_pixels", "png", "uint8", "byte")
_stored("dted_elevations", "dted", "int16")

_SIZES_SQL = "(SELECT vec_id // 64 AS n, 'image' || (vec_id // 64) AS path, CAST(count(*) AS INT) AS rows FROM embeddings GROUP BY 1, 2)"


@query(f"""
SELECT path, format, 'image:0' AS key, rows, 64 AS cols, 1 AS bands, dtype, bits FROM {_SIZES_SQL},
    (VALUES ('nitf', 'int16', 16), ('tiff', 'int16', 16), ('png', 'uint8', 8), ('dted', 'int16', 16)) f(format, dtype, bits)
""")
def container_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [stored_files(spark, sf_dir, "nitf", "int16"), stored_files(spark, sf_dir, "tiff", "int16"), stored_files(spark, sf_dir, "png", "uint8", "byte"), stored_files(spark, sf_dir, "dted", "int16")]
    found = made[0]
    for other in made[1:]:
        found = found.unionByName(other)
    return scan.scan_assets(found).select("path", "format", "key", "rows", "cols", "bands", "dtype", "bits")


@query(f"""
WITH i AS (SELECT *, CAST(ceil(rows / 16.0) AS INT) AS grid FROM {_SIZES_SQL}), b AS (SELECT *, CAST(unnest(range(grid)) AS INT) AS br FROM i), c AS (SELECT *, CAST(unnest(range(2)) AS INT) AS bc FROM b)
SELECT path, br, bc, CAST(404 + 439 + (br * 2 + bc) * 1024 AS BIGINT) AS off, CAST(1024 AS BIGINT) AS len FROM c
""")
def nitf_tile_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image: a file header of 404 bytes, a subheader of 439, then blocks of 16 x 32 samples of two bytes."""
    index = scan.tile_index(stored_files(spark, sf_dir, "nitf", "int16", block_size=(16, 32)))
    return index.select("path", "br", "bc", F.explode("ranges").alias("r")).select("path", "br", "bc", "r.off", "r.len")


@query(f"""
SELECT path, y, x, v FROM {STORED_SQL} WHERE y < 16 AND x BETWEEN 32 AND 63
""")
def tiff_window_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of every image: only the tiles that it meets are decoded."""
    made = stored_files(spark, sf_dir, "tiff", "int16", tile=(16, 32))
    px = scan.block_pixels(scan.scan_blocks(made, rows=(0, 15), cols=(32, 63)))
    return px.select("path", (F.col("br") * 16 + F.col("y")).alias("y"), (F.col("bc") * 32 + F.col("x")).alias("x"), F.col("v").cast("int").alias("v"))


@query(f"""
SELECT path, '0.' || br || '.0' AS chunk, CAST(404 + 439 + br * 2048 AS BIGINT) AS off, CAST(2048 AS BIGINT) AS len FROM (SELECT path, unnest(range(CAST(ceil(rows / 16.0) AS INT))) AS br FROM {_SIZES_SQL})
""")
def chunk_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of single ranges: a file header of 404 bytes, a subheader of 439, then blocks of 16 x 64 samples of two bytes."""
    index = scan.tile_index(stored_files(spark, sf_dir, "nitf", "int16", block_size=(16, 64)))
    step = lambda i: F.get_json_object("reference", f"$[{i}]")
    return sinks.references(index).select(step(0).alias("path"), "chunk", step(1).cast("bigint").alias("off"), step(2).cast("bigint").alias("len"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_orderkey * 1000 + l_linenumber * 100 AS off, CAST(l_quantity AS BIGINT) AS len, l_linenumber % 2 = 0 AS gap FROM lineitem),
t AS (SELECT l_orderkey, list({'off': off, 'len': CASE WHEN gap THEN len ELSE 100 END} ORDER BY off, len, gap) AS r, count(*) AS n FROM r GROUP BY 1),
c AS (SELECT *, coalesce(len(list_filter(range(1, n), lambda i: r[i].off + r[i].len <> r[i + 1].off)) = 0, true) AS one FROM t)
SELECT l_orderkey, CASE WHEN one THEN '["part/' || l_orderkey || '\\"x", ' || r[1].off || ', ' || CAST(list_sum(list_transform(r, lambda x: x.len)) AS BIGINT) || ']'
    ELSE '["part/' || l_orderkey || '\\"x", [' || array_to_string(list_transform(r, lambda x: '[' || x.off || ', ' || x.len || ']'), ', ') || ']]' END AS reference FROM c
""")
def range_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of one or several ranges as JSON; a quotation mark in a path is escaped."""
    gap = F.col("l_linenumber") % 2 == 0
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100).alias("off"), F.when(gap, F.col("l_quantity").cast("bigint")).otherwise(F.lit(100).cast("bigint")).alias("len"))
    index = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("off", "len"))).alias("ranges"))
    keyed = index.select(F.col("l_orderkey").cast("string").alias("key"), F.lit(0).alias("level"), F.lit(0).alias("br"), F.lit(0).alias("bc"), F.concat(F.lit("part/"), "l_orderkey", F.lit('"x')).alias("path"), "ranges")
    return sinks.references(keyed).select(F.col("key").cast("bigint").alias("l_orderkey"), "reference")


# --- segments, records, keys -------------------------------------------------


@query("""
SELECT doc_id, source, CAST(404 + coalesce(sum(n_chars) OVER (PARTITION BY source, doc_id // 50 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM documents
""")
def segment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file holds the segments of one source among fifty documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.floor(F.col("doc_id") / 50).alias("file"))
    return segments.segment_offsets(docs, ["source", "file"], "doc_id", "n_chars", 404).drop("n_chars", "file")


@query("""
WITH s AS (SELECT source, doc_id, doc_id // 50 AS file, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY source, doc_id // 50) THEN 9999999 ELSE n_chars END AS len FROM documents)
SELECT doc_id, CAST(CASE WHEN len = 9999999 THEN 5000000 - sum(CASE WHEN len = 9999999 THEN 0 ELSE len END) OVER (PARTITION BY source, file) ELSE len END AS BIGINT) AS len FROM s
""")
def unknown_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.floor(F.col("doc_id") / 50).alias("file"))
    known = docs.groupBy("source", "file").agg(F.min("doc_id").alias("first"), F.sum("n_chars").alias("total"), F.min_by("n_chars", "doc_id").alias("own"))
    joined = docs.join(known, ["source", "file"])
    length = F.when(F.col("doc_id") == F.col("first"), F.lit(9999999)).otherwise(F.col("n_chars"))
    return joined.select("doc_id", segments.resolved_length(length, 7, F.lit(5000000) - (F.col("total") - F.col("own"))).cast("bigint").alias("len"))


@query("""
WITH f AS (SELECT l_orderkey, count(*) AS found FROM lineitem GROUP BY 1)
SELECT o.o_orderkey, 4 AS declared, coalesce(found, 0) AS found FROM orders o LEFT JOIN f ON l_orderkey = o_orderkey WHERE coalesce(found, 0) <> 4
""")
def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = read(spark, sf_dir, "orders").select("o_orderkey", F.lit(4).alias("declared"))
    found = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return segments.declared_against_found(declared, found, "o_orderkey", "declared")


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS len, CAST(404 + coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM lineitem),
e AS (SELECT l_orderkey, max(off + len) AS expected FROM s GROUP BY 1),
d AS (SELECT l_orderkey, expected, CASE l_orderkey % 4 WHEN 0 THEN 999999999999 WHEN 1 THEN expected + 1 ELSE expected END AS declared, expected + CASE l_orderkey % 4 WHEN 2 THEN 7 ELSE 0 END AS actual FROM e)
SELECT l_orderkey, expected, CASE l_orderkey % 4 WHEN 0 THEN 'length not recorded' WHEN 1 THEN 'declared ' || declared || ', segments end at ' || expected || ';declared ' || declared || ', found ' || actual
    WHEN 2 THEN 'declared ' || declared || ', found ' || actual ELSE '' END AS warnings FROM d
""")
def file_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").withColumns({"len": F.col("l_quantity").cast("bigint"), "order": F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), "hl": F.lit(404)})
    placed = segments.segment_offsets(lines, ["l_orderkey"], "order", "len", 404)
    ends = segments.end_offset(placed, ["l_orderkey"], "offset", "len", "hl").withColumn("expected", F.col("expected").cast("bigint"))
    kind, expected = F.col("l_orderkey") % 4, F.col("expected")
    declared = F.when(kind == 0, F.lit(999_999_999_999)).when(kind == 1, expected + 1).otherwise(expected)
    warnings = segments.length_warnings(declared, expected, expected + F.when(kind == 2, 7).otherwise(0))
    return ends.select("l_orderkey", "expected", F.array_join(warnings, ";").alias("warnings"))


@query("""
WITH d AS (SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INT) AS i, n_name FROM nation),
h AS (SELECT c_custkey, n_regionkey, CAST(c_custkey % 4 AS INT) AS idx FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, idx, n_name AS overflow FROM h LEFT JOIN d ON h.n_regionkey = d.n_regionkey AND d.i = h.idx
""")
def overflow_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    numbered = nation.withColumn("number", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1)
    headers = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey", (F.col("c_custkey") % 4).cast("int").alias("idx"))
    return segments.followed_overflow(headers, numbered, ["n_regionkey"], "idx", "number", "n_name").select("c_custkey", "idx", "overflow")


@query("""
WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part)
SELECT p_brand, CAST(coalesce(min(CASE WHEN i = 2 THEN i END), 0) AS INT) AS data, CAST(count(*) FILTER (i <> 2) AS INT) AS levels, CAST(min(CASE WHEN i <> 2 THEN i END) AS INT) AS finest FROM r GROUP BY 1
""")
def routed_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    sources = read(spark, sf_dir, "part").withColumn("i", i)
    sources = sources.withColumn("roles", F.when(F.col("i") == 2, F.array(F.lit("data"))).otherwise(F.array(F.concat(F.lit("overview:"), (F.col("i") + 1).cast("string")))))
    found = segments.routed_sources(sources, ["p_brand"], "i", "roles")
    return found.select("p_brand", "data", F.size("overviews").alias("levels"), F.get("overviews", F.lit(0))["index"].alias("finest"))


@query("""
WITH g AS (SELECT p_partkey, p_size AS gr, CAST(p_size % 13 + 1 AS INT) AS gc FROM part), p AS (SELECT *, unnest([1, 3, 10]) AS n FROM g),
q AS (SELECT *, greatest(0, least(gr // 2 - n // 2, gr - n)) AS br0, greatest(0, least(gc // 2 - n // 2, gc - n)) AS bc0 FROM p WHERE n < 10 OR least(gr, gc) >= 10)
SELECT p_partkey, CASE n WHEN 1 THEN 'single' WHEN 3 THEN 'small' ELSE 'large' END AS pattern, CAST(br0 AS INT) AS br0, CAST(least(br0 + n, gr) - 1 AS INT) AS br1, CAST(bc0 AS INT) AS bc0, CAST(least(bc0 + n, gc) - 1 AS INT) AS bc1 FROM q
""")
def access_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("int").alias("gr"), (F.col("p_size") % 13 + 1).cast("int").alias("gc"))
    return segments.access_patterns(grids, "gr", "gc").drop("gr", "gc")


@query("SELECT event_id, lower(event_type) || ':' || (event_id % 5) AS key, lower(event_type) AS kind, CAST(event_id % 5 AS INT) AS index FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, event_type || ':' || (event_id % 5), NULL, NULL FROM events WHERE event_type <> 'view'")
def asset_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("kind", F.when(F.col("event_type") == "view", "image").otherwise(F.col("event_type")))
    keyed = events.withColumn("key", segments.asset_key(F.col("kind"), F.col("event_id") % 5))
    parts = segments.asset_key_parts(F.col("key"))
    shown = F.when(F.col("kind") == "image", F.concat(F.lit("view:"), (F.col("event_id") % 5).cast("string"))).otherwise(F.col("key"))
    return keyed.select("event_id", shown.alias("key"), F.when(parts["kind"] == "image", F.lit("view")).alias("kind"), parts["index"].alias("index"))


PATHS_SQL = "(SELECT p_partkey, p_brand || CASE p_size % 4 WHEN 0 THEN '.NTF' WHEN 1 THEN '.tif.r' || (p_size % 3) WHEN 2 THEN '.dt2' ELSE '' END AS path FROM part)"


@query(f"""
SELECT p_partkey, CASE WHEN regexp_matches(path, '\\.NTF$') THEN 'nitf' WHEN regexp_matches(path, '\\.tif') THEN 'tiff' WHEN regexp_matches(path, '\\.dt2$') THEN 'dted' END AS format,
    nullif(TRY_CAST(regexp_extract(path, '\\.r(\\d+)$', 1) AS INT), 0) AS level, regexp_replace(path, '\\.r\\d+$', '') AS stem FROM {PATHS_SQL}
""")
def format_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    suffix = F.when(n % 4 == 0, ".NTF").when(n % 4 == 1, F.concat(F.lit(".tif.r"), (n % 3).cast("string"))).when(n % 4 == 2, ".dt2").otherwise("")
    path = F.concat("p_brand", suffix)
    return read(spark, sf_dir, "part").select("p_partkey", segments.format_of(path).alias("format"), segments.rset_level(path).alias("level"), segments.without_rset(path).alias("stem"))


RECORDS_SQL = "(SELECT o_orderkey, rpad(upper(substr(o_orderpriority, 3, 4)), 6, ' ') AS tag, o_orderstatus || o_orderkey AS data FROM orders)"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.upper(F.substring("o_orderpriority", 3, 4))
    return read(spark, sf_dir, "orders").select("o_orderkey", segments.record(tag, F.concat("o_orderstatus", F.col("o_orderkey").cast("string"))).alias("record"))


@query(f"SELECT o_orderkey, tag || lpad(CAST(length(data) AS VARCHAR), 5, '0') || data AS record FROM {RECORDS_SQL}")
def record_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir)


@query(f"SELECT o_orderkey, CASE WHEN regexp_matches(tag, '^[A-Za-z0-9 ]*$') THEN rtrim(tag) END AS tag, CASE WHEN regexp_matches(tag, '^[A-Za-z0-9 ]*$') THEN CAST(length(data) AS INT) END AS length, CASE WHEN regexp_matches(tag, '^[A-Za-z0-9 ]*$') THEN data END AS data FROM {RECORDS_SQL}")
def record_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("o_orderkey", segments.record_parts(F.col("record")).alias("r")).select("o_orderkey", "r.*")


@query("""
WITH RECURSIVE a AS (SELECT l_orderkey AS k, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_suppkey, l_quantity) AS s FROM lineitem GROUP BY 1),
f AS (SELECT k, s, 0 AS i, CAST(0 AS BIGINT) AS used, 0 AS fits, 0 AS over FROM a
    UNION ALL SELECT k, s, i + 1, CASE WHEN used + s[i + 1] <= 100 THEN used + s[i + 1] ELSE used END, fits + (used + s[i + 1] <= 100)::INT, over + (used + s[i + 1] > 100)::INT FROM f WHERE i < len(s))
SELECT k AS l_orderkey, used, fits, over FROM f WHERE i = len(s)
""")
def overflow_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", F.col("l_quantity").cast("bigint").alias("q")))), lambda s: s["q"])
    folded = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(sizes.alias("sizes"))
    return folded.select("l_orderkey", segments.overflow_split(F.col("sizes"), 100).alias("s")).select("l_orderkey", "s.*")


@query("SELECT o_custkey, o_orderpriority, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY ALL")
def last_of_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.last_of_tag(read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey", ["o_orderkey", "o_orderstatus"])


@query("""
SELECT event_id, event_type FROM events WHERE list_has_any([event_type, CASE WHEN value > 50 THEN 'data' ELSE 'overview:' || (event_id % 4) END], ['data', 'view'])
""")
def role_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.array("event_type", F.when(F.col("value") > 50, "data").otherwise(F.concat(F.lit("overview:"), (F.col("event_id") % 4).cast("string"))))
    return segments.with_role(read(spark, sf_dir, "events").withColumn("roles", roles), "roles", ["data", "view"]).select("event_id", "event_type")


@query("""
WITH r AS (SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY NOT (value > 50), event_id) AS n FROM events)
SELECT user_id, event_id FROM r WHERE n = 1
""")
def default_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = read(spark, sf_dir, "events").withColumn("roles", F.when(F.col("value") > 50, F.array(F.lit("data"))).otherwise(F.array(F.lit("overview:1"))))
    return segments.default_asset(assets, ["user_id"], "roles", "event_id").select("user_id", "event_id")


@query("SELECT o_orderkey, o_orderpriority AS tag, n_name AS definition, coalesce(n_name, '_raw:' || hex(o_orderstatus)) AS shown FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 40")
def definition_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").withColumn("n_nationkey", (F.col("o_custkey") % 40).cast("int"))
    definitions = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("definition"))
    found = segments.with_definition(orders, definitions, "n_nationkey", "o_orderstatus")
    return found.select("o_orderkey", F.col("o_orderpriority").alias("tag"), "definition", "shown")


@query("SELECT p_brand AS name FROM part UNION SELECT c_mktsegment FROM customer UNION SELECT r_name FROM region")
def registry_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.all_names(read(spark, sf_dir, "part").select("p_brand"), read(spark, sf_dir, "customer").select("c_mktsegment"), read(spark, sf_dir, "region").select("r_name"))


@query("SELECT DISTINCT p_size AS tag FROM part EXCEPT SELECT l_linenumber FROM lineitem")
def custom_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = read(spark, sf_dir, "part").select(F.col("p_size").alias("tag"))
    return metadata.without_structural(tags, read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("tag")))


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.repeated_keys(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@query("SELECT source AS kind, count(*) AS n, max(n_chars) AS longest, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY ROLLUP (source)")
def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment_totals(read(spark, sf_dir, "documents").withColumnRenamed("source", "kind"), "kind", "n_chars")


@query("""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages), p AS (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS s, url FROM u),
q AS (SELECT page_id, CASE s WHEN '' THEN 'file' ELSE lower(s) END AS scheme, CASE s WHEN '' THEN url ELSE substr(url, length(s) + 4) END AS path FROM p)
SELECT page_id, scheme, path, nullif(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '\\.([^.]*)$', 1), '') AS extension FROM q
""")
def uri_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", segments.uri_parts(F.coalesce("url", F.lit(""))).alias("u")).select("page_id", "u.*")


@query("""
WITH c AS (SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN 'image' ELSE 'text' END AS kind, count(*) AS n FROM lineitem GROUP BY ALL),
w AS (SELECT o_orderkey AS l_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'text' ELSE 'sound' END AS kind, o_custkey % 4 AS i FROM orders)
SELECT w.l_orderkey, w.kind || ':' || i AS key, coalesce(i < n, false) AS exists FROM w LEFT JOIN c ON w.l_orderkey = c.l_orderkey AND w.kind = c.kind
""")
def asset_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_linenumber") % 2 == 0, "image").otherwise("text")
    counts = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    asked = F.when(F.col("o_orderkey") % 3 == 0, "image").when(F.col("o_orderkey") % 3 == 1, "text").otherwise("sound")
    wanted = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat_ws(":", asked, (F.col("o_custkey") % 4).cast("string")).alias("key"))
    return segments.with_existence(wanted, counts, ["l_orderkey"])


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice AS back8, CAST(CAST(-l_extendedprice AS FLOAT) AS DOUBLE) AS back4, CAST(floor(log2(l_extendedprice)) AS BIGINT) + 1023 AS exponent,
    floor((l_extendedprice / pow(2, floor(log2(l_extendedprice))) - 1) * 1048576) AS fraction, l_discount AS re FROM lineitem
""")
def float_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written as IEEE bytes and read back, and the fields of their bits."""
    v = F.col("l_extendedprice")
    made = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", numeric.write_float(v, 8).alias("wide"), numeric.write_float(-v, 4, True).alias("short"), numeric.complex_bytes(F.col("l_discount"), -F.col("l_tax")).alias("pair"), F.col("l_discount").cast("float").alias("d"), "l_discount"
    )
    head = numeric.read_unsigned(F.col("wide"), 0, 4)
    same = numeric.read_float(F.col("pair"), 0, 4) == F.col("d").cast("double")
    return made.select(
        "l_orderkey", "l_linenumber", numeric.read_float(F.col("wide"), 0, 8).alias("back8"), numeric.read_float(F.col("short"), 0, 4, True).alias("back4"), F.shiftright(head, 20).alias("exponent"),
        head.bitwiseAND(F.lit((1 << 20) - 1)).cast("double").alias("fraction"), F.when(same, F.col("l_discount")).alias("re"),
    )


@query("""
WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'EPSG:4326' WHEN 1 THEN 'epsg:' || (32580 + c_custkey % 200) WHEN 2 THEN 'EPSG:' || (c_custkey % 4000) ELSE 'WGS ' || c_custkey END AS crs FROM customer),
d AS (SELECT *, coalesce(TRY_CAST(regexp_extract(upper(crs), '^EPSG:([^:]*)', 1) AS INT), 4326) AS code FROM c), p AS (SELECT *, code BETWEEN 32601 AND 32760 OR (code > 2000 AND code <> 4326) AS projected FROM d)
SELECT c_custkey, '1,1,1,3,1024,0,1,' || CASE WHEN projected THEN 1 ELSE 2 END || ',1025,0,1,1,' || CASE WHEN projected THEN 3072 ELSE 2048 END || ',0,1,' || code AS directory FROM p
""")
def geo_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    crs = F.when(key % 4 == 0, "EPSG:4326").when(key % 4 == 1, F.concat(F.lit("epsg:"), (key % 200 + 32580).cast("string"))).when(key % 4 == 2, F.concat(F.lit("EPSG:"), (key % 4000).cast("string"))).otherwise(F.concat(F.lit("WGS "), key.cast("string")))
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(location.geo_directory(crs).cast("array<string>"), ",").alias("directory"))


@query("""
WITH s AS (SELECT p_partkey, p_size % 5 AS rank, p_size % 11 AS side, CASE p_partkey % 4 WHEN 0 THEN 'uint8' WHEN 1 THEN 'uint16' WHEN 2 THEN 'float32' ELSE 'bool' END AS dtype, CASE p_size % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'nitf' ELSE 'jpeg' END AS fmt FROM part)
SELECT p_partkey, concat_ws(';', CASE WHEN rank NOT BETWEEN 2 AND 3 THEN 'two or three dimensions are needed' END, CASE WHEN rank > 0 AND side = 0 THEN 'a dimension isn''t positive' END,
    CASE WHEN NOT (dtype = 'uint8' OR (dtype = 'uint16' AND fmt <> 'jpeg') OR (dtype = 'float32' AND fmt = 'nitf')) THEN 'the format has no such samples' END) AS problems FROM s
""")
def array_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    dtype = F.when(key % 4 == 0, "uint8").when(key % 4 == 1, "uint16").when(key % 4 == 2, "float32").otherwise("bool")
    fmt = F.when(size % 3 == 0, "png").when(size % 3 == 1, "nitf").otherwise("jpeg")
    shape = F.array_repeat(size % 11, (size % 5).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(validate.array_rules(shape, dtype, fmt), ";").alias("problems"))


# --- metadata ----------------------------------------------------------------

PROPS = "map<string,string>"


@query("SELECT event_id, unnest(json_keys(props)) AS key FROM events")
def metadata_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.key_rows(read(spark, sf_dir, "events"), "props", ["event_id"])


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(len(list_filter(json_keys(props), lambda x: starts_with(x, 'k'))) AS INT) AS with_k, CAST(len(list_filter(json_keys(props), lambda x: starts_with(x, 'z'))) AS INT) AS with_z FROM events")
def metadata_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.from_json("props", PROPS)
    return read(spark, sf_dir, "events").select("event_id", F.try_element_at(entries, F.lit("k")).alias("k"), F.size(metadata.with_prefix(entries, "k")).alias("with_k"), F.size(metadata.with_prefix(entries, "z")).alias("with_z"))


@query("""
WITH k AS (SELECT event_id, event_type, list_distinct(list_concat(json_keys(props), ['k', 'type'])) AS keys FROM events)
SELECT event_id, event_type AS k, CAST(len(keys) AS INT) AS entries, CAST(len(list_filter(keys, lambda x: x <> 'k')) AS INT) AS left_over FROM k
""")
def metadata_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = metadata.updated(F.from_json("props", PROPS), F.create_map(F.lit("k"), F.col("event_type"), F.lit("type"), F.lit("x")))
    return read(spark, sf_dir, "events").select("event_id", entries["k"].alias("k"), F.size(entries).alias("entries"), F.size(metadata.removed(entries, "k")).alias("left_over"))


@query("SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN c_mktsegment ELSE 'U' END AS clas, '' AS code FROM customer")
def security_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.when(F.col("c_nationkey") % 3 == 0, F.create_map(F.lit("ISCLAS"), F.col("c_mktsegment"))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    group = metadata.security(entries, "IS")
    back = metadata.security_map(group, "IS")
    return read(spark, sf_dir, "customer").select("c_custkey", back["ISCLAS"].alias("clas"), group["CODE"].alias("code"))


@query("SELECT page_id, replace('{{base}}/' || page_id, '{{base}}', url) AS expanded FROM pages")
def url_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", metadata.expanded(F.concat(F.lit("{{base}}/"), F.col("page_id").cast("string")), F.col("url")).alias("expanded"))


# --- column functions --------------------------------------------------------


def _columns(name: str, table: str, key: str, columns: dict[str, tuple[Callable[[], Column], str]]) -> None:
    """A query of columns beside a key, and its SQL."""
    keys = key.split(", ")

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, sf_dir, table).select(*keys, *[c().alias(n) for n, (c, _) in columns.items()])

    f.__name__ = name
    query(f"SELECT {key}, " + ", ".join(f"{sql} AS {n}" for n, (_, sql) in columns.items()) + f" FROM {table}")(f)


def _functions() -> None:
    """Queries of single functions; a Column needs an active session, so it is made when the query runs."""
    c, lit = F.col, F.lit
    cents = lambda: F.round(c("l_extendedprice") * 100).cast("bigint")
    cents_sql = "CAST(round(l_extendedprice * 100) AS BIGINT)"
    _columns("charsets", "documents", "doc_id", {
        "bcs_a": (lambda: text.valid(c("text"), "bcs-a"), r"regexp_full_match(text, '[\x20-\x7E]*')"),
        "bcs_n": (lambda: text.valid(c("source"), "bcs-n"), r"regexp_full_match(source, '[0-9 +./-]*')"),
        "bcs_npi": (lambda: text.valid(F.translate("source", "src", "012"), "bcs-npi"), r"regexp_full_match(translate(source, 'src', '012'), '[0-9 ]*')"),
        "ecs_a": (lambda: text.valid(c("text"), "ecs-a"), r"NOT regexp_matches(text, '[\x00-\x1F]')"),
        "bad_at": (lambda: text.first_bad(c("text"), "bcs-a")["index"], r"CASE WHEN NOT regexp_full_match(text, '[\x20-\x7E]*') THEN CAST(length(regexp_extract(text, '^[\x20-\x7E]*')) AS INT) END"),
    })
    _columns("line_ends", "documents", "doc_id", {
        "crlf": (lambda: F.length(text.to_crlf(c("text"))), "CAST(length(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), chr(13) || chr(10))) AS INT)"),
        "lf": (lambda: F.md5(text.to_lf(text.to_crlf(c("text")))), "md5(replace(text, chr(13) || chr(10), chr(10)))"),
    })
    _columns("field_formats", "lineitem", "l_orderkey, l_linenumber", {
        "number": (lambda: text.number_field(c("l_partkey"), 8), "lpad(CAST(l_partkey AS VARCHAR), 8, '0')"),
        "word": (lambda: text.text_field(c("l_returnflag"), 5), "rpad(l_returnflag, 5, ' ')"),
        "fits": (lambda: text.fits(c("l_suppkey"), 2), "CASE WHEN length(CAST(l_suppkey AS VARCHAR)) <= 2 THEN CAST(l_suppkey AS VARCHAR) END"),
        "back": (lambda: numeric.as_int(text.number_field(c("l_partkey"), 8)), "l_partkey"),
    })
    _columns("blank_numbers", "events", "event_id", {
        "number": (lambda: numeric.as_int(F.when(c("event_id") % 3 == 0, "   ").when(c("event_id") % 3 == 1, F.concat(lit(" "), c("event_id").cast("string"))).otherwise(c("event_type"))), "CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN event_id END"),
        "real": (lambda: numeric.as_float(F.when(c("event_id") % 2 == 0, "").otherwise("2.5")), "CAST(CASE event_id % 2 WHEN 0 THEN 0 ELSE 2.5 END AS DOUBLE)"),
        "positive": (lambda: numeric.as_unsigned(F.when(c("event_id") % 2 == 0, "-4").otherwise("4")), "CASE event_id % 2 WHEN 1 THEN CAST(4 AS BIGINT) END"),
    })
    _columns("dates", "orders", "o_orderkey", {
        "fdt": (lambda: datetimes.fdt(c("o_orderdate")), "strftime(o_orderdate, '%Y%m%d%H%M%S')"),
        "back": (lambda: datetimes.fdt_timestamp(datetimes.fdt(c("o_orderdate"))), "date_trunc('second', o_orderdate)"),
        "month": (lambda: datetimes.fdt_parts(F.concat(F.substring(datetimes.fdt(c("o_orderdate")), 1, 6), lit("--------")))["month"], "CAST(month(o_orderdate) AS INT)"),
        "text": (lambda: datetimes.fdt_of_parts(datetimes.fdt_parts(F.concat(F.substring(datetimes.fdt(c("o_orderdate")), 1, 6), lit("--------")))), "strftime(o_orderdate, '%Y%m') || '--------'"),
    })
    angle = lambda: F.round(c("c_acctbal") * 100) / 12000.0
    total = "CAST(round_even(abs((round(c_acctbal * 100) / 12000.0)) * 3600, 0) AS BIGINT)"
    pad = lambda e, n: f"lpad(CAST({e} AS VARCHAR), {n}, '0')"
    dms = lambda n, a, b: f"{pad(f'{total} // 3600', n)} || {pad(f'{total} // 60 % 60', 2)} || {pad(f'{total} % 60', 2)} || CASE WHEN (round(c_acctbal * 100) / 12000.0) < 0 THEN '{b}' ELSE '{a}' END"
    _columns("angles", "customer", "c_custkey", {
        "lat": (lambda: location.latitude_dms(angle()), dms(2, "N", "S")),
        "lon": (lambda: location.longitude_dms(angle()), dms(3, "E", "W")),
        "back": (lambda: F.round(location.longitude_of_dms(location.longitude_dms(angle())) * 3600).cast("bigint"), f"CASE WHEN (round(c_acctbal * 100) / 12000.0) < 0 THEN -{total} ELSE {total} END"),
    })
    _columns("corner_fields", "customer", "c_custkey", {
        "lat": (lambda: F.round(location.corners(F.repeat(location.corner_dms(angle(), angle()), 4), lit("G"))[2]["lat"] * 3600).cast("bigint"), f"CASE WHEN (round(c_acctbal * 100) / 12000.0) < 0 THEN -{total} ELSE {total} END"),
        "northing": (lambda: location.corners(F.repeat(location.corner_utm(lit(7), c("c_nationkey") + 5, c("c_custkey")), 4), lit("N"))[1]["northing"], "CAST(c_custkey AS INT)"),
        "mgrs": (lambda: location.corners(F.repeat(location.corner_mgrs(F.concat(lit("4Q"), c("c_custkey").cast("string"))), 4), lit("U"))[0]["zone"], "'4Q' || c_custkey"),
    })
    _columns("locations", "lineitem", "l_orderkey, l_linenumber", {
        "loc": (lambda: location.location(c("l_linenumber"), c("l_suppkey")), "lpad(CAST(l_linenumber AS VARCHAR), 5, '0') || lpad(CAST(l_suppkey AS VARCHAR), 5, '0')"),
        "col": (lambda: location.location_parts(location.location(c("l_linenumber"), c("l_suppkey")))["col"], "CAST(l_suppkey AS INT)"),
        "icords": (lambda: location.coordinate_system(c("l_suppkey") * 8 + 32590), "CASE WHEN l_suppkey * 8 + 32590 BETWEEN 32601 AND 32660 THEN 'N' WHEN l_suppkey * 8 + 32590 BETWEEN 32701 AND 32760 THEN 'S' ELSE 'G' END"),
    })
    _columns("elevations", "lineitem", "l_orderkey, l_linenumber", {
        "metres": (lambda: numeric.elevation(cents() % 65536), f"CAST(CASE WHEN {cents_sql} % 65536 = 65535 THEN -32767 WHEN ({cents_sql} % 65536) & 32768 <> 0 THEN -(({cents_sql} % 65536) & 32767) ELSE {cents_sql} % 65536 END AS BIGINT)"),
        "bits": (lambda: numeric.elevation_bits(numeric.elevation(cents() % 65536)), f"CAST(CASE WHEN {cents_sql} % 65536 = 32768 THEN 0 ELSE {cents_sql} % 65536 END AS BIGINT)"),
    })
    _columns("sample_bits", "lineitem", "l_orderkey, l_linenumber", {
        "low": (lambda: numeric.unjustified(c("l_partkey"), 5, 8), "l_partkey & 31"),
        "high": (lambda: numeric.unjustified(c("l_partkey") % 256, 5, 8, right=False), "(l_partkey % 256) >> 3"),
        "back": (lambda: numeric.justified(numeric.unjustified(c("l_partkey") % 256, 5, 8, right=False), 5, 8, right=False), "((l_partkey % 256) >> 3) << 3"),
        "lut": (lambda: numeric.looked_up(F.array(*[lit(i * i) for i in range(5)]), c("l_linenumber")), "[0, 1, 4, 9, 16][l_linenumber + 1]"),
    })
    written = lambda: numeric.write_unsigned(c("o_orderkey"), 4)
    _columns("byte_numbers", "orders", "o_orderkey", {
        "hex": (lambda: F.hex(written()), "lpad(printf('%X', o_orderkey), 8, '0')"),
        "back": (lambda: numeric.read_unsigned(written(), 0, 4), "o_orderkey"),
        "little": (lambda: numeric.read_unsigned(numeric.write_unsigned(c("o_orderkey"), 4, True), 0, 4, True), "o_orderkey"),
        "signed": (lambda: numeric.read_signed(numeric.write_signed(-c("o_orderkey"), 4), 0, 4), "-o_orderkey"),
        "short": (lambda: numeric.read_signed(numeric.write_signed(-c("o_orderkey") % 30000, 2, True), 0, 2, True), "-o_orderkey % 30000"),
        "too_big": (lambda: numeric.write_unsigned(c("o_orderkey"), 1).isNull(), "o_orderkey > 255"),
    })
    _columns("checksums", "customer", "c_custkey", {
        "sum": (lambda: numeric.checksum(c("c_name").cast("binary")), "CAST(list_sum(list_transform(string_split(c_name, ''), lambda x: ascii(x))) AS BIGINT)"),
        "holds": (lambda: numeric.checksum_holds(F.concat(c("c_name").cast("binary"), numeric.write_unsigned(numeric.checksum(c("c_name").cast("binary")) + c("c_custkey") % 2, 4))), "c_custkey % 2 = 0"),
    })
    whole = lambda: F.round(c("l_quantity")).cast("bigint")
    _columns("integer_arithmetic", "lineitem", "l_orderkey, l_linenumber", {
        "plus": (lambda: whole() + c("l_partkey"), "CAST(l_quantity AS BIGINT) + l_partkey"),
        "quotient": (lambda: F.call_function("div", -whole(), lit(7).cast("bigint")), "CAST(trunc(-CAST(l_quantity AS BIGINT) / 7) AS BIGINT)"),
        "rest": (lambda: -whole() % 7, "-CAST(l_quantity AS BIGINT) % 7"),
        "both": (lambda: whole().bitwiseAND(c("l_partkey")), "CAST(l_quantity AS BIGINT) & l_partkey"),
        "either": (lambda: whole().bitwiseOR(c("l_partkey")), "CAST(l_quantity AS BIGINT) | l_partkey"),
        "one": (lambda: whole().bitwiseXOR(c("l_partkey")), "xor(CAST(l_quantity AS BIGINT), l_partkey)"),
        "inverse": (lambda: F.bitwise_not(whole()), "~CAST(l_quantity AS BIGINT)"),
    })
    _columns("rate_codes", "lineitem", "l_orderkey, l_linenumber", {
        "quality": (lambda: rates.jpeg_quality(c("l_quantity")), "CAST(greatest(1, least(100, round(l_quantity / 99.9 * 99 + 1))) AS INT)"),
        "rate": (lambda: F.round(rates.bits_per_pixel(c("l_quantity")), 6), "round(8.0 / l_quantity, 6)"),
        "code": (lambda: rates.rate_text(c("l_quantity") + 0.5), "lpad(CAST(CAST(l_quantity AS INT) AS VARCHAR), 2, '0') || '.5'"),
        "parsed": (lambda: rates.rate_parts(F.concat(lit("N"), F.lpad(c("l_linenumber").cast("string"), 3, "0")))["bits"], "CAST(l_linenumber AS DOUBLE)"),
    })
    entries = lambda: F.create_map(
        lit("IC"), F.when(c("p_size") % 5 == 0, "C8").when(c("p_size") % 5 == 1, "C3").when(c("p_size") % 5 == 2, "I1").when(c("p_size") % 5 == 3, " NC "),
        lit("IMODE"), F.when(c("p_size") % 3 == 0, "R").when(c("p_size") % 3 == 1, "X"), lit("NPPBH"), (c("p_size") % 2 * 9000).cast("string"),
        lit("COMRAT"), F.when(c("p_size") % 10 == 0, "01.0").when(c("p_size") % 10 == 5, "N001"), lit("NROWS"), F.lpad(c("p_size").cast("string"), 8, "0"), lit("PVTYPE"), lit("INT"),
    )
    hint = lambda: validate.encoding_hints(entries(), c("p_size") * 100, c("p_size") * 500)
    ic = "CASE p_size % 5 WHEN 0 THEN 'C8' WHEN 1 THEN 'C3' WHEN 2 THEN 'I1' ELSE 'NC' END"
    mode = "CASE p_size % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'X' ELSE 'B' END"
    _columns("hint_rules", "part", "p_partkey", {
        "mode": (lambda: hint()["mode"], mode),
        "ic": (lambda: hint()["compression"], ic),
        "width": (lambda: hint()["block_cols"], "CAST(CASE WHEN p_size % 2 = 1 THEN 9000 ELSE p_size * 500 END AS INT)"),
        "height": (lambda: hint()["block_rows"], "CAST(p_size * 100 AS INT)"),
        "lossless": (lambda: hint()["lossless"], f"CASE WHEN {ic} = 'C8' THEN p_size % 10 <> 0 END"),
        "broken": (lambda: F.array_join(validate.hints(hint(), c("p_size") * 100, c("p_size") * 500, lit(16), F.when(c("p_size") % 4 == 0, 12).otherwise(16)), ";"), f"""concat_ws(';', CASE WHEN {mode} = 'X' THEN 'no such interleave mode' END,
            CASE WHEN {ic} = 'C8' AND {mode} <> 'B' THEN 'JPEG 2000 needs mode B' END, CASE WHEN {ic} = 'C8' AND p_size % 4 = 0 THEN 'JPEG 2000 needs all bits' END, CASE WHEN {ic} IN ('C3', 'I1') THEN 'JPEG takes 8 bits' END,
            CASE WHEN {ic} = 'I1' AND p_size * 500 > 2048 THEN 'I1 takes 2048 rows and columns' END, CASE WHEN {ic} IN ('C3', 'I1') AND {mode} = 'R' THEN 'JPEG has no mode R' END,
            CASE WHEN p_size % 2 = 1 AND p_size * 500 > 9000 THEN 'blocks are too wide' END)"""),
        "conflict": (lambda: F.array_join(validate.conflicts(entries(), NROWS=c("p_size") - c("p_size") % 2, PVTYPE=F.when(c("p_size") % 7 == 0, "SI").otherwise("INT"), NBANDS=lit(1)), ";"), "concat_ws(';', CASE WHEN p_size % 2 = 1 THEN 'NROWS ' || lpad(CAST(p_size AS VARCHAR), 8, '0') || ' is ' || (p_size - 1) END, CASE WHEN p_size % 7 = 0 THEN 'PVTYPE INT is SI' END)"),
        "header": (lambda: F.array_join(validate.data_header(F.repeat(lit("x"), c("p_size")), F.repeat(lit("1"), c("p_size") % 3)), ";"), "concat_ws(';', CASE WHEN p_size > 25 THEN 'an id takes 1 to 25 characters' END, CASE WHEN p_size % 3 <> 2 THEN 'a version takes two characters' END)"),
        "tiff": (lambda: F.array_join(validate.tiff_hints(c("p_size") % 9, c("p_size") % 3, c("p_size") * 5), ";"), "concat_ws(';', CASE WHEN p_size % 9 NOT IN (1, 5, 7, 8) THEN 'no such compression' END, CASE WHEN p_size % 3 = 0 THEN 'no such predictor' END, CASE WHEN p_size % 9 = 7 AND p_size * 5 > 100 THEN 'quality lies between 1 and 100' END)"),
        "predictor": (lambda: validate.default_predictor(c("p_size") % 9), "CASE WHEN p_size % 9 IN (5, 8) THEN 2 ELSE 1 END"),
        "level": (lambda: validate.level_valid(c("p_size") % 10), "p_size % 10 IN (3, 5, 6, 7, 9)"),
        "names": (lambda: F.array_join(validate.band_names(F.when(c("p_size") % 2 == 0, "RGB").otherwise("MONO"), F.array(F.when(c("p_size") % 4 == 0, "R ").otherwise("M"))), ";"), "CASE WHEN p_size % 2 = 0 THEN 'RGB has bands R, G and B' ELSE '' END"),
        "whole": (lambda: F.size(validate.image(c("p_size") * 100, c("p_size") * 100, lit(3), (lit(8), lit(8)), (lit(256), lit(256)), lit("B"), lit(8), lit(8), lit("RGB"), lit(3), lit("S"), lit(0), lit(0))), "CAST(1 + CASE WHEN p_size * 100 > 2048 THEN 3 ELSE 0 END AS INT)"),
    })
    rows = lambda: c("p_size") * 300
    bits = lambda: F.when(c("p_size") % 2 == 0, 16).otherwise(8)
    _columns("validation", "part", "p_partkey", {
        "dimensions": (lambda: F.array_join(validate.dimensions(rows(), rows(), lit(3)), ";"), "CASE WHEN p_size * 300 > 2048 THEN 'dimension beyond complexity level' ELSE '' END"),
        "blocking": (lambda: F.array_join(validate.blocking(rows(), rows(), lit(20), c("p_size"), lit(256), lit(256)), ";"), "concat_ws(';', CASE WHEN 5120 < p_size * 300 THEN 'blocks don''t cover the rows' END, CASE WHEN p_size * 256 < p_size * 300 THEN 'blocks don''t cover the columns' END)"),
        "pixel": (lambda: F.array_join(validate.pixel_type(lit("R"), bits(), bits() + 1), ";"), "'more actual bits than bits;real samples take 32 or 64 bits'"),
        "bands": (lambda: F.array_join(validate.band_count(lit("RGB"), c("p_size"), F.when(c("p_size") == 1, "S").otherwise("B")), ";"), "concat_ws(';', CASE WHEN p_size <> 3 THEN 'RGB has 3 bands' END, CASE WHEN p_size = 1 THEN 'mode S needs several bands' END)"),
        "tables": (lambda: F.array_join(validate.lookup_tables(c("p_size") % 7, c("p_size"), lit(4), lit("RGB/LUT")), ";"), "concat_ws(';', CASE WHEN p_size % 7 > 4 THEN 'more than four tables' END, CASE WHEN p_size % 7 > 0 AND p_size < 16 THEN 'fewer entries than values' END, CASE WHEN p_size % 7 <> 3 THEN 'RGB/LUT needs three tables' END)"),
        "rounded": (lambda: validate.rounded_tile(c("p_size")), "CAST((p_size + 15) // 16 * 16 AS INT)"),
        "type": (lambda: validate.pixel_class(c("p_size") % 4, bits()), "CASE p_size % 4 WHEN 1 THEN 'uint' || CASE p_size % 2 WHEN 0 THEN 16 ELSE 8 END WHEN 2 THEN 'int' || CASE p_size % 2 WHEN 0 THEN 16 ELSE 8 END END"),
    })


_functions()


def all_queries() -> tuple[dict[str, Query], dict[str, str]]:
    from . import records

    return QUERIES | records.QUERIES, ORACLE_SQL | records.ORACLE_SQL
