"""Container segments, asset keys, roles and tagged records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chains import link, walked

#: Fixed value: the longest run of tagged records that a subheader holds.
TAGGED_LIMIT = 99_996


def segment_offsets(segments: DataFrame, keys: Sequence[str], order: str, length: str, start: Column | int) -> DataFrame:
    """Offset of each segment behind the header: a running sum within each file."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.lit(start) if isinstance(start, int) else start
    return segments.withColumn("offset", (first + F.coalesce(F.sum(length).over(before), F.lit(0))).cast("bigint"))


def resolved_length(length: Column, width: int, rest: Column) -> Column:
    """A length, or the rest of the file where the field is all nines (its length was unknown when written)."""
    return F.when(length == 10**width - 1, rest).otherwise(length)


def asset_key(kind: Column, index: Column) -> Column:
    return F.concat(F.lower(kind), F.lit(":"), index.cast("string"))


def asset_key_parts(key: Column) -> Column:
    """Struct (kind, index) of a key; null if malformed."""
    fine = key.rlike(r"^(image|graphic|text|des|res):\d+$")
    return F.when(fine, F.struct(F.split_part(key, F.lit(":"), F.lit(1)).alias("kind"), F.split_part(key, F.lit(":"), F.lit(2)).try_cast("int").alias("index")))


def parent_key(key: Column) -> Column:
    """The key that ``image:K:overview:N`` belongs to; null for others."""
    found = F.regexp_extract(key, r"^(image:\d+):overview:(\d+)$", 1)
    return F.when(found != "", found)


def overview_level(role: Column) -> Column:
    """N of ``overview:N``, N at least 1; null for other roles."""
    n = F.regexp_extract(role, r"^overview:(\d+)$", 1).try_cast("int")
    return F.when(n >= 1, n)


def uri_parts(uri: Column) -> Column:
    """Struct (scheme, path, extension) of a URI or a plain path, whose scheme is file; no extension is null."""
    scheme = F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    path = F.when(scheme == "", uri).otherwise(F.substr(uri, F.length(scheme) + 4))
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    extension = F.regexp_extract(name, r"\.([^.]*)$", 1)
    return F.when(uri.isNotNull(), F.struct(F.when(scheme == "", "file").otherwise(F.lower(scheme)).alias("scheme"), path.alias("path"), F.when(extension != "", extension).alias("extension")))


def with_existence(wanted: DataFrame, counts: DataFrame, keys: Sequence[str], key: str = "key", to: str = "exists") -> DataFrame:
    """Asset keys with whether they exist: well formed, and below the number of assets of their kind (keys..., kind, n) in their file."""
    parts = wanted.withColumn("_part", asset_key_parts(F.col(key)))
    found = parts.withColumn("_kind", F.col("_part.kind")).join(counts.select(*keys, F.col("kind").alias("_kind"), F.col("n").alias("_n")), [*keys, "_kind"], "left")
    return found.select(*wanted.columns, F.coalesce(F.col("_part.index") < F.col("_n"), F.lit(False)).alias(to))


def rset_level(path: Column) -> Column:
    """N of a path's ``.rN`` suffix, N at least 1; null without one."""
    n = F.regexp_extract(path, r"\.r(\d+)$", 1).try_cast("int")
    return F.when(n >= 1, n)


def without_rset(path: Column) -> Column:
    return F.regexp_replace(path, r"\.r\d+$", "")


#: Formats by extension.
EXTENSIONS = {
    "ntf": "nitf", "nitf": "nitf", "nsf": "nsif", "nsif": "nsif", "tif": "tiff", "tiff": "tiff", "jp2": "j2k", "j2k": "j2k", "j2c": "j2k", "jpc": "j2k",
    "jpg": "jpeg", "jpeg": "jpeg", "png": "png", "dt0": "dted", "dt1": "dted", "dt2": "dted", **{f"hr{i}": "nitf" for i in range(1, 9)},
}


def format_of(path: Column, explicit: str | None = None) -> Column:
    """Format by explicit name, else by the extension under any ``.rN``; null if unknown."""
    if explicit:
        return F.lit(explicit)
    extension = F.lower(F.regexp_extract(without_rset(path), r"\.([A-Za-z0-9]+)$", 1))
    found = F.lit(None).cast("string")
    for name, kind in EXTENSIONS.items():
        found = F.when(extension == name, F.lit(kind)).otherwise(found)
    return found


def with_role(assets: DataFrame, roles: str, wanted: Sequence[str]) -> DataFrame:
    """Assets that have any of the wanted roles."""
    return assets.where(F.arrays_overlap(F.col(roles), F.array(*[F.lit(r) for r in wanted])))


def default_asset(assets: DataFrame, keys: Sequence[str], roles: str, order: str) -> DataFrame:
    """Of each dataset the first image with role data, else the first image; an aggregate, so no dataset is sorted."""
    best = F.min_by(F.struct(*[F.col(f"`{c}`") for c in assets.columns]), F.struct(~F.coalesce(F.array_contains(roles, "data"), F.lit(False)), F.col(order)))
    return assets.groupBy(*keys).agg(best.alias("_best")).select("_best.*")


def routed_sources(sources: DataFrame, keys: Sequence[str], index: str, roles: str) -> DataFrame:
    """data (the index of the source with role data, else 0) and overviews (level, index, in order) of each dataset of several sources; two with role data raise an error."""
    has = F.array_contains(roles, "data")
    level = F.array_max(F.transform(roles, overview_level))
    found = sources.groupBy(*keys).agg(
        F.count_if(has).alias("_n"), F.coalesce(F.min(F.when(has, F.col(index))), F.lit(0)).cast("int").alias("data"),
        F.array_sort(F.collect_list(F.when(level.isNotNull(), F.struct(level.alias("level"), F.col(index).alias("index"))))).alias("overviews"),
    )
    fine = F.when(F.col("_n") > 1, F.raise_error(F.lit("several sources have the role data"))).otherwise(F.col("data"))
    return found.withColumn("data", fine).drop("_n")


def access_patterns(images: DataFrame, grid_rows: str, grid_cols: str) -> DataFrame:
    """Regions that a benchmark reads: pattern, first and last block row and column of the centre block, of 3 x 3 and, in grids of ten or more, of 10 x 10 blocks about it."""

    def run(length: Column, n: int) -> tuple[Column, Column]:
        first = F.greatest(F.lit(0), F.least(F.floor(length / 2).cast("int") - n // 2, length - n))
        return first, F.least(first + n, length) - 1

    def one(name: str, n: int) -> Column:
        (r0, r1), (c0, c1) = run(F.col(grid_rows), n), run(F.col(grid_cols), n)
        return F.struct(F.lit(name).alias("pattern"), r0.alias("br0"), r1.alias("br1"), c0.alias("bc0"), c1.alias("bc1"))

    wide = F.least(grid_rows, grid_cols) >= 10
    patterns = F.array_compact(F.array(one("single", 1), one("small", 3), F.when(wide, one("large", 10))))
    return images.withColumn("_p", F.explode(patterns)).select(*images.columns, "_p.*")


def record(tag: Column, data: Column) -> Column:
    """A tagged record: six bytes of tag, five digits of the data's bytes, data; null if either doesn't fit."""
    size = F.octet_length(data)
    fits = (F.octet_length(tag) <= 6) & (F.length(tag) == F.octet_length(tag)) & (size <= 99_999)
    return F.when(fits, F.concat(F.rpad(tag, 6, " "), F.lpad(size.cast("string"), 5, "0"), data))


def record_parts(text: Column) -> Column:
    """Struct (tag, length, data) of the record that a text starts with; null if it is cut or its tag has other characters."""
    tag, size = F.substring(text, 1, 6), F.substring(text, 7, 5).try_cast("int")
    fine = tag.rlike("^[A-Za-z0-9 ]{6}$") & size.isNotNull() & (F.length(text) >= 11 + size)
    return F.when(fine, F.struct(F.rtrim(tag).alias("tag"), size.alias("length"), F.substr(text, F.lit(12), size).alias("data")))


def walked_records(data: Column) -> Column:
    """Array of (at, tag, data, error) of the tagged records of a binary chain, walked by their lengths.

    Spaces and zeros after the last record end the chain; a record that is cut, or bytes that are none, end it with a
    row that has an error instead of tag and data.  A null chain has no records.
    """
    item = "struct<at: bigint, tag: string, data: binary, error: string>"

    def step(data: Column, place: Column) -> Column:
        whole = F.octet_length(data).cast("bigint")
        at = place.cast("int")
        tag = F.decode(F.substr(data, at + 1, F.lit(6)), "ISO-8859-1")
        size = F.decode(F.substr(data, at + 7, F.lit(5)), "ISO-8859-1")
        fine = tag.rlike("^[A-Za-z0-9_ ]{6}$") & size.rlike("^[0-9]{5}$")
        length = size.try_cast("bigint")
        row = lambda tag, data, error: F.struct(place.alias("at"), tag.cast("string").alias("tag"), data.cast("binary").alias("data"), error.cast("string").alias("error"))
        failed = lambda text: link(whole, row(F.lit(None), F.lit(None), F.lit(text)))
        read = link(place + 11 + length, row(F.rtrim(tag), F.substr(data, at + 12, length.cast("int")), F.lit(None)))
        blank = F.decode(F.substr(data, at + 1, whole.cast("int") - at), "ISO-8859-1").rlike("^[ \\x00]*$")
        return F.when(fine & (place + 11 + length > whole), failed("the record is cut")).when(fine, read).when(blank, link(whole, F.lit(None).cast(item))).otherwise(failed("no tagged record"))

    return walked(data, F.lit(0), 11, item, step)


def overflow_split(sizes: Column, limit: int = TAGGED_LIMIT) -> Column:
    """Struct (used, fits, over) of a fold over record sizes: each that still fits is kept, also after one that didn't."""
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("fits"), F.lit(0).alias("over"))

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + x <= limit
        return F.struct(
            (s["used"] + F.when(fits, x).otherwise(0)).cast("bigint").alias("used"),
            (s["fits"] + fits.cast("int")).alias("fits"), (s["over"] + (~fits).cast("int")).alias("over"),
        )

    return F.aggregate(sizes, start, step)


def last_of_tag(records: DataFrame, keys: Sequence[str], tag: str, order: str, values: Sequence[str]) -> DataFrame:
    """The last record of each tag, as a map holds it."""
    return records.groupBy(*keys, tag).agg(F.max_by(F.struct(*values), order).alias("_last")).select(*keys, tag, "_last.*")


def segment_totals(segments: DataFrame, kind: str, length: str) -> DataFrame:
    """n, longest and total of the segments of each kind, and of all (a null kind)."""
    return segments.rollup(kind).agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("longest"), F.sum(length).alias("total"))


def largest_parent(images: DataFrame, keys: Sequence[str], size: str, name: str) -> DataFrame:
    """Of each file the image of greatest size, of equal ones the least name."""
    return images.groupBy(*keys).agg(F.max_by(name, F.struct(size, -F.col(name))).alias(name), F.max(size).alias(size))


def repeated_keys(assets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one asset has, and how many: what a writer must reject."""
    return assets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def with_definition(records: DataFrame, definitions: DataFrame, key: str, body: str) -> DataFrame:
    """Records with the ``definition`` of their tag, and ``shown``: that, or the raw bytes of a tag without one."""
    found = records.join(definitions, key, "left")
    return found.withColumn("shown", F.coalesce("definition", F.concat(F.lit("_raw:"), F.hex(body))))


def all_names(*sources: DataFrame) -> DataFrame:
    """Every different name that some source (one column each) has."""
    out = sources[0].toDF("name")
    for other in sources[1:]:
        out = out.union(other.toDF("name"))
    return out.distinct()


def end_offset(segments: DataFrame, keys: Sequence[str], offset: str, length: str, header: str) -> DataFrame:
    """expected: where the last segment of each file ends, or its header if it has none."""
    return segments.groupBy(*keys).agg(F.greatest(F.max(header), F.coalesce(F.max(F.col(offset) + F.col(length)), F.lit(0))).alias("expected"))


def length_warnings(declared: Column, expected: Column, actual: Column) -> Column:
    """What is wrong with a file's declared length; twelve nines say that it wasn't known when written."""
    unknown = declared == 999_999_999_999
    return F.array_compact(F.array(
        F.when(unknown, F.lit("length not recorded")),
        F.when(~unknown & (declared != expected), F.concat(F.lit("declared "), declared.cast("string"), F.lit(", segments end at "), expected.cast("string"))),
        F.when(~unknown & (declared != actual), F.concat(F.lit("declared "), declared.cast("string"), F.lit(", found "), actual.cast("string"))),
    ))


def followed_overflow(headers: DataFrame, overflow: DataFrame, keys: Sequence[str], index: str, number: str, data: str) -> DataFrame:
    """Subheaders with the bytes of the data segment that their overflow field names.

    ``index`` counts from 1, and 0 names none; a segment that isn't there raises an error when it is read.
    """
    named = overflow.select(*keys, (F.col(number) + 1).alias("_named"), F.col(data).alias("overflow"))
    joined = headers.join(named, [*[headers[k] == named[k] for k in keys], F.col(index) == F.col("_named")], "left").drop(*[named[k] for k in keys])
    lost = (F.col(index) > 0) & F.col("_named").isNull()
    return joined.withColumn("overflow", F.when(lost, F.raise_error(F.lit("an overflow segment is missing"))).otherwise(F.col("overflow"))).drop("_named")


def declared_against_found(declared: DataFrame, found: DataFrame, key: str, count: str) -> DataFrame:
    """Files whose declared segment count isn't the number found."""
    counted = found.groupBy(key).agg(F.count(F.lit(1)).alias("found"))
    return declared.join(counted, key, "left").withColumn("found", F.coalesce("found", F.lit(0))).where(F.col("found") != F.col(count))
