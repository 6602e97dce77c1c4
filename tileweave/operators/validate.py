"""Rules for image segments; each gives an array of messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Valid complexity levels and the largest dimension of each.
COMPLEXITY = {3: 2048, 5: 8192, 6: 65536, 7: 99999999, 9: 99999999}
#: Bands of a representation.
BANDS = {"RGB": 3, "RGB/LUT": 1, "MONO": 1, "YCbCr601": 3}
MASKED = ("NM", "M1", "M3", "M4", "M5", "M7", "M8", "M9", "MA", "MB", "MC", "MD", "ME")


def messages(*rules: tuple[Column, str]) -> Column:
    """Texts of the rules that are broken."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(text)) for broken, text in rules]))


def dimensions(rows: Column, cols: Column, level: Column) -> Column:
    limit = F.lit(None).cast("int")
    for value, most in COMPLEXITY.items():
        limit = F.when(level == value, F.lit(most)).otherwise(limit)
    return messages(
        ((rows == 0) | (cols == 0), "zero dimension"),
        (limit.isNull(), "unknown complexity level"),
        (F.greatest(rows, cols) > limit, "dimension beyond complexity level"),
    )


def blocking(rows: Column, cols: Column, grid_rows: Column, grid_cols: Column, height: Column, width: Column) -> Column:
    return messages((grid_rows * height < rows, "blocks don't cover the rows"), (grid_cols * width < cols, "blocks don't cover the columns"))


def pixel_type(kind: Column, bits: Column, actual: Column) -> Column:
    return messages(
        (actual > bits, "more actual bits than bits"),
        ((kind == "R") & ~bits.isin(32, 64), "real samples take 32 or 64 bits"),
        ((kind == "C") & (bits != 64), "complex samples take 64 bits"),
        ((kind == "B") & (bits != 1), "bi-level samples take 1 bit"),
    )


def band_count(representation: Column, bands: Column, mode: Column) -> Column:
    rules = [((representation == name) & (bands != n), f"{name} has {n} band" + "s" * (n > 1)) for name, n in BANDS.items()]
    return messages(*rules, ((mode == "S") & (bands == 1), "mode S needs several bands"))


def lookup_tables(count: Column, entries: Column, actual: Column, representation: Column) -> Column:
    return messages(
        (count > 4, "more than four tables"),
        ((count > 0) & (entries <= 0), "a table without entries"),
        ((count > 0) & (entries < F.pow(F.lit(2), actual)), "fewer entries than values"),
        ((representation == "RGB/LUT") & (count != 3), "RGB/LUT needs three tables"),
    )


def masked(compression: Column) -> Column:
    return compression.isin(*MASKED)


def rounded_tile(size: Column) -> Column:
    """The next multiple of sixteen."""
    return F.shiftleft(F.shiftright(size + 15, 4), 4)


def pixel_class(sample_format: Column, bits: Column) -> Column:
    """Pixel type of a sample format (1 unsigned, 2 signed, 3 float) and bits; null if unsupported."""
    out = F.lit(None).cast("string")
    for code, name, sizes in ((1, "uint", (8, 16, 32)), (2, "int", (8, 16, 32)), (3, "float", (32, 64))):
        out = F.when((sample_format == code) & bits.isin(*sizes), F.concat(F.lit(name), bits.cast("string"))).otherwise(out)
    return out


def band_names(representation: Column, names: Column) -> Column:
    """Broken rules of the bands' own representations (an array of texts) by the image's."""
    shown = F.array_join(F.transform(names, lambda n: F.rtrim(n)), ",")
    return messages(
        ((representation == "RGB") & (shown != "R,G,B"), "RGB has bands R, G and B"),
        ((representation == "RGB/LUT") & (shown != "LU"), "RGB/LUT has a band LU"),
        ((representation == "MONO") & ~shown.isin("M", ""), "MONO has a band M or a blank one"),
        ((representation == "YCbCr601") & (shown != "Y,Cb,Cr"), "YCbCr601 has bands Y, Cb and Cr"),
    )


def level_valid(level: Column) -> Column:
    """Whether a complexity level is one of the standard's."""
    return level.isin(*COMPLEXITY)


def image(rows: Column, cols: Column, level: Column, grid: tuple[Column, Column], block: tuple[Column, Column], kind: Column, bits: Column, actual: Column, representation: Column, bands: Column, mode: Column, tables: Column, entries: Column) -> Column:
    """Messages of all rule groups, in their order."""
    return F.concat(
        dimensions(rows, cols, level), blocking(rows, cols, *grid, *block), pixel_type(kind, bits, actual),
        band_count(representation, bands, mode), lookup_tables(tables, entries, actual, representation),
    )


#: Compressions of JPEG 2000 and of JPEG, and the interleave modes.
JPEG_2000, JPEG, MODES = ("C8", "CD", "M8", "MD"), ("C3", "M3", "I1"), ("B", "P", "R", "S")
MOST_BLOCK = 8192


def encoding_hints(entries: Column, rows: Column, cols: Column) -> Column:
    """Struct of what a writer takes from an image's metadata map: mode, compression, block sizes (the image's where absent or 0), rate and whether a JPEG 2000 code is lossless (no rate, or none that can be read)."""
    text = lambda k, default: F.coalesce(F.trim(F.try_element_at(entries, F.lit(k))), F.lit(default))
    size = lambda k, whole: F.coalesce(F.nullif(F.greatest(F.trim(F.try_element_at(entries, F.lit(k))).try_cast("int"), F.lit(0)), F.lit(0)), whole)
    rate, ic = F.try_element_at(entries, F.lit("COMRAT")), text("IC", "NC")
    # A rate: N and three digits of bits (a leading 0: visually lossless by V), or four characters of a number.
    lossy = F.coalesce(rate.rlike(r"^(V\d{3}|V\d\.\d|\d{4}|\d\d\.\d|W\d{3})$"), F.lit(False))
    return F.struct(
        text("IMODE", "B").alias("mode"), ic.alias("compression"), size("NPPBV", rows).cast("int").alias("block_rows"), size("NPPBH", cols).cast("int").alias("block_cols"), rate.alias("rate"),
        F.when(ic.isin(*JPEG_2000), ~lossy).alias("lossless"), ic.isin("CD", "MD").alias("high_throughput"),
    )


def hints(h: Column, rows: Column, cols: Column, bits: Column, actual: Column) -> Column:
    """Broken rules of encoding hints against the samples that they are to code."""
    wavelet, cosine = h["compression"].isin(*JPEG_2000), h["compression"].isin(*JPEG)
    return messages(
        (~h["mode"].isin(*MODES), "no such interleave mode"),
        (wavelet & (h["mode"] != "B"), "JPEG 2000 needs mode B"),
        (wavelet & ~bits.between(1, 38), "JPEG 2000 takes 1 to 38 bits"),
        (wavelet & (actual != bits), "JPEG 2000 needs all bits"),
        (cosine & (bits != 8), "JPEG takes 8 bits"),
        ((h["compression"] == "I1") & (F.greatest(rows, cols) > 2048), "I1 takes 2048 rows and columns"),
        (cosine & (h["mode"] == "R"), "JPEG has no mode R"),
        ((h["block_cols"] < cols) & (h["block_cols"] > MOST_BLOCK), "blocks are too wide"),
        ((h["block_rows"] < rows) & (h["block_rows"] > MOST_BLOCK), "blocks are too high"),
    )


def conflicts(entries: Column, **found: Column) -> Column:
    """What a metadata map says otherwise than the samples (NROWS=rows, PVTYPE=...); the samples win."""
    rules = []
    for name, value in found.items():
        said = F.trim(F.try_element_at(entries, F.lit(name)))
        number = said.try_cast("long")
        same = F.when(number.isNotNull() & value.try_cast("long").isNotNull(), number == value.try_cast("long")).otherwise(said == value.cast("string"))
        rules.append(F.when(~same, F.concat(F.lit(f"{name} "), said, F.lit(" is "), value.cast("string"))))
    return F.array_compact(F.array(*rules))


def data_header(name: Column, version: Column) -> Column:
    return messages((~F.length(name).between(1, 25), "an id takes 1 to 25 characters"), (F.length(version) != 2, "a version takes two characters"))


def tiff_hints(compression: Column, predictor: Column, quality: Column) -> Column:
    return messages(
        (~compression.isin(1, 5, 7, 8, 32773, 32946), "no such compression"),
        (~predictor.isin(1, 2), "no such predictor"),
        ((compression == 7) & ~quality.between(1, 100), "quality lies between 1 and 100"),
    )


def default_predictor(compression: Column) -> Column:
    """Differences where they help (LZW and deflate), else none."""
    return F.when(compression.isin(5, 8, 32946), 2).otherwise(1)


#: Sample types that an array may have to be written in a format.
ARRAY_TYPES = {
    "nitf": ("uint8", "uint16", "int16", "float32"), "tiff": ("uint8", "uint16", "int16", "float32"), "png": ("uint8", "uint16"),
    "j2k": ("uint8", "uint16", "int16"), "jpeg": ("uint8",), "dted": ("int16",),
}


def array_rules(shape: Column, dtype: Column, fmt: Column) -> Column:
    """What keeps an array (its shape as an array column) from being written in a format."""
    fits = F.lit(False)
    for name, types in ARRAY_TYPES.items():
        fits = fits | ((fmt == name) & dtype.isin(*types))
    return messages(
        (~F.size(shape).between(2, 3), "two or three dimensions are needed"),
        (F.exists(shape, lambda n: n <= 0), "a dimension isn't positive"),
        (~fits, "the format has no such samples"),
    )


def geo_tag_rules(metadata: Column) -> Column:
    """What keeps the geographic keys of a metadata text (JSON, by tag number) from being written."""
    keys, doubles = F.get_json_object(metadata, "$.34735"), F.get_json_object(metadata, "$.34736")
    listed, numbers = F.from_json(keys, "array<string>"), F.from_json(doubles, "array<string>")
    whole = lambda v: F.coalesce(v.try_cast("int").between(0, 65535) & v.rlike("^[0-9]+$"), F.lit(False))
    text = F.get_json_object(metadata, "$.34737")
    return messages(
        (keys.isNotNull() & listed.isNull(), "the key directory is no list"),
        (F.coalesce(F.exists(listed, lambda v: ~whole(v)), F.lit(False)), "a key isn't a number of 16 bits"),
        (F.coalesce(F.size(listed) % 4 != 0, F.lit(False)), "keys come in fours"),
        (doubles.isNotNull() & numbers.isNull(), "the parameters are no list"),
        (F.coalesce(F.exists(numbers, lambda v: v.try_cast("double").isNull()), F.lit(False)), "a parameter isn't a number"),
        (text.startswith("[") | text.startswith("{"), "the text is none"),
    )
