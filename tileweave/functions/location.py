"""Corner coordinates, angles, locations and target ids in fixed-width text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _angle(text: Column, degrees: int) -> Column:
    """Degrees of ``d..dmmssH``; H in S or W is negative."""
    d, m, s = (F.substring(text, 1, degrees), F.substring(text, degrees + 1, 2), F.substring(text, degrees + 3, 2))
    value = d.try_cast("double") + m.try_cast("double") / 60 + s.try_cast("double") / 3600
    return F.when(F.substring(text, degrees + 5, 1).isin("S", "W"), -value).otherwise(value)


def _dms(value: Column, degrees: int, positive: str, negative: str) -> Column:
    """``d..dmmssH`` of degrees: total seconds, halves to even, so seconds carry."""
    seconds = F.bround(F.abs(value) * 3600).cast("bigint")
    d, m, s = F.expr("0"), seconds, seconds
    d = F.floor(seconds / 3600).cast("bigint")
    m = F.floor((seconds % 3600) / 60).cast("bigint")
    s = seconds % 60
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.concat(pad(d, degrees), pad(m, 2), pad(s, 2), F.when(value < 0, F.lit(negative)).otherwise(F.lit(positive)))


def latitude_dms(value: Column) -> Column:
    return _dms(value, 2, "N", "S")


def longitude_dms(value: Column) -> Column:
    return _dms(value, 3, "E", "W")


def latitude_of_dms(text: Column) -> Column:
    return _angle(text, 2)


def longitude_of_dms(text: Column) -> Column:
    return _angle(text, 3)


def corners(text: Column, system: Column) -> Column:
    """The four corners of a 60-character field by its coordinate system: G and D as lat and lon, N, S and U as zone text."""

    def one(i: int) -> Column:
        part = F.substring(text, 15 * i + 1, 15)
        lat = F.when(system == "G", latitude_of_dms(F.substring(part, 1, 7))).when(system == "D", F.substring(part, 1, 7).try_cast("double"))
        lon = F.when(system == "G", longitude_of_dms(F.substring(part, 8, 8))).when(system == "D", F.substring(part, 8, 8).try_cast("double"))
        utm = system.isin("N", "S")
        zone = F.when(utm, F.substring(part, 1, 2)).when(system == "U", F.rtrim(part))
        return F.struct(
            lat.alias("lat"), lon.alias("lon"), zone.alias("zone"),
            F.when(utm, F.substring(part, 3, 6).try_cast("int")).alias("easting"), F.when(utm, F.substring(part, 9, 7).try_cast("int")).alias("northing"),
        )

    return F.when(F.length(text) == 60, F.array(*[one(i) for i in range(4)]))


def corner_dms(lat: Column, lon: Column) -> Column:
    return F.concat(latitude_dms(lat), longitude_dms(lon))


def corner_decimal(lat: Column, lon: Column) -> Column:
    return F.format_string("%+07.3f%+08.3f", lat, lon)


def corner_utm(zone: Column, easting: Column, northing: Column) -> Column:
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.concat(pad(zone, 2), pad(easting, 6), pad(northing, 7))


def corner_mgrs(text: Column) -> Column:
    return F.rpad(text, 15, " ")


def location(row: Column, column: Column) -> Column:
    return F.concat(F.lpad(row.cast("string"), 5, "0"), F.lpad(column.cast("string"), 5, "0"))


def location_parts(text: Column, signed: bool = False) -> Column:
    """Row and column of ten characters; null unless both are digits (with ``signed``: numbers)."""
    row, column = F.substring(text, 1, 5), F.substring(text, 6, 5)
    fine = (F.length(text) == 10) & (F.lit(True) if signed else text.rlike(r"^\d{10}$"))
    return F.when(fine, F.struct(row.try_cast("int").alias("row"), column.try_cast("int").alias("col")))


def target_parts(text: Column) -> Column:
    """Parts of a target id of 17 characters; null for others."""
    return F.when(F.length(text) == 17, F.struct(F.rtrim(F.substring(text, 1, 10)).alias("be"), F.rtrim(F.substring(text, 11, 5)).alias("suffix"), F.rtrim(F.substring(text, 16, 2)).alias("country")))


def target_id(be: Column, suffix: Column, country: Column) -> Column:
    """17 characters: the parts, filled with blanks; null if one is too long."""
    fits = (F.length(be) <= 10) & (F.length(suffix) <= 5) & (F.length(country) <= 2)
    return F.when(fits, F.concat(F.rpad(be, 10, " "), F.rpad(suffix, 5, " "), F.rpad(country, 2, " ")))


def elevation_longitude(text: Column) -> Column:
    """Degrees of DDDMMSSH."""
    return _angle(text, 3)


def elevation_latitude(text: Column) -> Column:
    """Degrees of a latitude whose degrees take two or three characters."""
    part = lambda i: F.regexp_extract(text, r"^(\d{2,3})(\d\d)(\d\d)([NS])", i)
    value = part(1).try_cast("double") + part(2).try_cast("double") / 60 + part(3).try_cast("double") / 3600
    return F.when(part(4) == "S", -value).otherwise(value)


def axis_aligned(corner: Column) -> Column:
    """Whether upper corners share a latitude and left ones a longitude; corners run clockwise from the upper left."""
    return (F.abs(corner[0]["lat"] - corner[1]["lat"]) < 1e-10) & (F.abs(corner[0]["lon"] - corner[3]["lon"]) < 1e-10)


def coordinate_system(epsg: Column) -> Column:
    """The one-letter coordinate system of an EPSG code: UTM zones N and S, else G."""
    return F.when(epsg.between(32601, 32660), F.lit("N")).when(epsg.between(32701, 32760), F.lit("S")).otherwise(F.lit("G"))


def geo_directory(crs: Column) -> Column:
    """Key directory of a coordinate system EPSG:n: model, raster type (areas) and the system's code; WGS 84 for anything else."""
    code = F.coalesce(F.regexp_extract(F.upper(crs), "^EPSG:([^:]*)", 1).try_cast("int"), F.lit(4326))
    projected = code.between(32601, 32760) | ((code > 2000) & (code != 4326))
    key = lambda number, value: (F.lit(number), F.lit(0), F.lit(1), value)
    system = F.when(projected, 3072).otherwise(2048)
    return F.array(F.lit(1), F.lit(1), F.lit(1), F.lit(3), *key(1024, F.when(projected, 1).otherwise(2)), *key(1025, F.lit(1)), system, F.lit(0), F.lit(1), code)
