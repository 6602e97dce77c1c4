"""Georeferencing: keys, transforms and corner fields from a coordinate system and a transform."""

from __future__ import annotations

from .formats import FormatError
from .formats.tiff import TAGS

Affine = tuple[float, float, float, float, float, float]  # x = a col + b row + c; y = d col + e row + f


def is_projected(epsg: int) -> bool:
    """UTM zones, and codes beyond 2000 that aren't WGS 84."""
    return 32601 <= epsg <= 32760 or (epsg > 2000 and epsg != 4326)


def geo_keys(epsg: int, pixel_is_point: bool = False) -> list[int]:
    """Key directory: model, raster type, and the code of the system."""
    keys = [(1024, 1 if is_projected(epsg) else 2), (1025, 2 if pixel_is_point else 1), (3072 if is_projected(epsg) else 2048, epsg)]
    return [1, 1, 1, len(keys), *[v for k, value in keys for v in (k, 0, 1, value)]]


def parsed_geo_keys(directory: list[int], doubles: list[float] | None = None, text: str | None = None) -> dict[int, object]:
    """Values of a key directory: in place, in the doubles, or in the text (without its final bar)."""
    if len(directory) < 4 or len(directory) < 4 + 4 * directory[3]:
        raise FormatError("a short key directory")
    out: dict[int, object] = {}
    for i in range(directory[3]):
        key, place, count, value = directory[4 + 4 * i : 8 + 4 * i]
        if place == 0:
            out[key] = value
        elif place == TAGS["GeoDoubleParams"]:
            values = (doubles or [])[value : value + count]
            out[key] = values[0] if count == 1 and values else values
        elif place == TAGS["GeoAsciiParams"]:
            out[key] = (text or "")[value : value + count].rstrip("|\0")
    return out


def transform_tags(transform: Affine) -> dict[str, list[float]]:
    """Scale and tie point of an axis-aligned transform, a full matrix of others."""
    a, b, c, d, e, f = transform
    if b == 0 and d == 0 and e < 0:
        return {"ModelPixelScale": [a, -e, 0.0], "ModelTiepoint": [0.0, 0.0, 0.0, c, f, 0.0]}
    return {"ModelTransformation": [a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]}


def checked_transform(tags: dict[str, list[float]]) -> dict[str, list[float]]:
    for name, fits in (("ModelPixelScale", lambda n: n == 3), ("ModelTiepoint", lambda n: n and n % 6 == 0), ("ModelTransformation", lambda n: n == 16)):
        if name in tags and not fits(len(tags[name])):
            raise FormatError(f"{name} has {len(tags[name])} values")
    return tags


def tiff_georef(epsg: int, transform: Affine) -> dict[str, list]:
    return {"GeoKeyDirectory": geo_keys(epsg), **transform_tags(transform)}


def _dms(value: float, degrees: int, hemispheres: str) -> str:
    seconds = round(abs(value) * 3600)
    return f"{seconds // 3600:0{degrees}d}{seconds // 60 % 60:02d}{seconds % 60:02d}{hemispheres[value < 0]}"


def corner_field(corners: list[tuple[float, float]]) -> str:
    """Sixty characters of four (longitude, latitude) corners, clockwise from the upper left."""
    return "".join(_dms(lat, 2, "NS") + _dms(lon, 3, "EW") for lon, lat in corners)


def nitf_georef(epsg: int, corners: list[tuple[float, float]] | None) -> dict[str, str]:
    """Coordinate system and, for geographic ones, the corner field; a UTM zone sets the system alone."""
    system = "N" if 32601 <= epsg <= 32660 else "S" if 32701 <= epsg <= 32760 else "G"
    if system != "G":
        return {"ICORDS": system}
    return {"ICORDS": "G", "IGEOLO": corner_field(corners)} if corners else {"ICORDS": "G"}
