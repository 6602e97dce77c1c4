"""Character sets, line ends, fixed-width fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The byte ranges of the field character sets, as whole-string patterns.
CHARSETS = {
    "bcs-a": r"^[\x20-\x7E]*\z",
    "bcs-n": r"^[0-9 +\-./]*\z",
    "bcs-npi": r"^[0-9 ]*\z",
}


def valid(text: Column, charset: str) -> Column:
    """Whether every character belongs to the set; ``ecs-a`` takes every byte from 0x20 up."""
    if charset == "ecs-a":
        return ~F.hex(F.encode(text, "ISO-8859-1")).rlike("^(..)*?[01].")
    return text.rlike(CHARSETS[charset])


def first_bad(text: Column, charset: str) -> Column:
    """Struct of the index and the code of the first character outside the set; null if there is none."""
    bad = "[^" + CHARSETS[charset][2 : CHARSETS[charset].rindex("]")] + "]"
    at = F.regexp_instr(text, F.lit(bad))
    return F.when(at > 0, F.struct((at - 1).alias("index"), F.ascii(F.substr(text, at, F.lit(1))).alias("code")))


def to_lf(text: Column) -> Column:
    """CR LF becomes LF; a lone CR stays."""
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def to_crlf(text: Column) -> Column:
    """Any line end becomes CR LF."""
    return F.replace(F.replace(to_lf(text), F.lit("\r"), F.lit("\n")), F.lit("\n"), F.lit("\r\n"))


def decode_text(data: Column, kind: Column) -> Column:
    """Bytes of a text segment by its format code; line ends become LF.

    STA and MTF are ASCII, UT1 is Latin-1, U8S is UTF-8; what isn't valid there, and
    any other code, is read as UTF-8 with replacement characters.
    """
    latin = F.decode(data, "ISO-8859-1")
    utf8 = F.make_valid_utf8(data.cast("string"))
    ascii_only = latin.rlike(r"^[\x00-\x7F]*\z")
    return to_lf(F.when(kind == "UT1", latin).when(kind.isin("STA", "MTF") & ascii_only, latin).otherwise(utf8))


def text_field(value: Column, width: int) -> Column:
    """A text field: left-justified, padded with spaces."""
    return F.rpad(value, width, " ")


def number_field(value: Column, width: int) -> Column:
    """A numeric field: right-justified, padded with zeros; a sign stays in front."""
    digits = F.lpad(F.abs(value).cast("string"), width, "0")
    signed = F.concat(F.lit("-"), F.lpad(F.abs(value).cast("string"), width - 1, "0"))
    return F.when(value < 0, signed).otherwise(digits)


def fits(value: Column, width: int) -> Column:
    """The value as text if it fits the width; decimals are cut to the width, never the integer part."""
    text = value.cast("string")
    whole = F.length(F.regexp_extract(text, r"^[+-]?\d+", 0))
    cut = F.rtrim(F.substring(text, 1, width), F.lit("."))
    return F.when(F.length(text) <= width, text).when(text.contains(".") & (whole <= width), cut)


def truncated_utf8(text: Column, limit: int) -> Column:
    """The longest prefix of whole characters of at most ``limit`` bytes."""
    letters = F.split(text, "")
    kept = F.aggregate(
        letters,
        F.struct(F.lit(0).alias("used"), F.lit("").alias("text"), F.lit(True).alias("open")),
        lambda s, c: F.when(s["open"] & (s["used"] + F.octet_length(c) <= limit), F.struct((s["used"] + F.octet_length(c)).alias("used"), F.concat(s["text"], c).alias("text"), F.lit(True).alias("open"))).otherwise(
            F.struct(s["used"].alias("used"), s["text"].alias("text"), F.lit(False).alias("open"))
        ),
    )
    return kept["text"]


def clean_text(value: Column) -> Column:
    """A string value as read: trailing spaces don't count."""
    return F.rtrim(value)
