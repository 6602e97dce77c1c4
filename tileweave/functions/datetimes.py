"""Fourteen-character date and time fields (CCYYMMDDhhmmss, unknown parts as ``--``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = (("year", 1, 4), ("month", 5, 2), ("day", 7, 2), ("hour", 9, 2), ("minute", 11, 2), ("second", 13, 2))
#: The range of each part.
RANGES = {"year": (0, 9999), "month": (1, 12), "day": (1, 31), "hour": (0, 23), "minute": (0, 59), "second": (0, 59)}


def fdt(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")


def fdt_timestamp(text: Column) -> Column:
    """Timestamp of a complete field; null if a part is unknown or out of range."""
    return F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss"))


def fdt_parts(text: Column) -> Column:
    """Struct of the six parts, null where ``--``; null as a whole if the field is malformed."""
    part = {n: F.substring(text, at, size) for n, at, size in PARTS}
    number = {n: F.when(p.rlike(r"^\d+$"), p.try_cast("int")) for n, p in part.items()}
    fine = F.length(text) == 14
    for n, p in part.items():
        low, high = RANGES[n]
        known = number[n].between(low, high)
        fine = fine & F.coalesce(known, F.lit(False)) if n == "year" else fine & (F.coalesce(known, F.lit(False)) | (p == "--"))
    return F.when(fine, F.struct(*[v.alias(n) for n, v in number.items()]))


def fdt_of_parts(parts: Column) -> Column:
    """Inverse of ``fdt_parts``."""
    return F.concat(*[F.coalesce(F.lpad(parts[n].cast("string"), size, "0"), F.lit("-" * size)) for n, _, size in PARTS])
