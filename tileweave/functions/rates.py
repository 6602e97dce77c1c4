"""Compression rate codes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jpeg_quality(rate: Column) -> Column:
    """Quality 1 to 100 of a rate from 0 to 99.9; a blank rate (null) is 75."""
    return F.coalesce(F.greatest(F.lit(1), F.least(F.lit(100), F.round(rate / 99.9 * 99 + 1).cast("int"))), F.lit(75))


def jpeg_rate(quality: Column) -> Column:
    """Inverse of ``jpeg_quality``."""
    return (quality - 1) / 99.0 * 99.9


def rate_parts(text: Column) -> Column:
    """Struct (lossless, visual, bits) of a four-character code: N lossless, V visually lossless, else bits a pixel; null if malformed."""
    kind, rest = F.substring(text, 1, 1), F.substring(text, 2, 3)
    number = F.when(kind.isin("N", "V"), rest.try_cast("double")).otherwise(text.try_cast("double"))
    return F.when((F.length(text) == 4) & (number.isNotNull() | (text == "----")), F.struct((kind == "N").alias("lossless"), (kind == "V").alias("visual"), number.alias("bits")))


def bits_per_pixel(ratio: Column, bits: int = 8) -> Column:
    """Bits a pixel of a compression ratio."""
    return float(bits) / ratio


def rate_text(bits: Column) -> Column:
    """Four-character code of bits a pixel, rounded as binary numbers are: a format of the JVM rounds ties up."""

    @F.pandas_udf("string")
    def shown(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else f"{v:04.1f}")

    return shown(bits.cast("double"))
