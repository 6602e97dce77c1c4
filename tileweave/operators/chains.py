"""Chains in binary columns: each link tells where the next one begins.

A chain is folded over its places in the JVM; a broken link ends it with a row that says why.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numeric import read_unsigned


def link(following: Column, item: Column) -> Column:
    """What a step gives: the next place, and the link's item (null: none, as where a chain ends)."""
    return F.struct(following.cast("bigint").alias("at"), item.alias("item"))


def walked(data: Column, start: Column, least: int, item: str, step: Callable[[Column, Column], Column]) -> Column:
    """Array of the items (of type ``item``) of a chain from ``start`` on; the data are evaluated once.

    ``step`` makes a ``link`` of the data and a place; a place at or beyond the end of the data ends the chain, so a step
    that finds an end or a fault gives the data's length.  Links take ``least`` bytes at least.
    """
    return F.element_at(F.transform(F.array(data), lambda d: _walked(d, start, least, item, step)), 1)


def _walked(data: Column, start: Column, least: int, item: str, step: Callable[[Column, Column], Column]) -> Column:
    whole = F.octet_length(data).cast("bigint")
    begin = F.struct(start.cast("bigint").alias("at"), F.array().cast(f"array<{item}>").alias("items"))

    def taken(a: Column, _: Column) -> Column:
        joined = lambda f: F.struct(f["at"].alias("at"), F.when(f["item"].isNull(), a["items"]).otherwise(F.concat(a["items"], F.array(f["item"]))).alias("items"))
        return F.when(a["at"] >= whole, a).otherwise(F.element_at(F.transform(F.array(step(data, a["at"])), joined), 1))

    turns = F.sequence(F.lit(0), (whole / least).cast("int"))
    return F.aggregate(F.coalesce(turns, F.array().cast("array<int>")), begin, taken, lambda a: a["items"])


#: Markers of a tile part and of a codestream's end.
TILE_PART, END = 0xFF90, 0xFFD9
PART = "struct<at: bigint, tile: bigint, part: bigint, length: bigint, error: string>"


def walked_tile_parts(data: Column, start: Column) -> Column:
    """Array of (at, tile, part, length, error) of a codestream's tile parts from the first one's place on.

    A part of length 0 takes the rest of the codestream.  Another marker ends the chain; a part that is cut, of another
    header length, or longer than the codestream ends it with an error.
    """

    def step(data: Column, at: Column) -> Column:
        whole = F.octet_length(data).cast("bigint")
        number = lambda at, offset, size: read_unsigned(data, (at + offset).cast("int"), size)
        given = number(at, 6, 4)
        length = F.when(given == 0, whole - at).otherwise(given)
        row = lambda tile, part, length, error: F.struct(at.alias("at"), tile.cast("bigint").alias("tile"), part.cast("bigint").alias("part"), length.cast("bigint").alias("length"), error.cast("string").alias("error"))
        none = F.lit(None)
        failed = lambda text: link(whole, row(none, none, none, F.lit(text)))
        ended = link(whole, none.cast(PART))
        marker = number(at, 0, 2)
        found = link(at + length, row(number(at, 4, 2), number(at, 10, 1), length, none))
        return (
            F.when(marker == END, ended).when(at + 12 > whole, failed("the tile part is cut")).when(marker != TILE_PART, ended)
            .when(number(at, 2, 2) != 10, failed("no tile part header")).when((length < 12) | (at + length > whole), failed("the tile part is longer than the codestream")).otherwise(found)
        )

    return walked(data, start, 12, PART, step)


def running_places(lengths: Column, start: Column) -> Column:
    """Array of (off, len) of parts that follow each other from ``start`` on, by a table of their lengths."""
    begin = F.struct(start.cast("bigint").alias("at"), F.array().cast("array<struct<off: bigint, len: bigint>>").alias("places"))
    step = lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["places"], F.array(F.struct(a["at"].alias("off"), n.cast("bigint").alias("len")))).alias("places"))
    return F.aggregate(lengths, begin, step, lambda a: a["places"])
