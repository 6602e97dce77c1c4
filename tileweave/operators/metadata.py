"""Metadata maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_prefix(entries: Column, prefix: str) -> Column:
    return F.map_filter(entries, lambda k, _: k.startswith(prefix))


def updated(entries: Column, changes: Column) -> Column:
    """Union of two maps in which the second wins."""
    kept = F.map_filter(entries, lambda k, _: ~F.map_contains_key(changes, k))
    return F.map_concat(kept, changes)


def removed(entries: Column, key: str) -> Column:
    return F.map_filter(entries, lambda k, _: k != key)


def key_rows(df: DataFrame, entries: str, keep: Sequence[str]) -> DataFrame:
    """One row per key of a JSON object: keep..., key."""
    return df.select(*keep, F.explode(F.json_object_keys(entries)).alias("key"))


def without_all(entries: Column) -> Column:
    """The empty map of the same type."""
    return F.map_filter(entries, lambda _k, _v: F.lit(False))


def without_structural(tags: DataFrame, structural: DataFrame, tag: str = "tag") -> DataFrame:
    """Different tags that aren't structural ones."""
    return tags.select(tag).distinct().join(structural.select(tag).distinct(), tag, "left_anti")


def rewritten(url: Column, rewrites: Column) -> Column:
    """A URL by a map of rewrites, itself if the map lacks it."""
    return F.coalesce(F.try_element_at(rewrites, url), url)


def expanded(url: Column, base: Column) -> Column:
    """A template of a URL with its base in place."""
    return F.replace(url, F.lit("{{base}}"), base)


#: The sixteen fields of a security group.
SECURITY = ("CLAS", "CLSY", "CODE", "CTLH", "REL", "DCTP", "DCDT", "DCXM", "DG", "DGDT", "CLTX", "CATP", "CAUT", "CRSN", "SRDT", "CTLN")


def security(entries: Column, prefix: str) -> Column:
    """Struct of the security fields of a map by their prefix; the classification defaults to U, others to blank."""
    return F.struct(*[F.coalesce(F.try_element_at(entries, F.lit(prefix + f)), F.lit("U" if f == "CLAS" else "")).alias(f) for f in SECURITY])


def security_map(group: Column, prefix: str) -> Column:
    """Inverse of ``security``."""
    return F.map_from_arrays(F.array(*[F.lit(prefix + f) for f in SECURITY]), F.array(*[group[f] for f in SECURITY]))
