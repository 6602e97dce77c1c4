"""Connected components of an edge table by alternating stars, each step a join and an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    return spread_join(both, least, ["a"]).where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("root"))
    linked = spread_join(down, least, ["a"]).where("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return linked.unionByName(least.select("a", F.col("root").alias("b"))).where("a <> b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one root that hangs on none."""
    twice = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
    hanging = edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi")
    return twice.unionByName(hanging).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of edges (a, b) except the roots themselves.

    The steps repeat until the edges are stars; their number grows with the logarithm of the
    longest path.  Every step is written to the shared folder.  No edges give no rows.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while not _are_stars(now):
        now = staged(_small_star(_large_star(now)), "stars")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def joined_components(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots`` after more edges: only the components that these connect are worked on."""
    of = lambda name: edges_named(edges, roots, name)
    edges = of("a")
    edges = of("b")
    merged = components(edges)
    moved = spread_join(roots, merged.select(F.col("node").alias("root"), F.col("root").alias("_to")), ["root"], "left").select("node", F.coalesce("_to", "root").alias("root"))
    return staged(moved.unionByName(merged), "roots")


def edges_named(edges: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """``edges`` with one end replaced by its root."""
    named = spread_join(edges, roots.select(F.col("node").alias(name), F.col("root").alias("_root")), [name], "left")
    return named.withColumn(name, F.coalesce("_root", name)).drop("_root")
