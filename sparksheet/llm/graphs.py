"""Connected components of a table of links, by alternating stars over Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _toward(pairs: DataFrame, larger: bool) -> DataFrame:
    """Each node's neighbours (larger: the larger ones; else the smaller ones and itself) linked to the smallest of its neighbourhood."""
    both = pairs.select("a", "b")
    if larger:
        both = both.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    moved = both.join(least, "a")
    moved = moved.where("b > a") if larger else moved
    out = moved.select(F.col("b").alias("a"), F.col("least").alias("b"))
    if not larger:
        out = out.unionByName(least.select("a", F.col("least").alias("b")))
    return out.where("a <> b").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every larger end has one smaller end, which is no larger end itself: then each component is a star about its smallest node."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down + up > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of longs -> (node, label): label is the smallest node reachable.  Nodes without links are not listed; no links, no rows."""
    now = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _settled(now):
        after = cut(_toward(_toward(now, larger=True), larger=False))
        discard(now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
