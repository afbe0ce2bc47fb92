"""Connected components of a table of links, by alternating large and small stars; nothing goes to the driver but sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353)).first())


def _star(edges: DataFrame) -> DataFrame:
    """Large star, then small star: every node's larger neighbours, then its smaller ones, go to its smallest."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
    least = large.groupBy("b").agg(F.min("a").alias("m"))
    small = large.join(least, "b").select(F.col("m").alias("root"), F.explode(F.array("a", "b")).alias("b"))
    return small.filter("root < b").select(F.col("root").alias("a"), "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id that links reach) for every id in ``edges`` (a, b); loops and repeats do no harm."""
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    state = _state(edges)
    while state[0]:
        edges = cut(_star(edges))
        after = _state(edges)
        if after == state:
            break
        state = after
    nodes = edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return nodes.unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
