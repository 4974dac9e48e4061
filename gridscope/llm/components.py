"""Connected components by alternating large and small stars, on tables that Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridscope.llm.common import staged


def _least(edges: DataFrame, of: str, other: str) -> DataFrame:
    """Least neighbour of every vertex. Written, so that a join with it can split hot vertices."""
    return staged(edges.groupBy(F.col(of).alias("at")).agg(F.least(F.min(other), F.col(of)).alias("least")), "least")


def components(links: DataFrame) -> DataFrame:
    """``row, root`` for every vertex of ``links`` (``a, b``, longs): root is the least vertex of its component.

    Every pass hangs neighbours on their least common neighbour, first the larger ones, then
    the smaller ones; it ends when only stars are left. The number of passes is about the
    logarithm of the longest path. Nothing but counters reaches the driver.
    """
    edges = staged(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = staged(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both-ways")
        least = _least(both, "u", "v")
        large = both.join(least, both["u"] == least["at"]).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = staged(large.where("u <> v").distinct(), "large-star")
        least = _least(large, "u", "v")
        hung = large.join(least, large["u"] == least["at"])
        small = hung.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(hung.select("u", F.col("least").alias("v")))
        edges = staged(small.where("u <> v").distinct(), "small-star")
    return edges.select(F.col("u").alias("row"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("row"), F.col("v").alias("root")).distinct()
    )
