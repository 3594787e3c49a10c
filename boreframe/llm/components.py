"""Connected components of an edge table by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boreframe.llm.common import cut


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component
    is named by its smallest node.

    Alternates the large-star and small-star steps on the edge table until it
    no longer changes: each round keeps the components, never adds edges, and
    only shuffles edges (minima are pre-aggregated; joins on a hub node are
    plain shuffled joins, which adaptive execution splits).  Every round is
    checkpointed.  Nothing but a row count and a digest reaches the driver.
    """
    e = cut(edges.where(F.col("a") != F.col("b"))
            .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _digest(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m"))
                  .select(F.col("u").alias("x"), F.least("u", "m").alias("m")))
        large = (both.join(low, both["u"] == low["x"]).where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        large = cut(large)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x"))
        moved = (large.join(low, large["u"] == low["x"])
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v"))
        e = cut(moved.unionByName(low.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct())
        now = _digest(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    roots = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return roots.unionByName(
        e.select(F.col("v").alias("node")).distinct()
        .join(roots.select("node"), "node", "left_anti")
        .select("node", F.col("node").alias("component")))


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
