"""Connected components of an edge table by alternating large and small stars.

Every round is a few aggregations and joins by node; rounds are cut by tables in the shared folder, so
nothing is gathered on the driver and a lost executor repeats one round's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import dropped, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a > b). Each node links its chosen neighbours to the least one (or to itself)."""
    reach = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        reach = reach.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = reach.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    links = reach.join(least, "u")
    if large:
        out = links.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = links.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the least node reachable.

    The rounds, which grow with the logarithm of the edges, go on until nothing changes.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = written(pairs, "links"), None
    while True:
        after = written(_stars(_stars(now, True), False), "links")
        dropped(now)
        now = after
        # at the fixed point each node has one link, to a node that has none
        state = now.agg(F.count("*").alias("n"), F.sum(F.col("b").cast("decimal(38,0)")).alias("b"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = state
