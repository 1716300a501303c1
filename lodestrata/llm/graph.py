"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round takes every node's smallest neighbour with partial minima and joins it back to the edges; the side of the
minima has one row for each node, so Spark can split the edges of a hub on the other side. Every round is a table in the shared folder, and the one before it is deleted. Edges only ever point to
smaller nodes, and the rounds end when none changes, with each node of a component pointing to its smallest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import forget, materialize, merge


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs, in any direction, to (node, root) for every node that is not the smallest of its component."""
    now, before = materialize(_directed(edges), "edges"), None
    while True:
        after = materialize(_star(_star(now, large=True), large=False), "star")
        seen = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        forget(now)
        now = after
        if seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = seen


def _directed(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half round over edges (a, b) with a > b.

    Large: the larger neighbours of each node go to the smallest of the node and its neighbours. Small: the smaller
    neighbours of each node, and the node itself, go to the smallest of them.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = both.where("b > a").join(merge(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(merge(low), "a").select("b", "m").where("b <> m").toDF("a", "b").unionByName(low.toDF("a", "b"))
    return out.where("a <> b").distinct()
