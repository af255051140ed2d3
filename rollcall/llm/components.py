"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import drop_staged, staged


def _unsettled(pairs: DataFrame) -> bool:
    """Whether any node has two lower neighbours, or is a lower neighbour itself."""
    ends = pairs.select(F.col("node").alias("key"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        pairs.select("low", F.lit(0), F.lit(1))
    )
    seen = ends.groupBy("key").agg(F.sum("up").alias("ups"), F.sum("down").alias("downs"))
    return not seen.where("ups > 1 or (ups > 0 and downs > 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges(a, b)`` that isn't the smallest
    of its component; ``component`` is that smallest node.

    Alternates large-star and small-star steps: each node's higher neighbours,
    then its lower ones, are hung on the lowest neighbour, until all components
    are stars. Every step is a grouped minimum and a join on the node, so no
    component is ever held by one task; each round's pairs are written to the
    shared folder. Null ends and loops are ignored; an empty input gives no rows.
    """
    pairs = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("low")).distinct()
    )
    while _unsettled(pairs):
        lowest = (
            pairs.select("node", "low").union(pairs.select("low", "node"))
            .toDF("centre", "near").groupBy("centre")
            .agg(F.min("near").alias("least"))
            .select("centre", F.least("centre", "least").alias("least"))
        )
        large = pairs.join(lowest, pairs.low == lowest.centre).select("node", F.col("least").alias("low")).distinct()
        hung = large.groupBy("node").agg(F.min("low").alias("least"))
        small = large.join(hung, "node").where("low > least").select(F.col("low").alias("node"), F.col("least").alias("low"))
        now = staged(hung.select("node", F.col("least").alias("low")).union(small).distinct())
        drop_staged(pairs)
        pairs = now
    return pairs.select("node", F.col("low").alias("component"))
