"""Connected components of an undirected graph by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import cut

MAX_ROUNDS = 200


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component): for every node of an edge, the least node that it can reach.

    Each round takes the least label among the neighbours and then the label of that label, so a path of n
    nodes needs about log n rounds. The joins are keyed by node; a label that many nodes share meets one row
    of the label table, a skew that adaptive execution splits. Lineage is cut every round. Self-loops,
    repeated and reversed edges and an empty table are fine; rows with a null end are ignored. Raises
    RuntimeError if `max_rounds` do not settle the labels (results are never returned half done).
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    both = cut(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("u").alias("v"), F.col("label").alias("seen")), "v").groupBy("u").agg(F.min("seen").alias("seen"))
        least = labels.join(near, "u").select("u", "label", F.least("label", "seen").alias("near"))
        jump = labels.select(F.col("u").alias("near"), F.col("label").alias("far"))
        moved = cut(least.join(jump, "near", "left").select("u", F.col("label").alias("was"), F.least("near", F.coalesce("far", "near")).alias("label")))
        labels = moved.select("u", "label")
        if moved.where("label <> was").isEmpty():
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
