"""Connected components of an edge table, by alternating large-star and small-star rounds.

Edges and labels stay distributed; each round is written to the shared folder, so lineage never grows, and only a count comes
to the driver. Large-star: each node hands its greater neighbours to its least neighbour. Small-star: each node hands its
lesser neighbours to the least of them. Both keep components; their alternation ends with every node tied to its least.

The neighbours of a node (pairs of longs) meet in one shuffle partition of a sort-merge join: it spills, and adaptive execution
splits it once it is large. Broadcasting the hubs instead keeps them apart at any size, but the relations of all rounds together took
the driver beyond 1500 MB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop_written, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round on (u, v): neighbourhoods are seen by a min per node and a join, never gathered into one row."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the edges (u, v): root is the least node of its component (longs, signed order).

    Nulls and loops are left out; repeated edges count once. An empty table gives an empty result."""
    now = written(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        after = written(_star(_star(now, True), False), "edges")
        # a graph of stars on their least nodes is a fixed point
        mark = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop_written(now)
        now = after
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = mark
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
