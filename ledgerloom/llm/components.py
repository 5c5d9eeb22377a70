"""Connected components of an edge list, by alternating large-star and small-star steps.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).
No step gathers a node's neighbours in one task: minima are pre-aggregated
and the joins may be split by skew, so a hub of any degree is fine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _to_minimum(pairs: DataFrame) -> DataFrame:
    """pairs (node, other), one for each neighbour; adds the least of a node and its neighbours."""
    least = pairs.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"))
    return pairs.join(least, "node")


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long), in any order and repeated at will -> (node, root).

    root is the least node of the component. Only nodes that have an edge to
    another node are listed; no edges give an empty table.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges")
    before = _state(edges)
    while before[0]:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        large = _to_minimum(both).where("other > node").select(F.col("other").alias("node"), F.col("least").alias("other"))
        large = large.where("node <> other").distinct()
        small = _to_minimum(large)
        small = small.select(F.col("other").alias("a"), F.col("least").alias("b")).unionByName(small.select(F.col("node").alias("a"), F.col("least").alias("b")))
        edges = materialize(small.where("a <> b").distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
