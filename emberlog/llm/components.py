"""Connected components of a graph too large for any one task, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import checkpointed, skew_join


#: Graphs of so few edges are joined without a look for hot nodes: no node can have more.
FEW = 100_000


def _smallest_neighbour(edges: DataFrame) -> DataFrame:
    """Per node ``u`` the smallest of itself and its neighbours; combined before the shuffle, so a node with very many neighbours costs one row a task."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` to ``(node, component)``: each node of an edge with the smallest node it reaches.

    Large-star joins every larger neighbour of a node to the node's smallest neighbour,
    small-star every smaller one; they alternate until the edges no longer change, which
    takes a number of rounds logarithmic in the longest path. Every round is two
    aggregations and two joins on node ids, in large graphs salted where a node holds very many edges, and
    is checkpointed; nothing but counts, one checksum and the few hot nodes of a round
    reach the driver. Null ends, loops and repeated edges are
    ignored; an empty graph gives no rows.
    """
    edges = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state, few = None, edges.count() <= FEW
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined = both.join(_smallest_neighbour(both), "u") if few else skew_join(both, _smallest_neighbour(both), ["u"])
        large = joined.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large if few else checkpointed(large)
        least = _smallest_neighbour(large)
        kept = (large.join(least, "u") if few else skew_join(large, least, ["u"])).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(kept.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state, few = now, now[0] <= FEW
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
