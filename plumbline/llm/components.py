"""Connected components of an edge table, by rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard


def _lowest(edges: DataFrame) -> DataFrame:
    """For each node u: the smallest of its neighbours and itself. A plain aggregate, so that a hub is summed where its edges are."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _mark(edges: DataFrame) -> tuple:
    """Alike for equal sets of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` to a table ``(node, component)``: the smallest node of each node's component; nodes without edges are absent.

    First every node goes with its smallest neighbour, which leaves as many edges as nodes; what these join is one node from
    there on, and only edges between such nodes are left for another turn. The table is the caller's to discard.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    nearest = both.groupBy("u").agg(F.min("v").alias("v"))
    labels = _stars(nearest.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), max_rounds)
    left = edges.join(labels.select(F.col("node").alias("u"), F.col("component").alias("a")), "u").join(labels.select(F.col("node").alias("v"), F.col("component").alias("b")), "v").where("a <> b")
    left = cut(left.select("a", "b").distinct())
    discard(edges)
    if left.isEmpty():
        discard(left)
        return labels
    more = components(left, max_rounds)
    discard(left)
    least = more.select(F.col("node").alias("component"), F.col("component").alias("least"))
    out = cut(labels.join(least, "component", "left").select("node", F.coalesce("least", "component").alias("component")))
    discard(labels, more)
    return out


def _stars(edges: DataFrame, max_rounds: int) -> DataFrame:
    """Components of edges (u, v), u > v, as a table.

    Alternates large-star and small-star rounds (Kiveris et al., 2014) until the edges no longer change; each round is
    written to the shared folder. Hubs meet no window or collected list: a round is an aggregate and a join on the node.
    """
    now = cut(edges)
    mark = _mark(now)
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.join(_lowest(large), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, now = now, cut(small)
        discard(before)
        seen = _mark(now)
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components not settled in {max_rounds} rounds")
    out = cut(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
    discard(now)
    return out
