"""Connected components by repeated contraction; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlines.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b): component is the smallest node reachable.

    A round gives each node its smallest neighbour as parent, follows that parent's parent, and joins the edges to the
    parents. Aggregations run map-side first, so a node with very many edges is no single task's work. Self-loops and
    repeated edges are allowed; no edges give no rows.
    """
    rounds: list[DataFrame] = []
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("p"))
        up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        parent = stored(parent.join(up, "p").select("node", F.col("pp").alias("p")), "parents")
        rounds.append(parent)
        a, b = parent.select(F.col("node").alias("a"), F.col("p").alias("pa")), parent.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(a, "a").join(b, "b").where("pa <> pb")
        edges = stored(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = rounds[0].select("node", F.col("p").alias("component"))
    for later in rounds[1:]:
        found = found.join(later.select(F.col("node").alias("component"), "p"), "component", "left").select("node", F.coalesce("p", "component").alias("component"))
    return found
