"""Connected components and the representatives of their members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.session import Steps


def components(nodes: DataFrame, edges: DataFrame, steps: Steps | None = None) -> DataFrame:
    """nodes (node), undirected edges (a, b) to (node, component): the least node of each component.

    In every round each node that has edges hooks to its least neighbour. Such hooks close circles of
    two nodes only, whose lesser node is the root of a tree; trees are flattened by pointer jumping
    and become the nodes of the next round. A tree has two nodes or more, so rounds grow with the
    logarithm of the nodes, and jumps in a round with that of a tree's height; the loop ends when no
    edge is left. What a round leaves is a table in the shared folder; older ones are deleted. With
    `steps` of its own the caller can delete the last ones as well, once the result is written."""
    steps = steps or Steps(edges.sparkSession)
    labels = steps.keep(nodes.select("node", F.col("node").alias("label")).distinct(), "labels")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    for end in ("a", "b"):
        both = both.join(labels.select(F.col("node").alias(end)), end, "left_semi")
    both = steps.keep(both.select("a", "b").distinct(), "edges")
    while both.limit(1).count():
        hooks = steps.keep(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("up")), "hooks")
        while True:
            over = hooks.select(F.col("v").alias("o"), F.col("up").alias("jump"))
            jumped = hooks.join(over, F.col("up") == F.col("o")).select("v", F.col("up").alias("old"), F.when(F.col("jump") == F.col("v"), F.least("v", "up")).otherwise(F.col("jump")).alias("up"))
            jumped = steps.keep(jumped, "jumps")
            moved = jumped.filter("old <> up").limit(1).count()
            hooks = jumped.select("v", "up")
            if not moved:
                break
        labels = steps.keep(labels.join(hooks, F.col("label") == F.col("v"), "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
        for end in ("a", "b"):
            both = both.join(hooks.select(F.col("v").alias(end), F.col("up").alias(f"r_{end}")), end)
        both = steps.keep(both.filter("r_a <> r_b").select(F.col("r_a").alias("a"), F.col("r_b").alias("b")).distinct(), "edges")
    least = labels.groupBy(F.col("label").alias("l")).agg(F.min("node").alias("component"))
    return labels.join(least, F.col("label") == F.col("l")).select("node", "component")


def representatives(members: DataFrame, group: str, node: str, order: list[Column]) -> DataFrame:
    """members with the node that comes first in their group."""
    best = members.groupBy(group).agg(F.min_by(node, F.struct(*order, node)).alias("representative"))
    return members.join(best, group)


def rewritten(edges: DataFrame, members: DataFrame, node: str) -> DataFrame:
    """Distinct edges between representatives; those inside one group go."""
    to = lambda end: members.select(F.col(node).alias(end), F.col("representative").alias(f"r_{end}"))
    out = edges.join(to("a"), "a").join(to("b"), "b").filter("r_a <> r_b")
    return out.select(F.least("r_a", "r_b").alias("a"), F.greatest("r_a", "r_b").alias("b")).distinct()
