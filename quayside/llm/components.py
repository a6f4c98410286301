"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quayside.session import settle


def _hooks(edges: DataFrame) -> DataFrame:
    """Every node with the root of the tree that forms when all nodes hook to the smallest
    of themselves and their neighbours; jumps along the hooks double until none moves."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    hooks = settle(both.groupBy("node").agg(F.least("node", F.min("other")).alias("to")), "hooks")
    while True:
        ahead = hooks.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        jumped = settle(hooks.join(ahead, "to").select("node", F.col("beyond").alias("to"), (F.col("to") != F.col("beyond")).alias("moved")), "hooks")
        hooks = jumped.select("node", "to")
        if jumped.filter("moved").isEmpty():
            return hooks


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``; the root is the smallest
    node that links reach.

    Each round contracts whole trees: nodes hook to their smallest neighbour, jump to the
    root of the tree that makes, and the ends of the links are replaced by the roots; links
    inside a tree vanish and equal links become one. Every tree that still has links to
    others joins one of them, so at least half of the connected nodes go per round. Minima
    are combined before the shuffle, hence a node with very many links is no hot key.
    Links and labels are tables of the shared folder, which outlive lost executors; the
    driver sees only whether links are left. An empty link table gives an empty result;
    self-links and repeated links change nothing, links with a null end are ignored.
    """
    links = settle(edges.select("a", "b").filter("a <> b").distinct(), "links")
    nodes = links.select(F.col("a").alias("node")).unionAll(links.select(F.col("b").alias("node"))).distinct()
    labels = nodes.select("node", F.col("node").alias("root"))
    for _ in range(most_rounds):
        if links.isEmpty():
            return labels
        hooks = _hooks(links)
        step = hooks.select(F.col("node").alias("root"), "to")
        labels = settle(labels.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        left = hooks.select(F.col("node").alias("a"), F.col("to").alias("a_to"))
        right = hooks.select(F.col("node").alias("b"), F.col("to").alias("b_to"))
        moved = links.join(left, "a").join(right, "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        links = settle(moved.filter("a <> b").distinct(), "links")
    raise RuntimeError(f"links were left after {most_rounds} rounds")
