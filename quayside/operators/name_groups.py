"""Groups of names that are spelt alike, with a bound on how far a group may stretch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quayside.operators.joins import measured
from quayside.operators.names import cluster_similar, name_counts
from quayside.session import settle


def connected(pairs: DataFrame, a: str = "left", b: str = "right") -> DataFrame:
    """``(node, root)`` for every node of the pairs; the root is the smallest node they reach.

    Stars in turns: each node links its larger neighbours to the smallest node it knows, then
    its smaller ones, until nothing moves. Every turn is a shuffled aggregate and a join on
    the node, written to the shared folder. Minima meet before the shuffle; a node with very
    many neighbours is a key of the join only, which adaptive execution splits. The number
    of turns follows the logarithm of the number of nodes.
    """
    edges = settle(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "pairs")
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = settle(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "pairs")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
                                              .alias("e")).select("e.*").filter("u <> v").distinct()
        small = settle(small, "pairs")
        # nothing moved when both tables hold the same pairs
        if small.count() == edges.count() and small.exceptAll(edges).isEmpty():
            break
        edges = small
    roots = small.select(F.col("v").alias("node"), F.col("v").alias("root")).unionAll(small.select(F.col("u").alias("node"), F.col("v").alias("root")))
    return roots.groupBy("node").agg(F.min("root").alias("root"))


def group_similar(df: DataFrame, col: str, max_distance: int = 1, max_spread: int = 2) -> DataFrame:
    """Every distinct name as ``(name, n, cluster, cluster_size, canonical, distance, conflict)``.

    Names within ``max_distance`` edits are linked, and what links reach is one cluster,
    called by its alphabetically first name. Its most frequent name, the first among equals,
    is its centre. A chain of links may lead far from it: a name more than ``max_spread``
    edits away is a ``conflict`` and keeps its own name as ``canonical``, so names of one
    group never differ by more than twice ``max_spread``. ``distance`` counts the edits to
    the centre, up to ``max_spread``, and is null beyond. Names without a near one are
    clusters of their own; nulls are no names.
    """
    counts = measured(name_counts(df, col))
    roots = connected(cluster_similar(df, col, max_distance))
    placed = counts.join(roots, F.col("name") == F.col("node"), "left").select("name", "n", F.coalesce("root", "name").alias("cluster"))
    placed = measured(placed)
    first = F.struct(F.negative("n").alias("minus_n"), "name")
    centres = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"), F.min(first)["name"].alias("centre"))
    joined = placed.join(centres, "cluster")
    away = F.levenshtein("name", "centre", max_spread)
    joined = joined.withColumn("distance", F.when(away >= 0, away))
    conflict = F.col("distance").isNull()
    return joined.select("name", "n", "cluster", "cluster_size", F.when(conflict, F.col("name")).otherwise(F.col("centre")).alias("canonical"),
                         "distance", conflict.alias("conflict"))


def merge_table(groups: DataFrame) -> DataFrame:
    """The edits a result of :func:`group_similar` proposes, as ``(raw, clean)`` of :func:`names.mass_edit`."""
    return groups.filter(F.col("name") != F.col("canonical")).select(F.col("name").alias("raw"), F.col("canonical").alias("clean"))


def conflicts(groups: DataFrame) -> DataFrame:
    """Clusters that reach too far: their size, centre, and how many names were left out, the largest first."""
    centre = F.max(F.when(~F.col("conflict"), F.col("canonical"))).alias("centre")
    return groups.groupBy("cluster", "cluster_size").agg(centre, F.count_if("conflict").alias("left_out")) \
        .filter("left_out > 0").orderBy(F.desc("cluster_size"), "cluster")
