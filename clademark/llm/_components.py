"""Connected components by randomised contraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label every node of an undirected graph with the smallest node it reaches.

    Each round hooks a node to the neighbour (or itself) with the smallest seeded
    hash, then replaces nodes by what they hook to. A constant share of the nodes
    that still have links goes in each round, whatever the shape of the graph, so
    chains and hubs both end after a logarithmic number of rounds. Rounds are
    written tables that shrink geometrically; nothing is collected.

    Nulls and self-links are ignored; repeated links count once; no links give an
    empty result. Returns ``node, component`` for nodes with at least one link to
    another node.
    """
    edge = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    kind = links.schema[a].dataType
    edges = written(links.filter(F.col(a) != F.col(b)).select(*edge(F.col(a), F.col(b))).distinct(), "links")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        seed = F.lit(len(rounds) + 1)
        both = edges.select("a", "b").union(edges.select("b", "a"))
        best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", seed).alias("h"), F.col("b"))).alias("m"))
        own = F.struct(F.xxhash64("a", seed).alias("h"), F.col("a").alias("b"))
        hooks = written(best.select(F.col("a").alias("node"), F.least(F.col("m"), own)["b"].alias("parent")), "hooks")
        rounds.append(hooks)
        left = hooks.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        right = hooks.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = edges.join(left, "a").join(right, "b").filter("pa != pb")
        edges = written(moved.select(*edge(F.col("pa"), F.col("pb"))).distinct(), "links")
    if not rounds:
        return links.sparkSession.createDataFrame([], f"node {kind.simpleString()}, component {kind.simpleString()}")
    labels = rounds[-1].select("node", F.col("parent").alias("root"))
    for hooks in reversed(rounds[:-1]):
        later = labels.withColumnRenamed("node", "parent")
        labels = hooks.join(later, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
    labels = written(labels, "labels")
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(least, "root").select("node", "component")
