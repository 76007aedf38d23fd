"""Connected components of links, by contraction: every round joins nodes to a neighbour and goes on with the links between the joined ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialise


def contract(links: DataFrame) -> list[DataFrame]:
    """Rounds of (node, into) until no link (a, b: longs) is left; a round's nodes are those that earlier rounds led into.

    In each round a node goes to the neighbour of least priority, if that is below its own, and on to where that one goes. Priorities are hashes that differ from round to round, so that also in a long chain
    less than half of the nodes are left each time: the links shrink by a factor, and their total over all rounds is a multiple of the first."""
    edges = materialise(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds = []
    while not edges.isEmpty():
        priority: dict[str, Column] = {c: F.xxhash64(c, F.lit(len(rounds))) for c in "ab"}
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min_by("b", priority["b"]).alias("b"), F.min(priority["b"]).alias("p"))
        step = materialise(near.select(F.col("a").alias("node"), F.when(F.col("p") < priority["a"], F.col("b")).otherwise(F.col("a")).alias("into")), "steps")
        then = step.select(F.col("node").alias("into"), F.col("into").alias("then"))
        rounds.append(materialise(step.join(then, "into").select("node", F.col("then").alias("into")), "joined"))
        moved = edges
        for c in "ab":
            moved = moved.join(rounds[-1].withColumnsRenamed({"node": c, "into": f"{c}_"}), c)
        moved = moved.where("a_ <> b_").select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b")).distinct()
        edges = materialise(moved, "links")
    return rounds


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node on a link between two nodes; component is the smallest node reachable."""
    rounds = contract(links)
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    found = rounds[-1]
    for step in reversed(rounds[:-1]):
        ahead = found.select(F.col("node").alias("into"), F.col("into").alias("then"))
        found = step.join(ahead, "into", "left").select("node", F.coalesce("then", "into").alias("into"))
    found = materialise(found, "components")
    least = found.groupBy("into").agg(F.least(F.min("node"), F.min("into")).alias("component"))
    return found.join(least, "into").select("node", "component")
