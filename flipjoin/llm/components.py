"""Connected components by random contraction, with every step stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of ``edges`` (a, b BIGINT): label is one node of its component.

    Each round, every node takes the neighbour (or itself) that comes first in a random
    order of the round, edges are rewritten to those and loops and repeats go.  A fixed
    share of nodes goes each round, whatever the shape of the graph, so rounds grow with
    the logarithm of the largest component.  The minimum is combined before the shuffle,
    so a node with many neighbours is no hot key.  Edges with a null end say nothing and
    go; the result is stored, and the steps to it are deleted.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    todo = stored(both.filter("a <> b").distinct(), "edges")
    maps: list[DataFrame] = []
    while not todo.isEmpty():
        order = lambda c: F.struct(F.xxhash64(c, F.lit(len(maps))).alias("rank"), c.alias("node"))
        best = todo.groupBy("a").agg(F.min(order(F.col("b"))).alias("other"))
        step = stored(best.select(F.col("a").alias("node"), F.least(order(F.col("a")), F.col("other"))["node"].alias("label")), "labels")
        left, right = (step.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
        maps.append(step)
        done, todo = todo, stored(todo.join(left, "a").join(right, "b").filter("la <> lb")
                                  .select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "edges")
        discard(done)
    if not maps:  # no edges, no nodes
        return todo.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = maps[-1]
    for step in reversed(maps[:-1]):
        later = out.select(F.col("node").alias("label"), F.col("label").alias("final"))
        out = step.join(later, "label", "left").select("node", F.coalesce("final", "label").alias("label"))
    out = stored(out, "components")
    discard(todo, *maps)
    return out
