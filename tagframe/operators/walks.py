"""Walks over edges of any length, in a number of rounds that grows with the logarithm of the longest, and the order of dependencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagframe.operators.joins import dealt_join
from tagframe.operators.lineage import removed, written


def reachable(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``src, dst, depth`` of every pair that edges ``src, dst`` lead between, at the least number of steps (1 or more); cycles end.

    Path doubling: what is up to ``h`` steps away is known; a pair between ``h`` and ``2 h`` is one of exactly ``h`` steps and a known one. A depth of
    1,000 takes ten rounds. Each round writes the pairs that it finds and no others. A pair of a node with itself is one if a cycle leads back.
    ``max_depth`` makes deeper walks an error.
    """
    first = written(edges.select("src", "dst").where("src is not null and dst is not null").distinct().withColumn("depth", F.lit(1)), "pairs")
    rounds, horizon = [first], 1
    while True:
        known = reduce(DataFrame.unionByName, rounds)
        edge = rounds[-1].where(F.col("depth") == horizon).select("src", F.col("dst").alias("_mid"))
        step = known.select(F.col("src").alias("_mid"), "dst", (F.col("depth") + horizon).alias("depth"))
        found = dealt_join(edge, step, "_mid").groupBy("src", "dst").agg(F.min("depth").alias("depth"))
        found = written(found.join(known.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "depth"), "pairs")
        if found.isEmpty():
            removed(found)
            break
        rounds.append(found)
        horizon *= 2
    out = reduce(DataFrame.unionByName, rounds)
    if max_depth is not None and not out.where(F.col("depth") > max_depth).isEmpty():
        raise ValueError(f"deeper than {max_depth}")
    return out


def layers(needs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``node, layer`` of ``node, needs``: what needs nothing is in layer 0, everything else one above the highest that it needs. Nodes on a cycle, and those that need one, have no layer (null).

    Rounds count open needs: those who have none left get the layer and leave, with the needs for them. A round writes what is left, so the work is that of
    all edges and the rounds are the layers.
    """
    named = needs.select("node", "needs").where("node is not null and needs is not null").distinct()
    every = named.select("node").unionByName(named.select(F.col("needs").alias("node")))
    every = written((every if nodes is None else every.unionByName(nodes.select("node"))).distinct(), "nodes")
    left, open_, out, layer = every, written(named, "needs"), [], 0
    while True:
        free = written(left.join(open_.select("node").distinct(), "node", "left_anti").select("node", F.lit(layer).alias("layer")), "layer")
        if free.isEmpty():
            break
        out.append(free)
        left, old_left = written(left.join(free, "node", "left_anti"), "left"), left
        open_, old_open = written(open_.join(free.select(F.col("node").alias("needs")), "needs", "left_anti").select("node", "needs"), "needs"), open_
        if old_left is not every:
            removed(old_left)
        removed(old_open)
        layer += 1
    return reduce(DataFrame.unionByName, [*out, left.select("node", F.lit(None).cast("int").alias("layer"))])
