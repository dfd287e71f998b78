"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .space import written


def _jump(parents: DataFrame) -> DataFrame:
    """Parents' parents; ``moved`` where there were any."""
    up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_top"))
    return parents.join(up, "parent", "left").select("node", F.coalesce("_top", "parent").alias("parent"), F.col("_top").isNotNull().alias("moved"))


def _flat(parents: DataFrame) -> DataFrame:
    """Every node with the root of its tree; a parent is smaller than its node."""
    while True:
        parents = written(_jump(_jump(parents).drop("moved")), "parents")
        moved, parents = parents.where("moved"), parents.drop("moved")
        if moved.isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node of the links ``a, b``; a component's name is its smallest node.

    Each round hooks every node to its smallest neighbour, flattens the trees and contracts them.
    The number of rounds grows with the logarithm of the nodes; each round's links are written, fewer each time.
    """
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    links = written(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").select(*ordered("a", "b")).distinct(), "links")
    nodes, rounds = links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), []
    while not links.isEmpty():
        parents = _flat(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")))
        rounds.append(parents)
        pa, pb = (parents.select(F.col("node").alias(x), F.col("parent").alias("p" + x)) for x in "ab")
        links = links.join(pa, "a", "left").join(pb, "b", "left").select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y")).where("x <> y")
        links = written(links.select(*ordered("x", "y")).distinct(), "links")
    found = nodes.select("node", F.col("node").alias("component"))
    for parents in rounds:
        up = parents.select(F.col("node").alias("component"), F.col("parent").alias("_up"))
        found = found.join(up, "component", "left").select("node", F.coalesce("_up", "component").alias("component"))
    return written(found, "components")
