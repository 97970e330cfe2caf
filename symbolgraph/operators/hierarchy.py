"""Inheritance: ancestors, descendants, and methods found along them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolgraph.functions.lineage import cut

#: Joins that double the reach, far more than any hierarchy is deep.
MOST_ROUNDS = 30


def closure(edges: DataFrame) -> DataFrame:
    """(child, ancestor, depth) over EXTENDS up to the roots, the shortest depth of each pair; cycles end by themselves.

    Depth doubles with every join, so a tree of depth d takes log d joins.
    """
    step = edges.where("type = 'EXTENDS' and from_id <> to_id").select(F.col("from_id").alias("child"), F.col("to_id").alias("ancestor"), F.lit(1).alias("depth")).distinct()
    found = cut(step)
    for _ in range(MOST_ROUNDS):
        longer = found.alias("a").join(found.alias("b"), F.col("a.ancestor") == F.col("b.child")).where("a.child <> b.ancestor")
        longer = longer.select("a.child", "b.ancestor", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        longer = cut(found.unionByName(longer).groupBy("child", "ancestor").agg(F.min("depth").alias("depth")))
        grown, found = longer.count() > found.count(), longer
        if not grown:
            return found
    raise RuntimeError(f"inheritance still grows after {MOST_ROUNDS} joins")


def resolve_method(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(cls, name, target): for each class, each method that it has or inherits, from the nearest ancestor that has it."""
    methods = nodes.where("type = 'method'").select(F.col("parent").alias("ancestor"), "name", F.col("id").alias("target"))
    own = nodes.where("type = 'class'").select(F.col("id").alias("child"), F.col("id").alias("ancestor"), F.lit(0).alias("depth"))
    up = own.unionByName(closure(edges))
    return up.join(methods, "ancestor").groupBy(F.col("child").alias("cls"), "name").agg(F.min_by("target", F.struct("depth", "target")).alias("target"))
