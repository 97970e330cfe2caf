"""Types of properties: from typed parameters to the properties that take them, down the hierarchy, and on to calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolgraph.functions.lineage import cut
from symbolgraph.operators import hierarchy

# Fixed value: how often types go from parents to children.
PASSES = 8


def assigned(parameters: DataFrame, assignments: DataFrame) -> DataFrame:
    """(class, property, type) of `$this->property = $variable`, the variable a typed parameter of the same method; of
    several assignments to a property the last counts.

    parameters is (method, variable, type), assignments (class, method, at, property, variable).
    """
    typed = assignments.join(parameters.where("type is not null"), ["method", "variable"])
    return typed.groupBy("class", "property").agg(F.max_by("type", F.struct("method", "at", "type")).alias("type"))


def propagate(types: DataFrame, edges: DataFrame, passes: int = PASSES) -> DataFrame:
    """types (class, property, type) after so many passes from parents to children: a pass gives each class its parent's
    type of every property that the parent has, over the class's own; of several parents the last by id counts. All
    classes take a pass at once, so a type goes down by `passes` levels, and a cycle hands types on as often.

    A pass looks only at children of classes whose types the last pass changed.
    """
    up = cut(edges.where("type = 'EXTENDS'").select(F.col("from_id").alias("class"), F.col("to_id").alias("parent")).distinct())
    found = fresh = cut(types.select("class", "property", "type"))
    for _ in range(passes):
        touched = fresh.select(F.col("class").alias("parent"), "property").join(up, "parent").select("class", "property").distinct()
        parents = touched.join(up, "class").join(found.select(F.col("class").alias("parent"), "property", "type"), ["parent", "property"])
        given = parents.groupBy("class", "property").agg(F.max_by("type", "parent").alias("given"))
        fresh = given.join(found, ["class", "property"], "left").where("type is null or type <> given").select("class", "property", F.col("given").alias("type"))
        fresh = cut(fresh)
        if fresh.isEmpty():
            break
        found = cut(found.join(fresh, ["class", "property"], "left_anti").unionByName(fresh))
    return found


def calls(nodes: DataFrame, edges: DataFrame, types: DataFrame, uses: DataFrame) -> DataFrame:
    """CALLS of `$this->property->name()`: the method of that name which the property's type has or inherits.

    uses is (class, method, property, name).
    """
    targets = hierarchy.resolve_method(nodes, edges).select(F.col("cls").alias("type"), "name", F.col("target").alias("to_id"))
    found = uses.join(types, ["class", "property"]).join(targets, ["type", "name"])
    return found.select(F.col("method").alias("from_id"), "to_id", F.lit("CALLS").alias("type")).distinct()
