"""What a report on a node lists beside its change impact, for many nodes at once: targets is (target)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolgraph.functions.graph import calls, class_of
from symbolgraph.operators.navigation import framework, relation_targets

# The report's layers, told by what a class id contains, the first that fits, with their ranks.
CONTAINED_LAYERS = (("Controller", 0), ("Http", 0), ("Presentation", 0), ("UseCase", 1), ("Service", 2), ("Repository", 3), ("Repositories", 3), ("Domain", 4), ("Infrastructure", 5))


def _of(edges: DataFrame, targets: DataFrame, end: str) -> DataFrame:
    return edges.withColumn("target", F.col(end)).join(targets.select("target").distinct(), "target", "left_semi")


def used_by(edges: DataFrame, targets: DataFrame, resolved: bool = False) -> DataFrame:
    """(target, from_id, call_type) of the calls into each target, parallel ones included."""
    return _of(edges.where(calls(resolved)), targets, "to_id").select("target", "from_id", "call_type")


def depends_on(edges: DataFrame, targets: DataFrame, resolved: bool = False) -> DataFrame:
    """(target, to_id, call_type) of the calls out of each target, but for those into the framework.

    With resolved, calls resolved through an interface are listed as calls and once more as resolutions, the latter into
    the framework too.
    """
    through = F.col("call_type").eqNullSafe("INTERFACE_RESOLVED")
    times = F.when(framework("to_id"), 0).otherwise(1) + F.when(through & F.lit(resolved), 1).otherwise(0)
    kept = _of(edges.where(calls(resolved)), targets, "from_id").select("target", "to_id", "call_type", F.array_repeat(F.lit(True), times).alias("times"))
    return kept.withColumn("once", F.explode("times")).drop("times", "once")


def kinds(found: DataFrame) -> DataFrame:
    """(target, kinds): how many calls of each kind, as `KIND(n)`, the most frequent first."""
    counted = found.groupBy("target", F.coalesce("call_type", F.lit("CALLS")).alias("kind")).agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "kind")))  # as many as there are kinds of calls
    return counted.groupBy("target").agg(F.array_join(F.transform(ordered, lambda k: F.concat(k["kind"], F.lit("("), (-k["less"]).cast("string"), F.lit(")"))), ", ").alias("kinds"))


def supertypes(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, relation, to_id, node_type, name, file) of what each target extends and implements itself; the last three are
    null if it isn't in the graph."""
    direct = _of(edges.where(F.col("type").isin("EXTENDS", "IMPLEMENTS")), targets, "from_id").select("target", F.col("type").alias("relation"), "to_id")
    return direct.join(nodes.select(F.col("id").alias("to_id"), F.col("type").alias("node_type"), "name", "file"), "to_id", "left").select("target", "relation", "to_id", "node_type", "name", "file")


def resolutions(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, resolution): `interface -> implementation` of the resolved calls out of and into each target, each once."""
    through = edges.where("type = 'CALLS' and call_type = 'INTERFACE_RESOLVED' and via <> ''").select("from_id", "to_id", "via").distinct()
    ends = through.select(F.explode(F.array("from_id", "to_id")).alias("target"), F.concat_ws(" -> ", "via", "to_id").alias("resolution")).distinct()
    return ends.join(targets.select("target").distinct(), "target", "left_semi")


def contained_layer(node: Column) -> tuple[Column, Column]:
    """The name and the rank of the layer whose name a node's class contains; null if none."""
    fits = [(class_of(node).contains(name), name, rank) for name, rank in CONTAINED_LAYERS]
    return F.coalesce(*(F.when(holds, F.lit(name)) for holds, name, _ in fits)), F.coalesce(*(F.when(holds, F.lit(rank)) for holds, _, rank in fits))


def layer_breaks(nodes: DataFrame, edges: DataFrame, targets: DataFrame, resolved: bool = False, dependencies: bool = False) -> DataFrame:
    """(target, from_id, to_id, text) of calls out of each target, and of its class's dependencies if asked for, that go from
    a lower layer up to a higher one."""
    steps = depends_on(edges, targets, resolved).select("target", F.col("target").alias("from_id"), "to_id")
    if dependencies:
        owners = relation_targets(nodes).select(F.col("id").alias("target"), F.col("target").alias("from_id")).join(targets.select("target").distinct(), "target", "left_semi")
        steps = steps.unionByName(owners.join(edges.where("type = 'DEPENDS_ON'").select("from_id", "to_id"), "from_id").select("target", "from_id", "to_id"))
    (low, low_rank), (high, high_rank) = contained_layer(F.col("from_id")), contained_layer(F.col("to_id"))
    named = lambda name, rank: F.concat(name, F.lit("("), rank.cast("string"), F.lit(")"))
    text = F.concat(named(low, low_rank), F.lit(" → "), named(high, high_rank), F.lit(" — lower layer calls upper layer"))
    return steps.where(low_rank > high_rank).select("target", "from_id", "to_id", text.alias("text"))


def unused(nodes: DataFrame, edges: DataFrame, resolved: bool = False) -> DataFrame:
    """(id) of public methods that nothing calls and no route or view enters."""
    entered = edges.where(calls(resolved) | F.col("type").isin("ROUTES_TO", "BLADE_USES_ACTION")).select(F.col("to_id").alias("id")).distinct()
    return nodes.where("type = 'method' and visibility = 'public'").select("id").join(entered, "id", "left_anti")
