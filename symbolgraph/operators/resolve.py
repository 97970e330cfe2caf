"""Edges that follow from others: calls through interfaces, abstract and overridden methods, arguments, endpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symbolgraph.operators.hierarchy import closure


def _split(edges: DataFrame, column: str = "to_id") -> DataFrame:
    return edges.withColumn("owner", F.expr(f"substring_index({column}, '::', 1)")).withColumn("method", F.substring_index(column, "::", -1))


def interface_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For a call to an interface's method, the same method of each class that implements it, where it exists."""
    to = _split(edges.where("type = 'CALLS'").select("from_id", "to_id")).join(nodes.where("type = 'interface'").select(F.col("id").alias("owner")), "owner", "left_semi")
    by = edges.where("type = 'IMPLEMENTS'").select(F.col("from_id").alias("cls"), F.col("to_id").alias("owner"))
    found = to.join(by, "owner").withColumn("target", F.concat_ws("::", "cls", "method"))
    return found.join(nodes.select(F.col("id").alias("target")), "target", "left_semi").select("from_id", F.col("target").alias("to_id"), F.col("to_id").alias("via"), F.lit("INTERFACE_RESOLVED").alias("call_type")).distinct()


def _to_descendants(nodes: DataFrame, edges: DataFrame, abstract: bool, kind: str, skip: list[str]) -> DataFrame:
    methods = nodes.where("type = 'method'").select("id", "parent", "name", F.coalesce("is_abstract", F.lit(False)).alias("abstract"))
    of = edges.where((F.col("type") == "CALLS") & (F.col("call_type").isNull() | ~F.col("call_type").isin(*skip))).select("from_id", "to_id").distinct()
    called = of.join(methods.where(F.col("abstract") == abstract).select(F.col("id").alias("to_id"), F.col("parent").alias("ancestor"), "name"), "to_id")
    concrete = methods.where("not abstract").select(F.col("parent").alias("child"), "name", F.col("id").alias("target"))
    found = called.join(closure(edges), "ancestor").join(concrete, ["child", "name"])
    return found.select("from_id", F.col("target").alias("to_id"), F.col("to_id").alias("via"), F.lit(kind).alias("call_type")).distinct()


def extends_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls to abstract methods reach the concrete ones of descendants."""
    return _to_descendants(nodes, edges, True, "EXTENDS_RESOLVED", ["EXTENDS_RESOLVED", "OVERRIDE_RESOLVED"])


def override_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls to concrete methods may reach the descendants' that override them."""
    return _to_descendants(nodes, edges, False, "OVERRIDE_RESOLVED", ["EXTENDS_RESOLVED", "OVERRIDE_RESOLVED"])


def prune_external_extends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    known = nodes.select(F.col("id").alias("to_id"))
    return edges.where("type <> 'EXTENDS'").unionByName(edges.where("type = 'EXTENDS'").join(known, "to_id", "left_semi").select(*edges.columns))


def argument_edges(edges: DataFrame) -> DataFrame:
    """A flow into a method's n-th argument goes to its n-th parameter; one edge for each source, parameter and index."""
    flows = edges.where("type = 'FLOWS_TO' and argument_index is not null").select("from_id", F.col("to_id").alias("method"), "argument_index", "via")
    has = edges.where("type = 'HAS_PARAMETER'").select(F.col("from_id").alias("method"), F.col("to_id").alias("to_id"), "argument_index")
    one = Window.partitionBy("from_id", "to_id", "argument_index").orderBy("via")
    return flows.join(has, ["method", "argument_index"]).withColumn("n", F.row_number().over(one)).where("n = 1").select("from_id", "to_id", "argument_index", "via")


def view_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Methods that a view names, to all public methods of that name, letters folded."""
    named = edges.where("type = 'BLADE_METHOD_CALL'").select("from_id", F.lower(F.substring_index("to_id", ":", -1)).alias("key"))
    public = nodes.where("type = 'method' and visibility = 'public'").select(F.col("id").alias("to_id"), F.lower("name").alias("key"))
    return named.join(public, "key").select("from_id", "to_id").distinct()


def endpoint_key(endpoint):
    """Endpoints of one route however their parameters are named: verb and path, `{}` for each parameter."""
    path = F.regexp_replace(F.regexp_replace(endpoint, r"\$?\{[^}]*\}", "{}"), r"^api:([A-Z]+):/?(api/)?", r"$1 ")
    return F.regexp_replace(path, "/+$", "")


def link_endpoints(nodes: DataFrame) -> DataFrame:
    """(from_id, to_id): endpoints that clients name, to the routes' endpoint of the same key with the smallest id."""
    ends = nodes.where("type = 'api_endpoint'").select("id", endpoint_key(F.col("id")).alias("key"))
    canonical = ends.groupBy("key").agg(F.min("id").alias("to_id"))
    return ends.join(canonical, "key").where("id <> to_id").select(F.col("id").alias("from_id"), "to_id")
