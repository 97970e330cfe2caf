"""Hotspots by degree, and risk ranking over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symbolgraph.functions.graph import calls, round2, usages
from symbolgraph.functions.lineage import cut
from symbolgraph.operators import impact


def degrees(nodes: DataFrame, edges: DataFrame, resolved: bool = False, dependencies: bool = False) -> DataFrame:
    got = edges.where(usages(resolved, dependencies)).groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("incoming"))
    made = edges.where(calls(resolved) | (F.lit(dependencies) & (F.col("type") == "DEPENDS_ON"))).groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("outgoing"))
    zero = F.lit(0).cast("long")
    return nodes.select("id", "type", "parent").join(got, "id", "left").join(made, "id", "left").withColumn("incoming", F.coalesce("incoming", zero)).withColumn("outgoing", F.coalesce("outgoing", zero))


def methods(nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    found = degrees(nodes, edges).where("type = 'method'").withColumn("score", F.col("incoming") + F.col("outgoing")).where("score > 0")
    return found.select("id", "incoming", "outgoing", "score").orderBy(F.desc("score"), "id").limit(limit)


def classes(nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """Classes by the degrees of their methods and their own."""
    by = degrees(nodes, edges).where("type in ('method', 'class')").groupBy(F.when(F.col("type") == "method", F.col("parent")).otherwise(F.col("id")).alias("id")).agg(F.sum("incoming").alias("incoming"), F.sum("outgoing").alias("outgoing"))
    return by.where("id is not null").withColumn("score", F.col("incoming") + F.col("outgoing")).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def depended_on(nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    on = edges.where("type = 'DEPENDS_ON'")
    got = on.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("incoming"))
    made = on.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("outgoing"))
    both = nodes.select("id").join(got, "id", "left").join(made, "id", "left").na.fill(0).withColumn("score", F.col("incoming") + F.col("outgoing"))
    return both.where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def fan_out(nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    return degrees(nodes, edges).where("outgoing > 0").select("id", "incoming", "outgoing").orderBy(F.desc("outgoing"), "id").limit(limit)


def risk_ranking(nodes: DataFrame, edges: DataFrame, limit: int = 20, pool: int | None = None, depth: int = 2) -> DataFrame:
    """Hotspot candidates, each with its change impact, ranked together; all candidates are traversed at once."""
    pool = pool or max(20 * limit, 100)
    lists = [methods(nodes, edges, pool).select("id", "score"), classes(nodes, edges, pool).select("id", "score"), fan_out(nodes, edges, pool).select("id", F.col("outgoing").alias("score"))]
    candidates = lists[0].unionByName(lists[1]).unionByName(lists[2]).groupBy("id").agg(F.max("score").alias("hotspot"))
    candidates = cut(candidates)
    found = impact.report(nodes, impact.impact_edges(edges), candidates.select(F.col("id").alias("seed")), depth).select(F.col("seed").alias("id"), F.col("score").alias("impact"), "risk")
    ranked = candidates.join(found, "id").withColumn("combined", round2(3 * F.col("impact") + F.col("hotspot")))
    order = Window.orderBy(F.expr("array_position(array('CRITICAL', 'HIGH', 'MEDIUM', 'LOW'), risk)"), F.desc("combined"), F.desc("hotspot"), "id")
    top = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)  # the pool has a bound
    return top.join(nodes.agg(F.count("*").alias("population"))).withColumn("percentile", round2(100 * F.col("rank") / F.col("population"))).drop("population")
