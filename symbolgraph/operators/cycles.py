"""Simple cycles of bounded length."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolgraph.functions.graph import calls
from symbolgraph.functions.lineage import cut


def adjacency(edges: DataFrame, resolved: bool = False, dependencies: bool = False) -> DataFrame:
    """(from_id, to_id, label) of calls and, if asked for, dependencies; of parallel edges the smallest label counts."""
    kept = edges.where((calls(resolved) | (F.lit(dependencies) & (F.col("type") == "DEPENDS_ON"))) & (F.col("from_id") != F.col("to_id")))
    return kept.groupBy("from_id", "to_id").agg(F.min(F.concat_ws(":", "type", "call_type")).alias("label"))


def items(found: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(nodes, length, files, labels): cycles with their files, each once, and the labels of their edges, shortest first."""
    rows = found.select("nodes", "length", F.posexplode(F.slice("nodes", F.lit(1), F.col("length"))).alias("at", "from_id"), F.expr("element_at(nodes, at + 2)").alias("to_id"))
    labelled = rows.join(pairs.select("from_id", "to_id", "label"), ["from_id", "to_id"]).join(nodes.select(F.col("id").alias("from_id"), "file"), "from_id", "left")
    once = labelled.groupBy("nodes", "length").agg(F.array_sort(F.collect_set("file")).alias("files"), F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]).alias("labels"))
    return once.orderBy("length", F.array_join("nodes", "->"))


def totals(found: DataFrame, edges: DataFrame, resolved: bool = False, dependencies: bool = False) -> DataFrame:
    """(cycles, edges): how many cycles there are, among how many edges, parallel ones included."""
    kept = edges.where(calls(resolved) | (F.lit(dependencies) & (F.col("type") == "DEPENDS_ON")))
    return found.agg(F.count("*").alias("cycles"), F.lit(kept.count()).alias("edges"))


def from_nodes(pairs: DataFrame, starts: list[str], most: int = 12, limit: int = 20) -> DataFrame:
    """(nodes, length) of the first cycles through any of starts, each rotation once, shortest first."""
    every = reduce(DataFrame.unionByName, (simple_cycles(pairs, most, start) for start in starts))
    ring = F.slice("nodes", F.lit(1), F.col("length"))
    turned = F.array_min(F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda k: F.concat(F.slice(ring, k + 1, F.col("length")), F.slice(ring, F.lit(1), k))))
    once = every.groupBy(turned.alias("ring")).agg(F.min("nodes").alias("nodes"), F.min("length").alias("length"))
    return once.select("nodes", "length").orderBy("length", F.array_join("nodes", "->")).limit(limit)


def trim(pairs: DataFrame, rounds: int = 12) -> DataFrame:
    """Without nodes that have no edge in or none out, as they're on no cycle; again while that leaves others so."""
    pairs = cut(pairs)
    before = pairs.count()
    for _ in range(rounds):
        pairs = pairs.join(pairs.select(F.col("to_id").alias("from_id")).distinct(), "from_id", "left_semi").join(pairs.select(F.col("from_id").alias("to_id")).distinct(), "to_id", "left_semi").select("from_id", "to_id")
        pairs = cut(pairs)
        now = pairs.count()
        if now == before:
            break
        before = now
    return pairs


def simple_cycles(pairs: DataFrame, most: int = 12, start: str | None = None) -> DataFrame:
    """(nodes, length): each simple cycle once, from its smallest node, the first node repeated at the end.

    With start, the cycles through that node. Paths grow by one join a level and only through nodes above their
    start, so none is found twice. The number of paths is that of the graph's; callers trim or restrict it first.
    """
    pairs = trim(pairs.select("from_id", "to_id").distinct())
    first = pairs if start is None else pairs.where(F.col("from_id") == start)
    above = F.lit(True) if start is not None else F.col("to_id") > F.col("from_id")
    paths = first.where(above).select(F.array("from_id", "to_id").alias("path"))
    closed = None
    for _ in range(2, most + 1):
        last = paths.withColumn("from_id", F.element_at("path", -1)).withColumn("first", F.element_at("path", 1))
        step = last.join(pairs, "from_id")
        done = step.where("to_id = first").select(F.concat("path", F.array("first")).alias("nodes"))
        closed = done if closed is None else closed.unionByName(done)
        beyond = F.lit(True) if start is not None else F.col("to_id") > F.col("first")
        paths = step.where(beyond & ~F.array_contains("path", F.col("to_id"))).select(F.concat("path", F.array("to_id")).alias("path"))
        paths = cut(paths)
        if paths.isEmpty():
            break
    return closed.select("nodes", (F.size("nodes") - 1).alias("length"))
