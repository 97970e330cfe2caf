"""Graphs as a pair of tables: Parquet and JSON in and out, and merging."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from symbolgraph.schema import EDGES, NODES


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of the schema, in order; missing ones null."""
    return df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def __post_init__(self):
        self.nodes, self.edges = conform(self.nodes, NODES), conform(self.edges, EDGES)

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")

    def save_json(self, path: str) -> None:
        """One JSON row a node and an edge; edges without their ids."""
        self.nodes.write.mode("overwrite").json(f"{path}/nodes")
        self.edges.drop("id").write.mode("overwrite").json(f"{path}/edges")


def load(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def load_json(spark: SparkSession, path: str) -> Graph:
    """Nodes without an id are dropped; an edge without one is `from-to-type`."""
    nodes = spark.read.schema(NODES).json(f"{path}/nodes").where("id is not null")
    edges = spark.read.schema(EDGES).json(f"{path}/edges")
    return Graph(nodes, edges.withColumn("id", F.coalesce("id", F.concat_ws("-", "from_id", "to_id", "type"))))


def load_snapshot(spark: SparkSession, path: str) -> Graph:
    """A single JSON document {nodes: [...], edges: [...]} whose edges are {from, to, type, callType, via}."""
    doc = spark.read.option("multiLine", True).json(path)
    nodes = doc.select(F.explode("nodes").alias("n")).select("n.*").where("id is not null")
    edges = doc.select(F.explode("edges").alias("e")).select("e.*")
    renamed = {"from": "from_id", "to": "to_id", "callType": "call_type", "argumentIndex": "argument_index"}
    for old, new in renamed.items():
        edges = edges.withColumnRenamed(old, new)
    if "id" not in edges.columns:
        edges = edges.withColumn("id", F.lit(None).cast("string"))
    return Graph(nodes, edges.withColumn("id", F.coalesce("id", F.concat_ws("-", "from_id", "to_id", "type"))))


def merge_absent(target: Graph, source: Graph) -> Graph:
    """target, and what source has under other ids."""
    add = lambda a, b: a.unionByName(b.join(a, "id", "left_anti"))
    return Graph(add(target.nodes, source.nodes), add(target.edges, source.edges))


def last_write_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key, the one that was written last."""
    others = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r")).select(key, "r.*")
