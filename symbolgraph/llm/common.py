"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the checkpoint folder, which the session must name."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or f"{tempfile.gettempdir()}/checkpoints")  # in local mode one machine is all there is
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows that are worth a task of their own, and tasks that a small table has at least.
TASK_ROWS, LEAST_TASKS = 20_000, 12


def tasks(rows: int) -> int:
    """Tasks for so many small rows. A shuffle deals a small table over as many as a large one, most of them nearly empty;
    in a chain of many short stages starting them is then most of the time, so their results are read by fewer."""
    return max(LEAST_TASKS, -(-rows // TASK_ROWS))


class Tables:
    """Tables in the shared folder that hold what is read again. A checkpoint keeps what the planner knew of a frame, and
    in a loop of joins that grows with every round; a table starts afresh. A table goes when another of its name is put."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at, self.held, self.named = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", {}, {}

    def put(self, name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        """df, stored; in buckets of column `by`, so that joins on it needn't shuffle it."""
        at = f"{self.at}/{name}-{uuid.uuid4().hex}"
        if by is None:
            df.write.parquet(at)
            found = self.spark.read.parquet(at)
        else:
            table, n = f"t_{uuid.uuid4().hex}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            df.repartition(n, by).write.bucketBy(n, by).format("parquet").option("path", at).saveAsTable(table)
            self.named[at] = table
            found = self.spark.table(table)
        before = self.held.get(name)
        self.held[name] = at
        if before:
            self._drop(before)
        return found

    def _drop(self, at: str) -> None:
        if at in self.named:
            self.spark.sql(f"DROP TABLE {self.named.pop(at)}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        for at in self.held.values():
            self._drop(at)
        self.held = {}


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again."""
    return Tables(df.sparkSession).put("t", df)


def boxed(docs: DataFrame, **more: Column) -> DataFrame:
    """docs with all columns in one struct, `row`, beside columns of our own, whose names thus can't clash with theirs."""
    return docs.select(F.struct("*").alias("row"), *(c.alias(k) for k, c in more.items()))


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of each string of an Arrow column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def bucket(id_col: Column | str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null for a null id."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % mod


def bounded_share(rows: int, bound: int) -> float:
    """The share of rows to keep so that about `bound` of them are kept at most."""
    return 1.0 if rows <= bound else bound / rows


def hash_share(id_col: str, share: float, salt: int) -> Column:
    """True for a share of all ids, chosen by a hash of the id: the same rows at every run and partitioning."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(salt)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected `edges` (u, v); root is the smallest node reachable.

    Alternates large-star and small-star steps until no edge changes. Each step is an aggregation with
    map-side combine and a join, so a node of any degree is never collected into one task.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    n = tasks(edges.count())
    edges = edges.coalesce(n)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(n).distinct().coalesce(n)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(n).distinct().coalesce(n))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    own = edges.select(F.col("v").alias("u")).distinct().join(roots, "u", "left_anti").select(F.col("u").alias("node"), F.col("u").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(own)


def ragged_sum(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:starts[i+1]] along axis 0; starts has one element more than there are segments, none empty."""
    return np.add.reduceat(values, starts[:-1], axis=0)
