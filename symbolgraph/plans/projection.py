"""A code graph over the driver's tables: the same projection with DataFrames and in DuckDB's SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolgraph.sources.store import Graph

HUB = "App\\Repositories\\Brand11Repository::p1"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _controller(key: Column, nation: Column) -> Column:
    return F.concat(_controller_class(nation), F.lit("::c"), key)


def _controller_class(nation: Column) -> Column:
    return F.concat(F.lit("App\\Http\\Controllers\\N"), nation, F.lit("Controller"))


def _service_class(nation: Column) -> Column:
    return F.concat(F.lit("App\\Services\\N"), nation, F.lit("Service"))


def _repository_class(brand: Column) -> Column:
    return F.concat(F.lit("App\\Repositories\\"), F.replace(brand, F.lit("#"), F.lit("")), F.lit("Repository"))


def _keyed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), _controller_class(F.col("c_nationkey")).alias("parent"), _controller(F.col("c_custkey"), F.col("c_nationkey")).alias("id"))
    s = _table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), _service_class(F.col("s_nationkey")).alias("parent"), F.concat(_service_class(F.col("s_nationkey")), F.lit("::s"), F.col("s_suppkey")).alias("id"))
    p = _table(spark, sf_dir, "part").select("p_partkey", F.lit(0.0).alias("balance"), _repository_class(F.col("p_brand")).alias("parent"), F.concat(_repository_class(F.col("p_brand")), F.lit("::p"), F.col("p_partkey")).alias("id"))
    return c, s, p


def _endpoint() -> Column:
    return F.concat(F.lit("api:GET:/orders/"), F.substring("o_orderpriority", 1, 1), F.lit("/"), F.col("o_orderstatus"))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    customer, supplier, part = _keyed(spark, sf_dir)
    orders, lineitem = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")

    every = reduce(DataFrame.unionByName, (t.select("id", "parent", "balance") for t in (customer, supplier, part)))
    file = F.concat(F.regexp_replace(F.regexp_replace("parent", r"^App\\", "app/"), r"\\", "/"), F.lit(".php"))
    methods = every.select("id", "parent", F.lit("method").alias("type"), F.substring_index("id", "::", -1).alias("name"), file.alias("file"), F.when(F.col("balance") < 0, "private").otherwise("public").alias("visibility"))
    none = F.lit(None).cast("string")
    classes = every.select("parent").distinct().select(F.col("parent").alias("id"), none.alias("parent"), F.lit("class").alias("type"), F.substring_index("parent", "\\", -1).alias("name"), file.alias("file"), none.alias("visibility"))
    faces = region.select(F.concat(F.lit("App\\Contracts\\R"), "r_regionkey", F.lit("Interface")).alias("id"), none.alias("parent"), F.lit("interface").alias("type"), F.concat(F.lit("R"), "r_regionkey", F.lit("Interface")).alias("name"), none.alias("file"), none.alias("visibility"))
    ends = orders.select(_endpoint().alias("id")).distinct().select("id", none.alias("parent"), F.lit("api_endpoint").alias("type"), F.col("id").alias("name"), none.alias("file"), none.alias("visibility"))
    nodes = reduce(DataFrame.unionByName, (methods, classes, faces, ends))

    def edge(df: DataFrame, source: Column, target: Column, kind: str, call_type: Column = none) -> DataFrame:
        return df.select(source.alias("from_id"), target.alias("to_id"), F.lit(kind).alias("type"), call_type.alias("call_type")).distinct()

    c, s, p = customer.select("c_custkey", F.col("id").alias("cid")), supplier.select("s_suppkey", F.col("id").alias("sid")), part.select("p_partkey", F.col("id").alias("pid"))
    sold = lineitem.select("l_orderkey", "l_suppkey", "l_returnflag").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    sold = sold.select("o_custkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("r")).distinct()
    sold = sold.join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    line = lineitem.where("l_linenumber in (1, 7)").select("l_linenumber", "l_suppkey", "l_partkey").distinct().join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    ordered = orders.select("o_custkey", _endpoint().alias("end")).distinct().join(c, F.col("o_custkey") == F.col("c_custkey"))
    both = _table(spark, sf_dir, "customer").select("c_nationkey").distinct().join(_table(spark, sf_dir, "supplier").select("s_nationkey").distinct(), F.col("c_nationkey") == F.col("s_nationkey"))
    implements = _table(spark, sf_dir, "supplier").select("s_nationkey").distinct().join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    edges = [
        edge(sold, F.col("cid"), F.col("sid"), "CALLS", F.when(F.col("r"), "INTERFACE_RESOLVED")),
        edge(line.where("l_linenumber = 1"), F.col("sid"), F.col("pid"), "CALLS"),
        edge(line.where("l_linenumber = 7"), F.col("pid"), F.col("sid"), "CALLS"),
        edge(ordered, F.col("end"), F.col("cid"), "ROUTES_TO"),
        edge(both, _controller_class(F.col("c_nationkey")), _service_class(F.col("s_nationkey")), "DEPENDS_ON"),
        edge(implements, _service_class(F.col("s_nationkey")), F.concat(F.lit("App\\Contracts\\R"), "n_regionkey", F.lit("Interface")), "IMPLEMENTS"),
        edge(nation.where("n_nationkey > 0"), _controller_class(F.col("n_nationkey")), _controller_class(F.floor(F.col("n_nationkey") / 2)), "EXTENDS"),
        edge(methods, F.col("parent"), F.col("id"), "CONTAINS"),
    ]
    edges = reduce(DataFrame.unionByName, edges)
    return Graph(nodes, edges.withColumn("id", F.concat_ws("->", "from_id", "to_id", "type", "call_type")))


def event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions between a user's consecutive events of different types."""
    from pyspark.sql import Window

    events = _table(spark, sf_dir, "events")
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select(F.col("event_type").alias("from_id"), after.alias("to_id")).where("to_id is not null and from_id <> to_id").distinct()


#: The same in SQL: common table expressions `nodes` and `edges`.
SQL = r"""
cust AS (SELECT c_custkey, c_acctbal AS balance, 'App\Http\Controllers\N' || c_nationkey || 'Controller' AS parent, 'App\Http\Controllers\N' || c_nationkey || 'Controller::c' || c_custkey AS id FROM customer),
supp AS (SELECT s_suppkey, s_acctbal AS balance, 'App\Services\N' || s_nationkey || 'Service' AS parent, 'App\Services\N' || s_nationkey || 'Service::s' || s_suppkey AS id FROM supplier),
repo AS (SELECT p_partkey, 0.0 AS balance, 'App\Repositories\' || replace(p_brand, '#', '') || 'Repository' AS parent, 'App\Repositories\' || replace(p_brand, '#', '') || 'Repository::p' || p_partkey AS id FROM part),
members AS (SELECT id, parent, balance FROM cust UNION ALL SELECT id, parent, balance FROM supp UNION ALL SELECT id, parent, balance FROM repo),
nodes AS (
  SELECT id, parent, 'method' AS type, split_part(id, '::', 2) AS name, replace(replace(parent, 'App\', 'app/'), '\', '/') || '.php' AS file, CASE WHEN balance < 0 THEN 'private' ELSE 'public' END AS visibility FROM members
  UNION ALL SELECT DISTINCT parent, NULL, 'class', regexp_extract(parent, '[^\\]+$'), replace(replace(parent, 'App\', 'app/'), '\', '/') || '.php', NULL FROM members
  UNION ALL SELECT 'App\Contracts\R' || r_regionkey || 'Interface', NULL, 'interface', 'R' || r_regionkey || 'Interface', NULL, NULL FROM region
  UNION ALL SELECT DISTINCT 'api:GET:/orders/' || substr(o_orderpriority, 1, 1) || '/' || o_orderstatus, NULL, 'api_endpoint', 'api:GET:/orders/' || substr(o_orderpriority, 1, 1) || '/' || o_orderstatus, NULL, NULL FROM orders),
edges AS (
  SELECT DISTINCT c.id AS from_id, s.id AS to_id, 'CALLS' AS type, CASE WHEN l_returnflag = 'R' THEN 'INTERFACE_RESOLVED' END AS call_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cust c ON o_custkey = c.c_custkey JOIN supp s ON l_suppkey = s.s_suppkey
  UNION ALL SELECT DISTINCT s.id, p.id, 'CALLS', NULL FROM lineitem JOIN supp s ON l_suppkey = s.s_suppkey JOIN repo p ON l_partkey = p.p_partkey WHERE l_linenumber = 1
  UNION ALL SELECT DISTINCT p.id, s.id, 'CALLS', NULL FROM lineitem JOIN supp s ON l_suppkey = s.s_suppkey JOIN repo p ON l_partkey = p.p_partkey WHERE l_linenumber = 7
  UNION ALL SELECT DISTINCT 'api:GET:/orders/' || substr(o_orderpriority, 1, 1) || '/' || o_orderstatus, c.id, 'ROUTES_TO', NULL FROM orders JOIN cust c ON o_custkey = c.c_custkey
  UNION ALL SELECT DISTINCT 'App\Http\Controllers\N' || c_nationkey || 'Controller', 'App\Services\N' || s_nationkey || 'Service', 'DEPENDS_ON', NULL FROM (SELECT DISTINCT c_nationkey FROM customer) JOIN (SELECT DISTINCT s_nationkey FROM supplier) ON c_nationkey = s_nationkey
  UNION ALL SELECT DISTINCT 'App\Services\N' || s_nationkey || 'Service', 'App\Contracts\R' || n_regionkey || 'Interface', 'IMPLEMENTS', NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'App\Http\Controllers\N' || n_nationkey || 'Controller', 'App\Http\Controllers\N' || (n_nationkey // 2) || 'Controller', 'EXTENDS', NULL FROM nation WHERE n_nationkey > 0
  UNION ALL SELECT parent, id, 'CONTAINS', NULL FROM members),
calls AS (SELECT * FROM edges WHERE type = 'CALLS' AND (call_type IS NULL OR call_type <> 'INTERFACE_RESOLVED'))"""
