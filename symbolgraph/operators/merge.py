"""Endpoints of several languages made one: nodes of the same verb and path become one node, and all edges follow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolgraph.functions.lineage import cut

ALIAS = "Cross-language endpoint alias merged to canonical route node"


def canonical_id(endpoint: Column) -> Column:
    """`api:VERB:path`, the verb in capitals, `{param}` for each parameter, single slashes and none at the end."""
    rest = F.substr(endpoint, F.lit(5))
    verb, path = F.upper(F.substring_index(rest, ":", 1)), F.substr(rest, F.char_length(F.substring_index(rest, ":", 1)) + 2)
    steps = ((r"\$\{[^}]+\}", "{param}"), (r"\{[^}]+\}", "{param}"), ("/+", "/"), ("/$", ""))
    clean = reduce(lambda p, s: F.regexp_replace(p, *s), steps, path)
    return F.concat(F.lit("api:"), verb, F.lit(":"), F.when(clean == "", "/").otherwise(clean))


def survivors(nodes: DataFrame) -> DataFrame:
    """(id, to): every endpoint and the id that it goes on under."""
    ends = nodes.where((F.col("type") == "api_endpoint") & F.col("id").rlike("^api:[^:]+:"))
    return ends.select("id", canonical_id(F.col("id")).alias("to"))


def merge_endpoints(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with one endpoint for each verb and path.

    Of a class of endpoints the one that already has the common id goes on, else the first by id; it takes up the others'
    keywords, and a description and a file where it has none. Edges point to it, one more, RESOLVES_TO, tells of each
    former id, and edges get the key `from->to:type:via`; of edges that now have one key the last by its former id stays.
    """
    to = cut(survivors(nodes))
    order = F.struct((F.col("id") != F.col("to")).alias("other"), "id")
    plain = [c for c in nodes.columns if c not in ("id", "keywords", "description", "file")]
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(order.alias("order"), F.col(c).alias("v"))))["v"].alias(c)
    words = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("order"), F.coalesce("keywords", F.array().cast("array<string>")).alias("k")))), lambda x: x["k"]))
    ends = nodes.join(to, "id").groupBy("to").agg(F.min_by(F.struct(*plain), order).alias("base"), F.array_distinct(words).alias("keywords"), first("description"), first("file"))
    ends = ends.select(F.col("to").alias("id"), "base.*", "keywords", "description", "file").select(*nodes.columns)
    out = nodes.join(to.select("id"), "id", "left_anti").select(*nodes.columns).unionByName(ends)

    gone = to.where("id <> to")
    moved = edges.join(gone.select(F.col("id").alias("from_id"), F.col("to").alias("new_from")), "from_id", "left").join(gone.select(F.col("id").alias("to_id"), F.col("to").alias("new_to")), "to_id", "left")
    moved = moved.withColumn("from_id", F.coalesce("new_from", "from_id")).withColumn("to_id", F.coalesce("new_to", "to_id")).select(*edges.columns)
    alias = gone.select(F.col("id").alias("from_id"), F.col("to").alias("to_id"), F.lit("RESOLVES_TO").alias("type"), F.lit(ALIAS).alias("reason"), F.lit(1.0).alias("confidence"), F.lit("").alias("id"))
    every = moved.unionByName(alias.select(*(c for c in alias.columns if c in edges.columns)), allowMissingColumns=True)
    key = F.concat(F.col("from_id"), F.lit("->"), F.col("to_id"), F.lit(":"), F.col("type"), F.lit(":"), F.coalesce("via", F.lit("")))
    rest = [c for c in edges.columns if c != "id"]
    last = every.groupBy(key.alias("key")).agg(F.max_by(F.struct(*rest), "id").alias("e"))
    return out, last.select(F.col("key").alias("id"), "e.*").select(*edges.columns)


def backend_linked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of the endpoints that a route handles and a client asks."""
    ends = nodes.where("type = 'api_endpoint'").select("id")
    handled = edges.where("type = 'ROUTES_TO'").select(F.col("from_id").alias("id"))
    return ends.join(handled, "id", "left_semi").join(edges.where("type = 'HTTP_REQUEST'").select(F.col("to_id").alias("id")), "id", "left_semi")
