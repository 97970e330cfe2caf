"""Lookups around a node: callers, callees, entries, edges of a method, and filters over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolgraph.functions.graph import calls, short_label


def _with_node(edges: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    named = nodes.select(F.col("id").alias(end), F.col("type").alias("node_type"), "file")
    return edges.join(named, end, "left")


def incoming_calls(nodes: DataFrame, edges: DataFrame, target: str, resolved: bool = False, limit: int = 20) -> DataFrame:
    found = edges.where((F.col("to_id") == target) & calls(resolved)).select("from_id", "call_type", "via")
    return _with_node(found, nodes, "from_id").orderBy("from_id", F.coalesce("call_type", F.lit(""))).limit(limit)


def outgoing_calls(nodes: DataFrame, edges: DataFrame, source: str, resolved: bool = False, limit: int = 20) -> DataFrame:
    found = edges.where((F.col("from_id") == source) & calls(resolved)).select("to_id", "call_type", "via")
    return _with_node(found, nodes, "to_id").orderBy("to_id", F.coalesce("call_type", F.lit(""))).limit(limit)


def dependencies(edges: DataFrame, node: str, limit: int = 20) -> DataFrame:
    """What it depends on, then what depends on it; the limit holds for each."""
    on = edges.where(F.col("type") == "DEPENDS_ON")
    out = on.where(F.col("from_id") == node).select(F.lit("out").alias("direction"), F.col("to_id").alias("other")).orderBy("other").limit(limit)
    return out.unionByName(on.where(F.col("to_id") == node).select(F.lit("in").alias("direction"), F.col("from_id").alias("other")).orderBy("other").limit(limit))


def methods_of(nodes: DataFrame, parent: str) -> DataFrame:
    return nodes.where((F.col("type") == "method") & (F.col("parent") == parent)).select("id", "name", "visibility").orderBy("id")


def incoming_entries(edges: DataFrame, target: str, limit: int = 20) -> DataFrame:
    """Calls, then routes, then actions of views; the limit holds for each and for all."""
    to = edges.where(F.col("to_id") == target)
    parts = [("call", calls()), ("route", F.col("type") == "ROUTES_TO"), ("blade", F.col("type") == "BLADE_USES_ACTION")]
    found = [to.where(p).select(F.lit(k).alias("place"), F.lit(kind).alias("kind"), "from_id").distinct().orderBy("from_id").limit(limit) for k, (kind, p) in enumerate(parts)]
    return found[0].unionByName(found[1]).unionByName(found[2]).orderBy("place", "from_id").limit(limit)


def upstream_requests(edges: DataFrame) -> DataFrame:
    """HTTP_REQUEST edges joined with the routes of what they request."""
    h = edges.where("type = 'HTTP_REQUEST'").select(F.col("from_id").alias("client"), F.col("to_id").alias("endpoint"))
    r = edges.where("type = 'ROUTES_TO'").select(F.col("from_id").alias("endpoint"), F.col("to_id").alias("handler"))
    return h.join(r, "endpoint")


def method_edges(edges: DataFrame, method: str, types: list[str], limit: int | None = None) -> DataFrame:
    """Edges of the types that touch the method or what is inside it; letters of ids are compared folded."""
    inside = lambda c: (F.col(c) == method) | F.lower(c).startswith(f"{method.lower()}::")
    found = edges.where(F.col("type").isin(*types) & (inside("from_id") | inside("to_id"))).select("type", "from_id", "to_id", "call_type").orderBy("type", "from_id", "to_id", "call_type")
    return found if limit is None else found.limit(limit)


def field_intake(edges: DataFrame) -> DataFrame:
    """ASSIGNS and READS_FIELD edges, without reads of fields that are assigned."""
    assigned = edges.where("type = 'ASSIGNS' and startswith(from_id, 'request_field:')").select(F.col("from_id").alias("to_id")).distinct()
    return edges.where("type = 'ASSIGNS'").unionByName(edges.where("type = 'READS_FIELD'").join(assigned, "to_id", "left_anti").select(*edges.columns))


def field_flow(edges: DataFrame) -> DataFrame:
    """FLOWS_TO and ARGUMENT_TO edges, without flows that an argument edge of the same source and via repeats."""
    key = lambda df: df.withColumn("__via", F.coalesce("via", F.lit("")))
    arguments = edges.where("type = 'ARGUMENT_TO'")
    flows = key(edges.where("type = 'FLOWS_TO'")).join(key(arguments).select("from_id", "__via").distinct(), ["from_id", "__via"], "left_anti")
    return arguments.unionByName(flows.select(*edges.columns))


def prefer_concrete(targets: DataFrame) -> DataFrame:
    """Of targets (id, place) with one name after the last `::`, the first that isn't an interface's, else the first."""
    name = F.substring_index("id", "::", -1)
    order = Window.partitionBy("name").orderBy(F.col("id").contains("Interface"), "place")
    return targets.withColumn("name", name).withColumn("n", F.row_number().over(order)).where("n = 1").select("id").orderBy("id")


def framework(column: str) -> Column:
    return F.col(column).rlike(r"^(Illuminate|Symfony|Psr)\\") | F.col(column).rlike(r"\\Request::(all|input|get|has|filled|validate|only|except|merge)\b")


def without_framework(targets: DataFrame, column: str = "id") -> DataFrame:
    return targets.where(~framework(column))


def kinds_of_calls(edges: DataFrame, node: str) -> DataFrame:
    """How many edges of each kind leave a node."""
    return edges.where(F.col("from_id") == node).groupBy(F.coalesce("call_type", "type").alias("kind")).count().withColumnRenamed("count", "n").orderBy(F.desc("n"), "kind")


def unresolved_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Plain calls whose target isn't a node and which no resolved call names as via."""
    plain = edges.where(calls()).select("from_id", "to_id").distinct()
    resolved = edges.where("type = 'CALLS' and call_type is not null and via is not null").select("from_id", F.col("via").alias("to_id")).distinct()
    return plain.join(nodes.select(F.col("id").alias("to_id")), "to_id", "left_anti").join(resolved, ["from_id", "to_id"], "left_anti").select("from_id", "to_id")


def important_methods(nodes: DataFrame, edges: DataFrame, parent: str, limit: int = 10) -> DataFrame:
    """Methods of a class by the calls that they make and get."""
    own = nodes.where((F.col("type") == "method") & (F.col("parent") == parent)).select("id")
    plain = edges.where(calls()).select("from_id", "to_id")
    made = plain.join(own, plain.from_id == own.id).groupBy("id").agg(F.count("*").alias("outgoing"))
    got = plain.join(own, plain.to_id == own.id).groupBy("id").agg(F.count("*").alias("incoming"))
    both = own.join(got, "id", "left").join(made, "id", "left").select("id", F.coalesce("incoming", F.lit(0).cast("long")).alias("incoming"), F.coalesce("outgoing", F.lit(0).cast("long")).alias("outgoing"))
    return both.withColumn("score", F.col("incoming") + F.col("outgoing")).orderBy(F.desc("score"), "id").limit(limit)


def neighbours(edges: DataFrame, node: str, limit: int = 10) -> DataFrame:
    """Nodes next to a node by how many edges they share with it."""
    used = edges.where((F.col("to_id") == node) & calls()).select(F.col("from_id").alias("other"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    made = edges.where((F.col("from_id") == node) & calls()).select(F.col("to_id").alias("other"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    deps = edges.where((F.col("type") == "DEPENDS_ON") & ((F.col("from_id") == node) | (F.col("to_id") == node)))
    deps = deps.select(F.when(F.col("from_id") == node, F.col("to_id")).otherwise(F.col("from_id")).alias("other"), (F.col("to_id") == node).cast("int").alias("i"), (F.col("from_id") == node).cast("int").alias("o"))
    stats = used.unionByName(made).unionByName(deps).groupBy("other").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"), F.count("*").alias("score"))
    return stats.orderBy(F.desc("score"), "other").limit(limit)


# --- lookups for many nodes at once: targets is (target), and a limit holds for each of them


def _first(found: DataFrame, limit: int, *order: str) -> DataFrame:
    """The first rows of each target."""
    place = F.row_number().over(Window.partitionBy("target").orderBy(*order))
    return found.withColumn("n", place).where(F.col("n") <= limit).drop("n")


def lookup(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target's node; an unknown id has type `unknown`."""
    found = targets.join(nodes.withColumnRenamed("id", "target"), "target", "left")
    return found.withColumn("type", F.coalesce("type", F.lit("unknown")))


def relation_targets(nodes: DataFrame) -> DataFrame:
    """(id, target): where relations of a node are kept: a method's are its parent's."""
    return nodes.select("id", F.when(F.col("type") == "method", F.coalesce("parent", "id")).otherwise(F.col("id")).alias("target"))


def into(edges: DataFrame, targets: DataFrame, kinds: Column, limit: int = 20) -> DataFrame:
    """(target, from_id, type) of the edges of some kinds into each target, by source."""
    found = edges.where(kinds).select(F.col("to_id").alias("target"), "from_id", "type").distinct()
    return _first(found.join(targets, "target", "left_semi"), limit, "from_id")


def out_of(edges: DataFrame, targets: DataFrame, kinds: Column, limit: int = 20) -> DataFrame:
    """(target, to_id, type) of the edges of some kinds out of each target, by type and end."""
    found = edges.where(kinds).select(F.col("from_id").alias("target"), "to_id", "type").distinct()
    return _first(found.join(targets, "target", "left_semi"), limit, "type", "to_id")


def route_handlers(edges: DataFrame) -> DataFrame:
    """(endpoint, handler): the method that each endpoint is routed to, the smallest if several."""
    return edges.where("type = 'ROUTES_TO'").groupBy(F.col("from_id").alias("endpoint")).agg(F.min("to_id").alias("handler"))


def route_entries(edges: DataFrame, endpoints: DataFrame, limit: int = 20) -> DataFrame:
    """(target, place, kind, from_id): clients that request each endpoint, then calls to its handler."""
    handlers = route_handlers(edges).join(endpoints.select(F.col("target").alias("endpoint")), "endpoint", "left_semi")
    clients = into(edges, endpoints, F.col("type") == "HTTP_REQUEST", limit).select("target", F.lit(0).alias("place"), F.lit("http_client").alias("kind"), "from_id")
    called = edges.where(calls()).select(F.col("to_id").alias("handler"), "from_id").distinct().join(handlers, "handler").select(F.col("endpoint").alias("target"), F.lit(1).alias("place"), F.lit("call").alias("kind"), "from_id")
    return _first(clients.unionByName(called), limit, "place", "from_id")


def implementations(nodes: DataFrame, edges: DataFrame, methods: DataFrame) -> DataFrame:
    """(target, implementation): of an interface's method, that of the first class, by id, that implements and has it."""
    face, name = F.expr("left(target, length(target) - length(substring_index(target, '::', -1)) - 2)"), F.substring_index("target", "::", -1)
    asked = methods.select("target", face.alias("face"), name.alias("name")).where("face <> ''")
    owners = edges.where("type = 'IMPLEMENTS'").select(F.col("to_id").alias("face"), F.col("from_id").alias("owner"))
    found = asked.join(owners, "face").withColumn("id", F.concat_ws("::", "owner", "name")).join(nodes.where("type = 'method'").select("id"), "id", "left_semi")
    return found.groupBy("target").agg(F.min_by("id", "owner").alias("implementation"))


def _inside(edges: DataFrame, targets: DataFrame, kinds: list[str]) -> DataFrame:
    """Edges of the kinds with the target, and its letters folded as `opening`, that either end is or is inside of; an end is joined by each opening of its id that
    `::` closes, letters folded."""
    openings = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(F.col(c), "::"))), lambda n: F.lower(F.array_join(F.slice(F.split(F.col(c), "::"), F.lit(1), n), "::")))
    kept = edges.where(F.col("type").isin(*kinds))
    ends = kept.withColumn("opening", F.explode(F.array_distinct(F.concat(openings("from_id"), openings("to_id")))))
    return ends.join(targets.select("target", F.lower("target").alias("opening")).distinct(), "opening")


def contexts(nodes: DataFrame, edges: DataFrame, targets: DataFrame, limit: int = 20) -> DataFrame:
    """(target, section, place, from_id, to_id): what surrounds each method: `route`, `view`, `entry` (calls, then routes, then
    views), `upstream` (clients of its routes), `intake`, `flow`, `validates`, `persists`, `config`.

    Edges meet the targets in two joins, one by their ends and one by what their ends are inside of; all that follows stays
    where these have put the rows.
    """
    targets = targets.select("target").distinct()
    kind, label = F.col("type"), F.col("section")
    row = lambda section, target: F.when(section.isNotNull(), F.struct(F.col(target).alias("target"), section.alias("section")))
    into = F.when(kind == "ROUTES_TO", "route").when(kind == "BLADE_USES_ACTION", "view").when(calls(), "entry")
    out_of = F.when(kind.isin("VALIDATES", "VALIDATES_FIELD"), "validates").when(kind == "PERSISTS", "persists").when(kind == "REFERENCES", "config")
    each = F.array_compact(F.array(row(into, "to_id"), row(out_of, "from_id")))
    direct = edges.select("type", "from_id", "to_id", F.explode(each).alias("x")).select("x.target", "x.section", "type", "from_id", "to_id")
    requests = edges.where("type = 'HTTP_REQUEST'").select(F.col("from_id").alias("client"), F.col("to_id").alias("endpoint"))
    routed = edges.where("type = 'ROUTES_TO'").select(F.col("to_id").alias("target"), F.col("from_id").alias("endpoint"))
    upstream = routed.join(requests, "endpoint").select("target", F.lit("upstream").alias("section"), F.lit("").alias("type"), F.col("client").alias("from_id"), F.col("endpoint").alias("to_id"))
    first = lambda df, *order: df.withColumn("n", F.row_number().over(Window.partitionBy(*order[0]).orderBy(*order[1:]))).where(F.col("n") <= limit)
    met = direct.unionByName(upstream).join(targets, "target").distinct()
    met = first(met, ["target", "section"], "type", "from_id", "to_id")
    # routes and views are entries too, behind the calls
    places = F.when(label.isin("route", "view"), F.array(F.struct(label, F.lit(0).alias("place")), F.struct(F.lit("entry").alias("section"), F.when(label == "route", 1).otherwise(2).alias("place")))).otherwise(F.array(F.struct(label, F.lit(0).alias("place"))))
    met = met.select("target", F.explode(places).alias("x"), "type", "from_id", "to_id").select("target", "x.section", "x.place", "type", "from_id", "to_id")
    met = first(met, ["target", "section"], "place", "type", "from_id", "to_id")
    # what is assigned isn't told as read, and what is an argument isn't told as flowing
    inside = _inside(edges, targets, ["ASSIGNS", "READS_FIELD", "FLOWS_TO", "ARGUMENT_TO"])
    flows = kind.isin("FLOWS_TO", "ARGUMENT_TO")
    inside = inside.select("opening", "target", F.when(flows, "flow").otherwise("intake").alias("section"), "type", "from_id", "to_id", F.when(flows, F.coalesce("via", F.lit(""))).alias("via")).distinct()
    same = F.when(flows | (kind == "ASSIGNS") & F.col("from_id").startswith("request_field:"), F.col("from_id")).when(kind == "READS_FIELD", F.col("to_id"))
    told = F.max(kind.isin("ASSIGNS", "ARGUMENT_TO")).over(Window.partitionBy("opening", "target", "section", "same", "via"))
    inside = inside.withColumn("same", same).withColumn("told", told).where(kind.isin("ASSIGNS", "ARGUMENT_TO") | ~F.col("told"))
    inside = first(inside, ["opening", "target", "section"], "type", "from_id", "to_id").withColumn("place", F.lit(0))
    columns = ["target", "section", "place", "from_id", "to_id"]
    return met.select(*columns).unionByName(inside.select(*columns))


def class_contexts(nodes: DataFrame, edges: DataFrame, classes: DataFrame, limit: int = 20) -> DataFrame:
    """The same for classes: what surrounds the first 8 methods of each, repeats once."""
    owned = _first(nodes.where("type = 'method'").select(F.col("parent").alias("target"), "id").join(classes.select("target").distinct(), "target", "left_semi"), 8, "id")
    found = contexts(nodes, edges, owned.select(F.col("id").alias("target")), max(5, limit // 2)).withColumnRenamed("target", "id")
    found = found.join(owned, "id").groupBy("target", "section", "place", "from_id", "to_id").agg(F.min("id").alias("id"))
    place = F.row_number().over(Window.partitionBy("target", "section").orderBy("place", "id", "from_id", "to_id"))
    return found.withColumn("n", place).where(F.col("n") <= limit).select("target", "section", "place", "from_id", "to_id")


def entry_counts(context: DataFrame) -> DataFrame:
    """(target, section, n) of the sections that have rows."""
    return context.groupBy("target", "section").agg(F.count("*").alias("n"))


# What a context that lacks something is told.
WARNINGS = {
    "entry": "No CALLS, ROUTES_TO, or BLADE_USES_ACTION entry — symbol may be unreachable, externally invoked, or missing route extraction.",
    "route": "No ROUTES_TO or BLADE_USES_ACTION edges — HTTP/view entry for this controller action is unknown in the graph.",
    "intake": "No ASSIGNS/request_field edges — request field intake not traced for this action.",
    "flow": "No FLOWS_TO/ARGUMENT_TO into callees — DTO/field propagation to service calls may be incomplete.",
}


def warnings(edges: DataFrame, targets: DataFrame, context: DataFrame) -> DataFrame:
    """(target, warning) of what a target's context lacks."""
    has = lambda *sections: F.coalesce(F.max(F.col("section").isin(*sections)), F.lit(False))
    callees = edges.where(calls()).select(F.col("from_id").alias("target"), F.lit("callee").alias("section")).join(targets, "target", "left_semi").distinct()
    known = context.select("target", "section").distinct().unionByName(callees).groupBy("target").agg(has("entry", "route", "view").alias("entered"), has("route", "view").alias("routed"), has("intake").alias("taken"), has("flow").alias("flows"), has("callee").alias("calls"))
    rows = targets.select("target").distinct().join(known, "target", "left").na.fill(False)
    controller = F.lower("target").contains("controller")
    lacks = {"entry": ~F.col("entered"), "route": controller & ~F.col("routed"), "intake": controller & ~F.col("taken"), "flow": F.col("calls") & ~F.col("flows") & F.col("taken")}
    return rows.select("target", F.explode(F.array_compact(F.array(*(F.when(holds, WARNINGS[k]) for k, holds in lacks.items())))).alias("warning"))


def suggested(edges: DataFrame, targets: DataFrame, context: DataFrame, most: int = 12) -> DataFrame:
    """(target, place, label): where to look next: routes, views, callees, fields taken in, flows, what is kept; each label once."""
    callees = out_of(edges, targets, calls()).select("target", F.lit("callee").alias("section"), F.lit(0).alias("place"), F.col("target").alias("from_id"), "to_id")
    every = context.unionByName(callees)
    step = F.when(F.col("section").isin("route", "view"), F.array("from_id")).when(F.col("section") == "intake", F.array("from_id", "to_id")).when(F.col("section").isin("callee", "flow", "persists"), F.array("to_id"))
    turn = F.create_map(*(F.lit(x) for i, s in enumerate(("route", "view", "callee", "intake", "flow", "persists")) for x in (s, i)))
    steps = every.where(step.isNotNull()).select("target", turn[F.col("section")].alias("turn"), "from_id", "to_id", F.posexplode(step).alias("at", "id"))
    steps = steps.select("target", short_label(F.col("id")).alias("label"), F.struct("turn", "from_id", "to_id", "at").alias("order")).groupBy("target", "label").agg(F.min("order").alias("order"))
    place = F.row_number().over(Window.partitionBy("target").orderBy("order"))
    return steps.withColumn("place", place).where(F.col("place") <= most).select("target", "place", "label")
