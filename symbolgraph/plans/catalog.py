"""The registered queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolgraph.functions.graph import short_label
from symbolgraph.operators import architecture, cycles, deadcode, hierarchy, hotspots, impact, navigation, report, resolve, search, ticket
from symbolgraph.plans.projection import SQL, event_pairs, graph
from symbolgraph.sources import scan, store
from symbolgraph.sources.store import Graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SERVICE = "App\\Services\\N1Service"
CONTROLLER = "App\\Http\\Controllers\\N1Controller"


_GRAPHS: dict[tuple[str, str], Graph] = {}


def stored_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The projection of a folder of tables, built once a session and kept in memory and on disk, as a loaded graph is."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GRAPHS:
        g = graph(spark, sf_dir)
        g.nodes, g.edges = g.nodes.persist(), g.edges.persist()
        _GRAPHS[key] = g
    return _GRAPHS[key]


def query(sql: str, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{SQL}\n{sql}" if not sql.startswith("WITH") else sql
        return f

    return add


def on_graph(sql: str, recursive: bool = False):
    """A query over (nodes, edges) of the projection."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            g = stored_graph(spark, sf_dir)
            return f(g.nodes, g.edges)

        run.__name__ = f.__name__
        return query(sql, recursive)(run)

    return add


def some(nodes: DataFrame, kind: str, parent_like: str) -> str:
    """The smallest id of a kind: a node that every scale has."""
    return nodes.where((F.col("type") == kind) & F.col("id").contains(parent_like)).agg(F.min("id")).first()[0]


_METHOD = "(SELECT min(id) FROM nodes WHERE type = 'method' AND contains(id, 'Services'))"
_USED = "(SELECT min(id) FROM nodes WHERE type = 'method' AND contains(id, 'Controllers'))"


@on_graph("SELECT type, call_type, count(*) AS n FROM edges GROUP BY type, call_type")
def projection_counts(nodes, edges):
    return edges.groupBy("type", "call_type").agg(F.count("*").alias("n"))


@on_graph("SELECT type, count(*) AS n, count(parent) AS with_parent FROM nodes GROUP BY type")
def node_counts(nodes, edges):
    return nodes.groupBy("type").agg(F.count("*").alias("n"), F.count("parent").alias("with_parent"))


@on_graph(f"SELECT e.from_id, e.call_type, n.type AS node_type, n.file FROM calls e LEFT JOIN nodes n ON n.id = e.from_id WHERE e.to_id = {_METHOD} ORDER BY e.from_id, coalesce(e.call_type, '') LIMIT 20")
def incoming_calls(nodes, edges):
    return navigation.incoming_calls(nodes, edges, some(nodes, "method", "Services")).drop("via")


@on_graph(f"SELECT e.to_id, e.call_type, n.type AS node_type, n.file FROM edges e LEFT JOIN nodes n ON n.id = e.to_id WHERE e.type = 'CALLS' AND e.from_id = {_USED} ORDER BY e.to_id, coalesce(e.call_type, '') LIMIT 20")
def outgoing_calls(nodes, edges):
    return navigation.outgoing_calls(nodes, edges, some(nodes, "method", "Controllers"), resolved=True).drop("via")


@on_graph(r"""SELECT * FROM (SELECT 'out' AS direction, to_id AS other FROM edges WHERE type = 'DEPENDS_ON' AND from_id = 'App\Http\Controllers\N1Controller' ORDER BY 2 LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'in', from_id FROM edges WHERE type = 'DEPENDS_ON' AND to_id = 'App\Http\Controllers\N1Controller' ORDER BY 2 LIMIT 20)""")
def depends_on_relations(nodes, edges):
    return navigation.dependencies(edges, CONTROLLER)


@on_graph(r"SELECT id, name, visibility FROM nodes WHERE type = 'method' AND parent = 'App\Services\N1Service'")
def methods_of_class(nodes, edges):
    return navigation.methods_of(nodes, SERVICE)


@on_graph(f"""SELECT place, kind, from_id FROM (
SELECT * FROM (SELECT DISTINCT 0 AS place, 'call' AS kind, from_id FROM calls WHERE to_id = {_USED} ORDER BY from_id LIMIT 20)
UNION ALL SELECT * FROM (SELECT DISTINCT 1, 'route', from_id FROM edges WHERE type = 'ROUTES_TO' AND to_id = {_USED} ORDER BY from_id LIMIT 20)
UNION ALL SELECT * FROM (SELECT DISTINCT 2, 'blade', from_id FROM edges WHERE type = 'BLADE_USES_ACTION' AND to_id = {_USED} ORDER BY from_id LIMIT 20)) ORDER BY place, from_id LIMIT 20""")
def incoming_graph_entries(nodes, edges):
    return navigation.incoming_entries(edges, some(nodes, "method", "Controllers"))


@on_graph("""SELECT h.from_id AS client, h.to_id AS endpoint, r.to_id AS handler FROM (SELECT DISTINCT parent AS from_id, 'api:GET:/orders/1/O' AS to_id FROM nodes WHERE type = 'method' AND contains(id, 'Controllers')) h
JOIN edges r ON r.from_id = h.to_id AND r.type = 'ROUTES_TO'""")
def http_upstream(nodes, edges):
    clients = nodes.where("type = 'method'").where(F.col("id").contains("Controllers"))
    requests = clients.select(F.col("parent").alias("from_id"), F.lit("api:GET:/orders/1/O").alias("to_id"), F.lit("HTTP_REQUEST").alias("type")).distinct()
    return navigation.upstream_requests(edges.select("from_id", "to_id", "type").unionByName(requests)).select("client", "endpoint", "handler")


@on_graph(r"""SELECT type, from_id, to_id, call_type FROM edges WHERE type IN ('CALLS', 'CONTAINS', 'ROUTES_TO') AND (from_id = 'App\Services\N1Service' OR to_id = 'App\Services\N1Service' OR starts_with(lower(from_id), lower('App\Services\N1Service::')) OR starts_with(lower(to_id), lower('App\Services\N1Service::')))""")
def method_scoped_edges(nodes, edges):
    return navigation.method_edges(edges, SERVICE, ["CALLS", "CONTAINS", "ROUTES_TO"])


@on_graph(f"SELECT coalesce(call_type, type) AS kind, count(*) AS n FROM edges WHERE from_id = {_USED} GROUP BY 1")
def call_kind_counts(nodes, edges):
    return navigation.kinds_of_calls(edges, some(nodes, "method", "Controllers"))


@on_graph("""SELECT DISTINCT c.from_id, c.to_id FROM calls c JOIN nodes a ON a.id = c.from_id LEFT JOIN (SELECT * FROM nodes WHERE NOT (type = 'method' AND visibility = 'private')) n ON n.id = c.to_id WHERE n.id IS NULL""")
def unresolved_calls(nodes, edges):
    return navigation.unresolved_calls(nodes.where("not (type = 'method' and visibility = 'private')"), edges)


@on_graph(r"""SELECT m.id, coalesce(i.n, 0) AS incoming, coalesce(o.n, 0) AS outgoing, coalesce(i.n, 0) + coalesce(o.n, 0) AS score FROM (SELECT id FROM nodes WHERE type = 'method' AND parent = 'App\Services\N1Service') m
LEFT JOIN (SELECT to_id, count(*) AS n FROM calls GROUP BY 1) i ON i.to_id = m.id LEFT JOIN (SELECT from_id, count(*) AS n FROM calls GROUP BY 1) o ON o.from_id = m.id ORDER BY score DESC, m.id LIMIT 10""")
def important_methods(nodes, edges):
    return navigation.important_methods(nodes, edges, SERVICE)


@on_graph(f"""SELECT other, CAST(sum(i) AS BIGINT) AS incoming, CAST(sum(o) AS BIGINT) AS outgoing, count(*) AS score FROM (
SELECT from_id AS other, 1 AS i, 0 AS o FROM calls WHERE to_id = {_METHOD} UNION ALL SELECT to_id, 0, 1 FROM calls WHERE from_id = {_METHOD}) GROUP BY other ORDER BY score DESC, other LIMIT 10""")
def neighbour_stats(nodes, edges):
    return navigation.neighbours(edges, some(nodes, "method", "Services"))


@on_graph(r"""SELECT id, CASE WHEN starts_with(id, 'api:') THEN regexp_replace(replace(id, 'api:', ''), '^([A-Z]+):', '\1 ') ELSE regexp_extract(id, '[^\\]+$') END AS label FROM nodes""")
def short_labels(nodes, edges):
    return nodes.select("id", short_label(F.col("id")).alias("label"))


@on_graph("""SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY regexp_extract(id, '[^:]+$') ORDER BY contains(id, 'Interface'), id) AS n FROM nodes WHERE type = 'method') WHERE n = 1""")
def prefer_concrete(nodes, edges):
    return navigation.prefer_concrete(nodes.where("type = 'method'").select("id", F.col("id").alias("place")))


@on_graph(r"""SELECT id, type, name, CAST(CASE WHEN id = 'N1Service' THEN 1000 WHEN ends_with(lower(id), '\n1service') OR ends_with(lower(id), '::n1service') THEN 900 WHEN lower(name) = 'n1service' THEN 850 WHEN contains(lower(id), 'n1service') THEN 700
 WHEN contains(lower(name), 'n1service') THEN 600 ELSE 400 END AS BIGINT) AS score FROM nodes WHERE type IN ('class', 'method', 'interface', 'trait', 'vue_component', 'js_module', 'blade_view', 'property', 'parameter')
 AND (contains(lower(id), 'n1service') OR contains(lower(name), 'n1service') OR contains(lower(coalesce(file, '')), 'n1service')) ORDER BY score DESC, id LIMIT 40""")
def find_symbol(nodes, edges):
    return search.find(nodes, "N1Service", limit=40)


@on_graph("""SELECT id, type, name, CAST(300 AS BIGINT) AS score FROM nodes WHERE type IN ('api_endpoint', 'route_name') AND (contains(lower(id), 'get:/orders/1') OR contains(lower(id), '/orders/1')) ORDER BY id LIMIT 20""")
def find_route(nodes, edges):
    return search.find(nodes, "GET /orders/1")


@on_graph(r"""SELECT id, type, name, CAST(CASE WHEN id = 'App\Services\N1Service' THEN 1000 ELSE 700 END AS BIGINT) AS score FROM nodes WHERE type IN ('request_field', 'model_field', 'response_field', 'variable_field') AND contains(lower(id), lower('App\Services\N1Service')) OR id = 'App\Services\N1Service'""")
def find_exact_promotion(nodes, edges):
    return search.find(nodes, SERVICE, kind="field")


_HUB = "(SELECT min(id) FROM nodes WHERE type = 'method' AND contains(id, 'Repositories'))"
_IMPACT = """imp AS (SELECT from_id, to_id, type, CASE type WHEN 'CALLS' THEN 5 WHEN 'EXTENDS' THEN 3 WHEN 'IMPLEMENTS' THEN 2 WHEN 'ROUTES_TO' THEN 5 ELSE 4 END AS w,
  CASE type WHEN 'CALLS' THEN 2 WHEN 'EXTENDS' THEN 3 WHEN 'IMPLEMENTS' THEN 2 ELSE 0 END AS wo FROM edges WHERE type IN ('EXTENDS', 'IMPLEMENTS', 'ROUTES_TO', 'BLADE_USES_ACTION') OR (type = 'CALLS' AND (call_type IS NULL OR call_type <> 'INTERFACE_RESOLVED'))),"""


def _levels(seeds: str, depth: int) -> str:
    out = [f"seeds AS ({seeds}), f0 AS (SELECT seed, seed AS node FROM seeds)"]
    for d in range(1, depth + 1):
        out.append(f"l{d} AS (SELECT f.seed, i.from_id, i.type, {d} AS distance, i.w * power(0.6, {d - 1}) AS w FROM f{d - 1} f JOIN imp i ON i.to_id = f.node WHERE i.from_id <> f.seed)")
        seen = " UNION ALL ".join(f"SELECT seed, node FROM f{k}" for k in range(d))
        out.append(f"f{d} AS (SELECT DISTINCT l.seed, l.from_id AS node FROM l{d} l WHERE NOT EXISTS (SELECT 1 FROM ({seen}) v WHERE v.seed = l.seed AND v.node = l.from_id))")
    union = " UNION ALL ".join(f"SELECT * FROM l{d}" for d in range(1, depth + 1))
    out.append(f"""callers AS (SELECT seed, from_id, round(sum(w), 2) AS score, min(distance) AS distance, min_by(type, distance || type) AS relation FROM ({union}) GROUP BY seed, from_id),
callees AS (SELECT seed, to_id, CAST(sum(wo) AS DOUBLE) AS score FROM seeds JOIN imp ON from_id = seed GROUP BY 1, 2)""")
    return ", ".join(out)


def _impact_sql(select: str, seeds: str, depth: int) -> str:
    return f", {_IMPACT} {_levels(seeds, depth)} {select}"


def _impact(nodes, edges, depth):
    seed = nodes.where("type = 'method'").where(F.col("id").contains("Repositories")).agg(F.min("id").alias("seed"))
    return impact.callers(impact.upstream(impact.impact_edges(edges), seed, depth)).select("from_id", "score", "distance", "relation").orderBy(F.desc("score"), "distance", "from_id").limit(50)


_TOP = "SELECT from_id, score, distance, relation FROM callers ORDER BY score DESC, distance, from_id LIMIT 50"


@on_graph(_impact_sql(_TOP, f"SELECT {_HUB} AS seed", 2).replace("edges", "edges"))
def impact_depth2(nodes, edges):
    return _impact(nodes, edges, 2)


@on_graph(_impact_sql(_TOP, f"SELECT {_HUB} AS seed", 3))
def impact_depth3(nodes, edges):
    return _impact(nodes, edges, 3)


_REPORT = """, c AS (SELECT seed, count(*) AS callers, count(*) FILTER (WHERE distance = 1 AND relation IN ('ROUTES_TO', 'BLADE_USES_ACTION')) AS direct_entries, count(*) FILTER (WHERE distance = 1 AND relation NOT IN ('ROUTES_TO', 'BLADE_USES_ACTION')) AS direct_callers,
 count(*) FILTER (WHERE distance > 1) AS indirect_callers, coalesce(sum(score) FILTER (WHERE distance = 1), 0) AS direct_score, coalesce(sum(score) FILTER (WHERE distance > 1), 0) AS indirect_score FROM callers GROUP BY seed),
b AS (SELECT seed, count(*) AS callees, sum(score) AS callee_score FROM callees GROUP BY seed),
t AS (SELECT seed, from_id AS id FROM callers UNION SELECT seed, to_id FROM callees UNION SELECT seed, seed FROM seeds),
fl AS (SELECT seed, count(DISTINCT file) AS files FROM t JOIN nodes USING (id) GROUP BY seed),
r AS (SELECT s.seed, coalesce(callers, 0) AS callers, coalesce(direct_entries, 0) AS direct_entries, coalesce(direct_callers, 0) AS direct_callers, coalesce(indirect_callers, 0) AS indirect_callers, round(coalesce(direct_score, 0), 2) AS direct_score, round(coalesce(indirect_score, 0), 2) AS indirect_score,
 coalesce(callees, 0) AS callees, coalesce(callee_score, 0) AS callee_score, coalesce(files, 0) AS files FROM seeds s LEFT JOIN c USING (seed) LEFT JOIN b USING (seed) LEFT JOIN fl USING (seed)),
rep AS (SELECT *, round(direct_score + indirect_score + callee_score, 2) AS score FROM r)
"""
_RISK = "CASE WHEN score >= 40 THEN 'CRITICAL' WHEN score >= 20 THEN 'HIGH' WHEN score >= 8 THEN 'MEDIUM' ELSE 'LOW' END"
_SEEDS = "SELECT id AS seed FROM nodes WHERE type = 'method' AND contains(id, 'Repositories')"


@on_graph(_impact_sql(f"{_REPORT} SELECT *, {_RISK} AS risk FROM rep", _SEEDS, 2))
def impact_components(nodes, edges):
    seeds = nodes.where("type = 'method'").where(F.col("id").contains("Repositories")).select(F.col("id").alias("seed"))
    rounded = {c: F.round(c, 2) for c in ("direct_score", "indirect_score")}
    return impact.report(nodes, impact.impact_edges(edges), seeds).withColumns(rounded)


_IMPACT_ALL = """imp AS (SELECT from_id, to_id, type, CASE type WHEN 'CALLS' THEN 5 WHEN 'DEPENDS_ON' THEN 4 WHEN 'EXTENDS' THEN 3 WHEN 'IMPLEMENTS' THEN 2 WHEN 'ROUTES_TO' THEN 5 WHEN 'BLADE_USES_ACTION' THEN 4 END AS w,
  CASE type WHEN 'CALLS' THEN 2 WHEN 'DEPENDS_ON' THEN 2 WHEN 'EXTENDS' THEN 3 WHEN 'IMPLEMENTS' THEN 2 ELSE 0 END AS wo FROM edges WHERE type IN ('EXTENDS', 'IMPLEMENTS', 'ROUTES_TO', 'BLADE_USES_ACTION', 'DEPENDS_ON') OR (type = 'CALLS' AND (call_type IS NULL OR call_type <> 'INTERFACE_RESOLVED'))),"""
_ANY = "SELECT id AS seed FROM nodes WHERE type IN ('method', 'class', 'interface')"
_SUMMARY = f"""SELECT s.seed, coalesce(direct_callers, 0) AS direct_callers, coalesce(call_chain_callers, 0) AS call_chain_callers, coalesce(direct_entries, 0) AS direct_entries, coalesce(indirect_callers, 0) AS indirect_callers, coalesce(callers, 0) AS callers,
 coalesce(direct_score, 0) AS direct_score, coalesce(indirect_score, 0) AS indirect_score, coalesce(into_n, 0) + coalesce(out_n, 0) AS inspected_edges, coalesce(callees, 0) AS callees, coalesce(dl, 0) + coalesce(odl, 0) AS dependency_links, coalesce(il, 0) + coalesce(oil, 0) AS inheritance_links,
 coalesce(cs, 0) AS callee_score, impacted_nodes, affected_files, round(coalesce(ds, 0) + coalesce(ods, 0), 2) AS dependency_score, round(coalesce(ins, 0) + coalesce(oins, 0), 2) AS inheritance_score,
 round(coalesce(direct_score, 0) + coalesce(indirect_score, 0) + coalesce(cs, 0), 2) AS score, {_RISK} AS risk FROM seeds s
 LEFT JOIN (SELECT seed, count(*) FILTER (WHERE distance = 1) AS direct_callers, count(*) FILTER (WHERE distance = 1 AND relation = 'CALLS') AS call_chain_callers, count(*) FILTER (WHERE distance = 1 AND relation IN ('ROUTES_TO', 'BLADE_USES_ACTION')) AS direct_entries,
  count(*) FILTER (WHERE distance > 1) AS indirect_callers, count(*) AS callers FROM callers GROUP BY 1) USING (seed)
 LEFT JOIN (SELECT seed, round(coalesce(sum(w) FILTER (WHERE distance = 1), 0), 2) AS direct_score, round(coalesce(sum(w) FILTER (WHERE distance = 2), 0), 2) AS indirect_score, sum(w) FILTER (WHERE type = 'DEPENDS_ON') AS ds, sum(w) FILTER (WHERE type IN ('EXTENDS', 'IMPLEMENTS')) AS ins FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) GROUP BY 1) USING (seed)
 LEFT JOIN (SELECT seed, count(*) AS into_n, count(DISTINCT i.from_id || '>' || i.to_id) FILTER (WHERE i.type = 'DEPENDS_ON' AND i.from_id <> seed) AS dl, count(DISTINCT i.from_id || '>' || i.to_id || i.type) FILTER (WHERE i.type IN ('EXTENDS', 'IMPLEMENTS') AND i.from_id <> seed) AS il FROM (SELECT * FROM f0 UNION ALL SELECT * FROM f1) f JOIN imp i ON i.to_id = f.node GROUP BY 1) USING (seed)
 LEFT JOIN (SELECT from_id AS seed, count(*) AS out_n, count(DISTINCT to_id) AS callees, count(DISTINCT to_id) FILTER (WHERE type = 'DEPENDS_ON') AS odl, count(DISTINCT to_id || type) FILTER (WHERE type IN ('EXTENDS', 'IMPLEMENTS')) AS oil, sum(wo) AS cs, sum(wo) FILTER (WHERE type = 'DEPENDS_ON') AS ods, sum(wo) FILTER (WHERE type IN ('EXTENDS', 'IMPLEMENTS')) AS oins FROM imp GROUP BY 1) USING (seed)
 JOIN (SELECT seed, count(DISTINCT id) FILTER (WHERE hit) AS impacted_nodes, count(DISTINCT file) AS affected_files FROM (SELECT seed, from_id AS id, true AS hit FROM callers UNION ALL SELECT seed, to_id, true FROM callees UNION ALL SELECT seed, seed, false FROM seeds) LEFT JOIN nodes USING (id) GROUP BY 1) USING (seed)"""


def _all_impact_sql(select: str) -> str:
    return f", {_IMPACT_ALL} {_levels(_ANY, 2)} {select}"


def _any_seed(nodes):
    return nodes.where(F.col("type").isin("method", "class", "interface")).select(F.col("id").alias("seed"))


@on_graph(_all_impact_sql(_SUMMARY))
def impact_summary(nodes, edges):
    return impact.summary(nodes, impact.impact_edges(edges, dependencies=True), _any_seed(nodes))


@on_graph(_all_impact_sql("""SELECT * FROM (SELECT seed, list, row_number() OVER (PARTITION BY seed, list ORDER BY score DESC, distance, id) AS rank, id, score, distance FROM
 (SELECT seed, unnest(['callers', 'impacted']) AS list, from_id AS id, score, distance FROM callers UNION ALL SELECT seed, unnest(['callees', 'impacted']), to_id, score, 1 FROM callees)) WHERE rank <= 8"""))
def impact_top_lists(nodes, edges):
    return impact.top_lists(impact.impact_edges(edges, dependencies=True), _any_seed(nodes))


@on_graph(_impact_sql("SELECT c.seed, file, count(*) AS callers, round(sum(score), 2) AS score FROM callers c JOIN nodes n ON n.id = c.from_id WHERE file IS NOT NULL GROUP BY 1, 2", f"SELECT {_HUB} AS seed", 2))
def impact_files(nodes, edges):
    seed = nodes.where("type = 'method'").where(F.col("id").contains("Repositories")).agg(F.min("id").alias("seed"))
    return impact.affected_files(nodes, impact.impact_edges(edges), seed)


_DEGREES = """deg AS (SELECT n.id, n.type, n.parent, coalesce(i.n, 0) AS incoming, coalesce(o.n, 0) AS outgoing FROM nodes n
 LEFT JOIN (SELECT to_id, count(*) AS n FROM edges WHERE (type = 'CALLS' AND (call_type IS NULL OR call_type <> 'INTERFACE_RESOLVED')) OR type IN ('ROUTES_TO', 'BLADE_USES_ACTION') GROUP BY 1) i ON i.to_id = n.id
 LEFT JOIN (SELECT from_id, count(*) AS n FROM calls GROUP BY 1) o ON o.from_id = n.id)"""
_M = "SELECT id, incoming, outgoing, incoming + outgoing AS score FROM deg WHERE type = 'method' AND incoming + outgoing > 0"
_C = "SELECT CASE WHEN type = 'method' THEN parent ELSE id END AS id, CAST(sum(incoming) AS BIGINT) AS incoming, CAST(sum(outgoing) AS BIGINT) AS outgoing, CAST(sum(incoming) + sum(outgoing) AS BIGINT) AS score FROM deg WHERE type IN ('method', 'class') GROUP BY 1 HAVING sum(incoming) + sum(outgoing) > 0"


@on_graph(f", {_DEGREES} {_M} ORDER BY score DESC, id LIMIT 20")
def method_hotspots(nodes, edges):
    return hotspots.methods(nodes, edges)


@on_graph(f", {_DEGREES} {_C} ORDER BY score DESC, id LIMIT 20")
def class_hotspots(nodes, edges):
    return hotspots.classes(nodes, edges)


@on_graph("""SELECT id, incoming, outgoing, incoming + outgoing AS score FROM (SELECT n.id, coalesce(i.n, 0) AS incoming, coalesce(o.n, 0) AS outgoing FROM nodes n LEFT JOIN (SELECT to_id, count(*) AS n FROM edges WHERE type = 'DEPENDS_ON' GROUP BY 1) i ON i.to_id = n.id
LEFT JOIN (SELECT from_id, count(*) AS n FROM edges WHERE type = 'DEPENDS_ON' GROUP BY 1) o ON o.from_id = n.id) WHERE incoming + outgoing > 0 ORDER BY score DESC, id LIMIT 20""")
def dependency_hotspots(nodes, edges):
    return hotspots.depended_on(nodes, edges)


@on_graph(f", {_DEGREES} SELECT id, incoming, outgoing FROM deg WHERE outgoing > 0 ORDER BY outgoing DESC, id LIMIT 20")
def fanout_hotspots(nodes, edges):
    return hotspots.fan_out(nodes, edges)


_POOL = f"""cand AS (SELECT id, max(score) AS hotspot FROM (SELECT id, score FROM ({_M} ORDER BY score DESC, id LIMIT 400) UNION ALL SELECT id, score FROM ({_C} ORDER BY score DESC, id LIMIT 400)
 UNION ALL SELECT id, outgoing FROM (SELECT id, outgoing FROM deg WHERE outgoing > 0 ORDER BY outgoing DESC, id LIMIT 400)) GROUP BY id)"""


@on_graph(f", {_DEGREES}, {_POOL}, {_IMPACT} {_levels('SELECT id AS seed FROM cand', 2)} {_REPORT}, k AS (SELECT seed AS id, hotspot, score AS impact, {_RISK} AS risk, round(3 * score + hotspot, 2) AS combined FROM rep JOIN cand ON cand.id = rep.seed), "
"o AS (SELECT *, row_number() OVER (ORDER BY CASE risk WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END, combined DESC, hotspot DESC, id) AS rank FROM k) SELECT *, round(100.0 * rank / (SELECT count(*) FROM nodes), 2) AS percentile FROM o WHERE rank <= 20")
def risk_batch(nodes, edges):
    return hotspots.risk_ranking(nodes, edges)


@on_graph("""SELECT m.id, m.parent, m.file, CASE WHEN contains(m.parent, 'Controller') THEN 'medium' ELSE 'high' END AS confidence FROM nodes m
WHERE m.type = 'method' AND m.visibility = 'public' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.to_id = m.id AND e.type IN ('CALLS', 'ROUTES_TO', 'BLADE_CALLS', 'BLADE_USES_ACTION', 'BLADE_REFERENCES_SYMBOL'))""")
def dead_methods(nodes, edges):
    return deadcode.dead(nodes, edges)


# Layers, their segments and ranks, written out in the order in which they are tried.
_LAYER = lambda c: rf"""CASE WHEN regexp_matches(split_part({c}, '::', 1), '(^|\\)Infrastructure(\\|$)') THEN 'Infrastructure' WHEN regexp_matches(split_part({c}, '::', 1), '(^|\\)Domain(\\|$)') THEN 'Domain'
WHEN regexp_matches(split_part({c}, '::', 1), '(^|\\)Presentation(\\|$)') THEN 'Presentation' WHEN regexp_matches(split_part({c}, '::', 1), '(^|\\)Http(\\|$)') THEN 'Http' WHEN regexp_matches(split_part({c}, '::', 1), '(^|\\)Controllers?(\\|$)') THEN 'Controller'
WHEN regexp_matches(split_part({c}, '::', 1), '(^|\\)UseCases(\\|$)') THEN 'UseCases' WHEN regexp_matches(split_part({c}, '::', 1), '(^|\\)UseCase(\\|$)') THEN 'UseCase' WHEN regexp_matches(split_part({c}, '::', 1), '(^|\\)Services(\\|$)') THEN 'Services'
WHEN regexp_matches(split_part({c}, '::', 1), '(^|\\)Service(\\|$)') THEN 'Service' WHEN regexp_matches(split_part({c}, '::', 1), '(^|\\)Repositories(\\|$)') THEN 'Repositories' WHEN regexp_matches(split_part({c}, '::', 1), '(^|\\)Repository(\\|$)') THEN 'Repository' END"""  # noqa: E731
_RANK = lambda c: f"CASE {c} WHEN 'Presentation' THEN 0 WHEN 'Http' THEN 0 WHEN 'Controller' THEN 0 WHEN 'UseCase' THEN 1 WHEN 'UseCases' THEN 1 WHEN 'Service' THEN 2 WHEN 'Services' THEN 2 WHEN 'Repository' THEN 3 WHEN 'Repositories' THEN 3 WHEN 'Domain' THEN 4 WHEN 'Infrastructure' THEN 5 END"
_VIOLATIONS = f", lay AS (SELECT from_id, to_id, type, {_LAYER('from_id')} AS from_layer, {_LAYER('to_id')} AS to_layer FROM (SELECT * FROM calls UNION ALL SELECT * FROM edges WHERE type = 'DEPENDS_ON')), v AS (SELECT *, CASE WHEN type = 'DEPENDS_ON' THEN 'MEDIUM' ELSE 'HIGH' END AS severity FROM lay WHERE {_RANK('from_layer')} > {_RANK('to_layer')})"


@on_graph(_VIOLATIONS + " SELECT from_layer, to_layer, severity, count(*) AS n FROM v GROUP BY 1, 2, 3")
def architecture_layers(nodes, edges):
    return architecture.by_layer(architecture.violations(edges))


@on_graph(_VIOLATIONS + " SELECT from_id, to_id, type, severity FROM v WHERE NOT (regexp_matches(from_id, '^.*Brand1.*$'))")
def architecture_ignored(nodes, edges):
    found = architecture.violations(edges, ignore=["*Brand1* -> *"])
    return found.where("likely_false is null").select("from_id", "to_id", "type", "severity")


@on_graph(_VIOLATIONS + r" SELECT DISTINCT from_id, to_id, type FROM v WHERE split_part(from_id, '::', 1) = 'App\Services\N1Service' OR split_part(to_id, '::', 1) = 'App\Services\N1Service'")
def architecture_nodes(nodes, edges):
    ids = nodes.where((F.col("id") == SERVICE) | (F.col("parent") == SERVICE)).select("id")
    return architecture.of_nodes(architecture.violations(edges), ids).select("from_id", "to_id", "type")


# Edges between any two of these layers, dealt to the orders by their keys; the last name is of no layer.
_LAYER_NAMES = ("Presentation", "Http", "Controllers", "Controller", "UseCase", "UseCases", "Service", "Services", "Repository", "Repositories", "Domain", "Infrastructure", "Helpers")
_PAIR_EDGES = "WITH pair AS (SELECT DISTINCT 'App\\' || list_extract(names, CAST(o_orderkey % 13 AS INTEGER) + 1) || '\\C' || o_custkey || '::m' AS from_id, 'App\\' || list_extract(names, CAST(o_orderkey // 13 % 13 AS INTEGER) + 1) || '\\D' || o_custkey % 7 || '::m' AS to_id, CASE WHEN o_orderkey // 169 % 2 = 0 THEN 'CALLS' ELSE 'DEPENDS_ON' END AS type FROM (SELECT *, [" + ", ".join(f"'{n}'" for n in _LAYER_NAMES) + "] AS names FROM orders))".replace("\\\\", "\\")
_PATHS = """paths(a, b, path) AS (VALUES ('Infrastructure','Controller','Controller → Service → Repository ← Infrastructure'),('Infrastructure','UseCase','UseCase → Service → Repository ← Infrastructure'),('Infrastructure','Service','Service → Repository ← Infrastructure'),
('Infrastructure','Repository','Service → Repository ← Infrastructure'),('Domain','Controller','Controller → UseCase → Service → Domain'),('Domain','UseCase','UseCase → Service → Domain'),('Domain','Service','Service → Repository → Domain'),('Domain','Repository','Service → Repository → Domain'),
('Repository','Controller','Controller → Service → Repository'),('Repository','UseCase','UseCase → Service → Repository'),('Repository','Service','Service → Repository'),('Service','Controller','Controller → Service → Repository'),('Service','UseCase','UseCase → Service → Repository'),('UseCase','Controller','Controller → UseCase → Service → Repository'))"""
_SAME = lambda c: f"CASE {c} WHEN 'Presentation' THEN 'Controller' WHEN 'Http' THEN 'Controller' WHEN 'UseCases' THEN 'UseCase' WHEN 'Services' THEN 'Service' WHEN 'Repositories' THEN 'Repository' ELSE {c} END"


@query(f"""{_PAIR_EDGES}, {_PATHS}, lay AS (SELECT *, {_LAYER('from_id')} AS from_layer, {_LAYER('to_id')} AS to_layer FROM pair), v AS (SELECT * FROM lay WHERE {_RANK('from_layer')} > {_RANK('to_layer')})
SELECT from_id, to_id, type, CASE type WHEN 'CALLS' THEN 'HIGH' ELSE 'MEDIUM' END AS severity, from_layer || ' → ' || to_layer AS detected, from_layer || ' code should not ' || CASE type WHEN 'CALLS' THEN 'call' ELSE 'depend on' END || ' ' || to_layer || ' code.' AS reason, coalesce(path, to_layer || ' → ... → ' || from_layer) AS expected
FROM v LEFT JOIN paths ON a = {_SAME('from_layer')} AND b = {_SAME('to_layer')}""")
def architecture_pairs(spark, sf_dir):
    orders, names = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.array(*map(F.lit, _LAYER_NAMES))
    at = lambda k: F.element_at(names, (k % 13 + 1).cast("int"))
    key = F.col("o_orderkey")
    source = F.concat(F.lit("App\\"), at(key), F.lit("\\C"), "o_custkey", F.lit("::m"))
    target = F.concat(F.lit("App\\"), at(F.floor(key / 13)), F.lit("\\D"), F.col("o_custkey") % 7, F.lit("::m"))
    kind = F.when(F.floor(key / 169) % 2 == 0, "CALLS").otherwise("DEPENDS_ON")
    edges = orders.select(source.alias("from_id"), target.alias("to_id"), kind.alias("type"), F.lit(None).cast("string").alias("call_type")).distinct()
    return architecture.violations(edges).select("from_id", "to_id", "type", "severity", "detected", "reason", "expected")


# Queries by form, with the kind that each asks for.
_FORMS = (("api:GET:/", "route"), ("GET /", "route"), ("get user ", "symbol"), ("delete order ", "symbol"), ("patch\t/", "route"), ("request_field:a/get ", "field"), ("model_field:", "field"), ("config_key:a/get ", "config"), ("api/get-users ", "route"), ("api/getting ", "symbol"), ("Service\\get/", "route"), ("put", "symbol"))


@query("WITH q AS (SELECT p_partkey, CAST(p_partkey % 12 AS INTEGER) + 1 AS k, p_name FROM part) SELECT p_partkey AS id, list_extract([" + ", ".join(f"'{kind}'" for _, kind in _FORMS) + "], k) AS kind FROM q")
def find_kinds(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    form = F.element_at(F.array(*(F.lit(f) for f, _ in _FORMS)), (F.col("p_partkey") % 12 + 1).cast("int"))
    return part.select(F.col("p_partkey").alias("id"), search.kind_of(F.concat(form, F.replace("p_name", F.lit(" "), F.lit("_")))).alias("kind"))


@query("""WITH RECURSIVE p AS (SELECT DISTINCT event_type AS f, t FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events) WHERE t IS NOT NULL AND t <> event_type),
w AS (SELECT [f, t] AS path FROM p WHERE t > f UNION ALL SELECT list_append(path, p.t) FROM w JOIN p ON p.f = path[len(path)] WHERE p.t > path[1] AND NOT list_contains(path, p.t) AND len(path) < 12)
SELECT array_to_string(list_append(path, path[1]), '>') AS cycle, CAST(len(path) AS INTEGER) AS length FROM w JOIN p ON p.f = path[len(path)] AND p.t = path[1]""")
def cycles_events(spark, sf_dir):
    return cycles.simple_cycles(event_pairs(spark, sf_dir)).select(F.array_join("nodes", ">").alias("cycle"), "length")


@query("""WITH RECURSIVE p AS (SELECT DISTINCT event_type AS f, t FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events) WHERE t IS NOT NULL AND t <> event_type),
w AS (SELECT [f, t] AS path FROM p WHERE f = 'click' UNION ALL SELECT list_append(path, p.t) FROM w JOIN p ON p.f = path[len(path)] WHERE NOT list_contains(path, p.t) AND len(path) < 12)
SELECT array_to_string(list_append(path, path[1]), '>') AS cycle, CAST(len(path) AS INTEGER) AS length FROM w JOIN p ON p.f = path[len(path)] AND p.t = path[1]""")
def cycles_from_node(spark, sf_dir):
    return cycles.simple_cycles(event_pairs(spark, sf_dir), start="click").select(F.array_join("nodes", ">").alias("cycle"), "length")


_CLOSURE = ", up AS (SELECT from_id AS child, to_id AS ancestor, 1 AS depth FROM edges WHERE type = 'EXTENDS' UNION ALL SELECT u.child, e.to_id, depth + 1 FROM up u JOIN edges e ON e.type = 'EXTENDS' AND e.from_id = u.ancestor WHERE depth < 32)"


@on_graph(_CLOSURE + " SELECT child, ancestor, CAST(min(depth) AS INTEGER) AS depth FROM up GROUP BY 1, 2", recursive=True)
def inheritance_chain(nodes, edges):
    return hierarchy.closure(edges)


@on_graph(_CLOSURE + r" SELECT DISTINCT child FROM up WHERE ancestor = 'App\Http\Controllers\N1Controller'", recursive=True)
def descendants(nodes, edges):
    return hierarchy.closure(edges).where(F.col("ancestor") == CONTROLLER).select("child").distinct()


@on_graph(_CLOSURE + ", a AS (SELECT id AS child, id AS ancestor, 0 AS depth FROM nodes WHERE type = 'class' UNION ALL SELECT child, ancestor, min(depth) FROM up GROUP BY 1, 2) SELECT a.child AS cls, m.name, arg_min(m.id, lpad(CAST(a.depth AS VARCHAR), 3, '0') || m.id) AS target FROM a JOIN nodes m ON m.type = 'method' AND m.parent = a.ancestor GROUP BY 1, 2", recursive=True)
def resolve_inherited_method(nodes, edges):
    return hierarchy.resolve_method(nodes, edges)


@on_graph(r"""SELECT DISTINCT i.caller AS from_id, i.cls || '::' || i.m AS to_id, i.face || '::' || i.m AS via, 'INTERFACE_RESOLVED' AS call_type FROM (
SELECT c.from_id AS caller, x.from_id AS cls, x.to_id AS face, split_part(c.to_id, '::', 2) AS m FROM calls c JOIN edges x ON x.type = 'IMPLEMENTS' AND x.from_id = split_part(c.to_id, '::', 1) ) i""")
def interface_resolved(nodes, edges):
    # Plain calls to services' methods, seen through the interface: the classes that have the method are found again.
    owners = edges.where("type = 'IMPLEMENTS'").select(F.col("from_id").alias("owner"), F.col("to_id").alias("face"))
    to = edges.where("type = 'CALLS' and call_type is null").select("from_id", F.expr("substring_index(to_id, '::', 1)").alias("owner"), F.substring_index("to_id", "::", -1).alias("m"))
    seen = to.join(owners, "owner").select("from_id", F.concat_ws("::", "face", "m").alias("to_id"), F.lit("CALLS").alias("type"))
    found = resolve.interface_calls(nodes, seen.unionByName(edges.where("type = 'IMPLEMENTS'").select("from_id", "to_id", "type")))
    return found


@on_graph(", k AS (SELECT id, 'GET ' || regexp_replace(id, '^api:GET:/', '') AS key FROM nodes WHERE type = 'api_endpoint') SELECT id, key FROM k")
def endpoint_normalise(nodes, edges):
    return nodes.where("type = 'api_endpoint'").select("id", resolve.endpoint_key(F.col("id")).alias("key"))


# --- text


def on_table(name: str, sql: str):
    """A query over one of the driver's tables."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__ = f.__name__
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = run, sql
        return run

    return add


_STOP = ", ".join(f"'{w}'" for w in ticket.STOP)
_TOKENS = rf"list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9_\s-]', ' ', 'g'), '\s+'), lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ({_STOP})))"
_DF = f"df AS (SELECT token, count(*) AS df FROM (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) GROUP BY token)"
_NOISE = "('ott','available','availalble','currently','during','their','more','reliably','each','only','when','works','still','apply','behavior','new','true','false','red','bucket','arn','aws','eu-central-1','form','once','completed','added','called','indicates','after','than','longer','older','executed','notification','notifications','sent','minutes','ago','was','keep','remain','indefinitely','historical','intact','including')"
_LITTLE = "('content','contents','status','file','files','path','query','get','set','type','api','event','events','data','title','show','display','displays','add','job','page','view','item','cms','check','flag','url','string','example','https','accepts','existing','which','used','session','user','name','names','returns','stored','baseconfig','baseconfigid','authorization','required','update','patch','delete','given','when','then','feature','scenario','merge','layer','filters','filter','locale','device','category','skeleton','preview','values','forbidden','subject','permission','permissions','route','routes','jwt','redis','cache','invalidation','tests','scribe','operators','deploy','structure','fragments','object','inventory','overlay','emergency','hotfix')"
_ACTION = "('import','imported','parse','store','persist','mapping','map','overwrite','edited','manual','manually','missing','external','xml','feed','provider','category','categories','detail','tests','test','sync','webhook','queue','message','notify','notification','archive','archived','validate','deleted','delivered','recording','filepath','playback','contentids')"


def _weight(token: str, df: str) -> str:
    field = f"regexp_matches({token}, '[a-z][a-z0-9]*_?(id|time|type|category|status|name|code|flag|date|archived|enabled|disabled|visible|active)$')"
    step = f"CASE WHEN {df} <= 2 THEN 12 WHEN {df} <= 5 THEN 9 WHEN {df} <= 15 THEN 6 WHEN {df} <= 50 THEN 4 WHEN {df} <= 200 THEN 2 WHEN {df} <= 1000 THEN 1 ELSE 0.1 END"
    full = f"greatest({step}, CASE WHEN {field} THEN 10 ELSE 0 END, CASE WHEN {token} IN {_ACTION} THEN 4 ELSE 0 END)"
    return f"CAST(CASE WHEN {token} IN {_NOISE} THEN 0 WHEN {df} = 0 THEN CASE WHEN {field} THEN 8 WHEN {token} IN {_ACTION} THEN 4 ELSE 0 END WHEN {token} IN {_LITTLE} THEN least(0.1, {full}) ELSE {full} END AS DOUBLE)"


# The signals of workflows, written out: workflow, points, signal.
_SIGNALS = """sig(workflow, points, signal) AS (VALUES
('import',35,'nightly import'),('import',35,'xml feed'),('import',35,'csv import'),('import',35,'external provider'),('import',35,'import process'),('import',35,'data sync'),('import',15,'import'),('import',15,'imported'),('import',15,'feed'),('import',15,'provider'),('import',15,'transformer'),('import',15,'mapping'),('import',15,'ingest'),('import',15,'xml'),('import',15,'csv'),('import',15,'migrated'),('import',6,'parse'),('import',6,'sync'),('import',6,'batch'),
('api',35,'post api/'),('api',35,'put api/'),('api',35,'patch api/'),('api',35,'delete api/'),('api',35,'get api/'),('api',35,'request payload'),('api',35,'request body'),('api',15,'api'),('api',15,'payload'),('api',15,'response'),('api',15,'field'),('api',15,'property'),('api',15,'endpoint'),('api',6,'returns'),('api',6,'expose'),('api',6,'contract'),
('queue',35,'sqs message'),('queue',35,'queue message'),('queue',35,'consume the sqs'),('queue',35,'sqs event'),('queue',15,'sqs'),('queue',15,'queue'),('queue',15,'consumer'),('queue',15,'listener'),('queue',15,'message'),('queue',15,'filepath'),('queue',15,'bucket'),('queue',6,'event received'),('queue',6,'async'),('queue',6,'notification'),
('cron',35,'nightly job'),('cron',35,'scheduled job'),('cron',35,'cron job'),('cron',15,'cron'),('cron',15,'scheduled'),('cron',15,'nightly'),('cron',15,'daily'),('cron',15,'hourly'),('cron',6,'periodic'),('cron',6,'recurring'),
('ui',35,'cms editor'),('ui',35,'display in cms'),('ui',35,'visible in cms'),('ui',35,'cms detail'),('ui',35,'cms - content list'),('ui',35,'content list'),('ui',15,'ui'),('ui',15,'cms'),('ui',15,'editor'),('ui',15,'dashboard'),('ui',15,'screen'),('ui',15,'display'),('ui',15,'content manager'),('ui',6,'visible'),('ui',6,'filter'),('ui',6,'review'),('ui',6,'show'),('ui',6,'listed'),
('migration',35,'database migration'),('migration',35,'schema migration'),('migration',35,'alter table'),('migration',15,'migration'),('migration',15,'column'),('migration',15,'table'),('migration',15,'constraint'),('migration',6,'persisted'),('migration',6,'stored'),
('background',35,'background job'),('background',35,'worker job'),('background',15,'job'),('background',15,'worker'),('background',15,'background'),('background',15,'process'),('background',6,'async'),('background',6,'task'))"""
# Tickets over the customers: the wording goes by the key, so that every signal, boost and penalty is met.
_WORDINGS = (
    "The nightly import reads the XML feed of an external provider",
    "GET api/orders returns the request payload field orderStatus",
    "Consume the SQS message: filePath of the expired object in the bucket",
    "VOD & Recording must be listed on CMS - content list",
    "Please export a list of all recording titles",
    "- export\n- list of all stored rows of the table, scheduled job",
    "The content API response misses isArchived, called  isArchived",
    "A worker job processes the queue, the API returns async",
    "Data sync: link the migrated content, database migration adds a column",
    "nothing of this kind",
)
_TICKETS = "tickets AS (SELECT c_custkey AS id, list_extract([" + ", ".join("'" + w.replace("\n", "' || chr(10) || '") + "'" for w in _WORDINGS) + "], CAST(c_custkey % 10 AS INTEGER) + 1) || ' ' || c_name || ' ' || c_mktsegment AS text FROM customer)"
_LOW = f"""{_TICKETS}, l0 AS (SELECT id, text, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS low FROM tickets),
l1 AS (SELECT *, regexp_matches(low, 'sqs|queue message|queue name|arn:aws:sqs|listener|consumer|consume the sqs|process.*job|expired.*object|archive.*job|notification.*bucket|filepath.*bucket|file path.*bucket|moved to deleted|moved to archive') AS life,
 regexp_matches(low, '\\bcms\\b|content list|content manager|contentmanager|listed on cms') AS surface, regexp_matches(low, 'sqs|queue|arn:aws:sqs|notification') AS queued, regexp_matches(lower(text), '\\b(post|put|patch|delete|get)\\s+/?api/') AS called,
 regexp_matches(low, '\\bexport (a )?list\\b|\\bplease export\\b|\\bexport all\\b|\\bprovide a list\\b|\\blink the migrated\\b|\\bwe need:') OR (regexp_matches(text, '(^|\\n)\\s*-\\s+') AND regexp_matches(low, '\\bexport\\b|\\blist of all\\b')) AS reporting FROM l0),
l AS (SELECT *, NOT life AND (regexp_matches(low, '\\bvod\\b.*\\brecording\\b|\\brecording\\b.*\\bvod\\b|vod & recording|vod and recording') OR (regexp_matches(low, '\\brecording\\b') AND surface)) AS domain FROM l1),
adj AS (SELECT id, 'queue' AS workflow, CASE WHEN queued THEN 80 ELSE 0 END + CASE WHEN life AND regexp_matches(low, 'filepath|file path|s3|bucket|deleted|expired|recording') THEN 40 ELSE 0 END - CASE WHEN domain THEN 55 ELSE 0 END - CASE WHEN reporting AND NOT life THEN 45 ELSE 0 END AS points FROM l
 UNION ALL SELECT id, 'import', CASE WHEN regexp_matches(low, 'data sync|link the migrated|migrated content|provider data contains') THEN 40 ELSE 0 END + CASE WHEN regexp_matches(low, 'nightly\\s+import|external\\s+provider|xml feed') THEN 35 ELSE 0 END FROM l
 UNION ALL SELECT id, 'ui', CASE WHEN surface THEN 35 ELSE 0 END + CASE WHEN reporting THEN 25 ELSE 0 END FROM l
 UNION ALL SELECT id, 'api', CASE WHEN queued AND NOT called THEN -80 ELSE 0 END + CASE WHEN NOT called AND NOT regexp_matches(low, 'request payload|request body|new property|new field') AND regexp_matches(low, 'api returns|api response|content api|flag in content api|called\\s+isarchived') THEN -35 ELSE 0 END FROM l),
pts AS (SELECT id, workflow, points FROM adj UNION ALL SELECT l.id, s.workflow, CASE WHEN contains(l.low, s.signal) THEN s.points ELSE 0 END FROM l, sig s),
sc AS (SELECT id, workflow, CAST(sum(points) AS INTEGER) AS score FROM pts GROUP BY 1, 2),
tops AS (SELECT id, list_sort(list(score), 'DESC')[1] AS top, list_sort(list(score), 'DESC')[2] AS second FROM sc GROUP BY id),
conf AS (SELECT sc.id, workflow, score, CASE WHEN score <= 0 OR top <= 0 THEN 0.0 ELSE round(CASE WHEN score = top AND (reporting OR domain) AND top < second * 1.8 THEN least(0.65, c) ELSE c END, 2) END AS confidence FROM (
 SELECT sc.*, top, second, CASE WHEN score = top AND top >= second * 2.5 THEN CAST(0.95 AS DOUBLE) WHEN score = top AND top >= second * 1.5 THEN 0.8 WHEN score = top AND top > second THEN 0.65 ELSE greatest(CAST(0.25 AS DOUBLE), CAST(score AS DOUBLE) / greatest(top, 1) * 0.6) END AS c FROM sc JOIN tops USING (id)) sc JOIN l ON l.id = sc.id)"""


def _tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    wording = F.element_at(F.array(*map(F.lit, _WORDINGS)), (F.col("c_custkey") % 10 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.concat_ws(" ", wording, "c_name", "c_mktsegment").alias("text"))


@on_table("documents", f"WITH {_DF} SELECT token, df FROM df")
def token_df(documents):
    return ticket.document_frequency(documents, "doc_id", "text")


@on_table("documents", f"WITH {_DF} SELECT token, {_weight('token', 'df')} AS weight FROM df UNION ALL SELECT token || '_id', {_weight("(token || '_id')", '0')} FROM df WHERE df = 1")
def token_weight(documents):
    df = ticket.document_frequency(documents, "doc_id", "text")
    unseen = df.where("df = 1").select(F.concat("token", F.lit("_id")).alias("token"), F.lit(0).cast("long").alias("df"))
    return df.unionByName(unseen).select("token", ticket.token_weight(F.col("token"), F.col("df")).alias("weight"))


@query(f"WITH {_SIGNALS}, {_LOW} SELECT id, workflow, score, confidence FROM conf")
def workflow_scores(spark, sf_dir):
    return ticket.workflow_scores(_tickets(spark, sf_dir), "id", "text")


@query(f"""WITH {_SIGNALS}, {_LOW}, w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, workflow) AS n FROM conf WHERE score > 0)
SELECT t.id, coalesce(a.workflow, 'unknown') AS workflow, coalesce(a.score, 0) AS score, coalesce(a.confidence, 0.0) AS confidence, coalesce(o.others, '') AS others FROM tickets t LEFT JOIN w a ON a.id = t.id AND a.n = 1
LEFT JOIN (SELECT id, string_agg(workflow, ',' ORDER BY n) AS others FROM w WHERE n BETWEEN 2 AND 4 GROUP BY id) o ON o.id = t.id""")
def dominant_workflow(spark, sf_dir):
    return ticket.dominant_workflow(ticket.workflow_scores(_tickets(spark, sf_dir), "id", "text"), "id")


@on_table("pages", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages")
def page_links(pages):
    return scan.links(pages)


@on_table("pages", "SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9-]*)', 1)) AS tag FROM pages) GROUP BY 1, 2")
def template_tags(pages):
    return scan.tags(pages)


@on_graph("SELECT id, unnest(list_distinct(list_filter(string_split(lower(regexp_replace(regexp_replace(id, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 1))) AS word FROM nodes")
def keyword_split(nodes, edges):
    return nodes.select("id", F.explode(scan.keywords(F.col("id"))).alias("word"))


@on_graph("""SELECT id, CAST(CASE WHEN regexp_matches(h, '[^a-z0-9]controllers[^a-z0-9]') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(h, '[^a-z0-9]n1service[^a-z0-9]') THEN 1 ELSE 0 END AS INTEGER) AS hits
FROM (SELECT id, ' ' || lower(concat_ws(' ', id, name, file, parent)) || ' ' AS h FROM nodes) WHERE regexp_matches(h, '[^a-z0-9](controllers|n1service)[^a-z0-9]')""")
def haystack_match(nodes, edges):
    return ticket.mentions(nodes, ["controllers", "n1service", "c1", "form", "Contr"])


@on_graph(f""", s AS (SELECT {_METHOD} AS id), n AS (SELECT to_id AS id FROM edges JOIN s ON from_id = s.id UNION SELECT from_id FROM edges JOIN s ON to_id = s.id) SELECT id, 120 AS boost FROM n WHERE id NOT IN (SELECT id FROM s)""")
def proximity_boost(nodes, edges):
    return ticket.proximity(edges, nodes.where("type = 'method'").where(F.col("id").contains("Services")).agg(F.min("id").alias("id")))


@on_graph("""SELECT c.parent AS client, 'api:GET:/orders/' || r.k AS endpoint, e.to_id AS handler, CASE WHEN e.to_id IS NULL THEN 'no route' END AS gap FROM (SELECT parent FROM nodes WHERE type = 'method' AND name IN ('c1', 'c2')) c
CROSS JOIN (SELECT unnest(['1/O', 'none']) AS k) r LEFT JOIN edges e ON e.type = 'ROUTES_TO' AND e.from_id = 'api:GET:/orders/' || r.k""")
def flow_paths(nodes, edges):
    ends = F.explode(F.array(F.lit("api:GET:/orders/1/O"), F.lit("api:GET:/orders/none")))
    requests = nodes.where("type = 'method' and name in ('c1', 'c2')").select(F.col("parent").alias("from_id"), ends.alias("to_id"), F.lit("HTTP_REQUEST").alias("type"))
    return ticket.flow_paths(edges.select("from_id", "to_id", "type").unionByName(requests)).select("client", "endpoint", "handler", "gap")


_STOPPED = "('the','and','for','with','that','this','from','not','are','was','but','can','should','when','then','have','has','into','will','must','need','all','any','via','per','use','add','new','fix')"


@query(f""", raw AS (SELECT id, concat_ws(' ', id, name, file, parent) AS t FROM nodes), nw AS (SELECT id, unnest(list_distinct(string_split_regex(regexp_replace(lower(t || ' ' || regexp_replace(t, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g'), ' '))) AS word FROM raw),
words AS (SELECT * FROM nw WHERE length(word) >= 3), ww AS (SELECT word, {_weight('word', 'df')} AS weight FROM (SELECT word, count(*) AS df FROM words GROUP BY word)),
tk AS (SELECT s_suppkey AS ticket, 'the s' || s_suppkey || ' of N' || s_nationkey || 'Service must import p' || s_suppkey || ' for c1' || s_suppkey || '0 when queued' AS text FROM supplier),
tt AS (SELECT ticket, unnest(list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9_\\s-]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '[0-9]+') AND w NOT IN {_STOPPED}))) AS word FROM tk),
sr AS (SELECT ticket, id, round(sum(weight), 2) AS score FROM tt JOIN (SELECT * FROM ww WHERE weight > 0) USING (word) JOIN words USING (word) GROUP BY 1, 2)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ticket ORDER BY score DESC, id) AS INTEGER) AS rank FROM sr) WHERE rank <= 10""")
def ticket_rank(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    text = F.concat(F.lit("the s"), "s_suppkey", F.lit(" of N"), "s_nationkey", F.lit("Service must import p"), "s_suppkey", F.lit(" for c1"), "s_suppkey", F.lit("0 when queued"))
    return ticket.rank(stored_graph(spark, sf_dir).nodes, s.select(F.col("s_suppkey").alias("ticket"), text.alias("text")), "ticket", "text")


@on_graph("SELECT id, count(*) AS n FROM (SELECT id FROM nodes WHERE type = 'method' UNION SELECT id FROM nodes WHERE type <> 'method') GROUP BY id")
def merge_insert_if_absent(nodes, edges):
    merged = store.merge_absent(store.Graph(nodes.where("type = 'method'"), edges), store.Graph(nodes, edges))
    return merged.nodes.groupBy("id").agg(F.count("*").alias("n"))


@on_table("events", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def edge_last_write_wins(events):
    return store.last_write_wins(events.select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


# --- derived edges, over small graphs made of the tables

_CLASSES = """h AS (SELECT 'N' || n_nationkey AS cls, 'N' || (n_nationkey // 2) AS base, n_nationkey AS k FROM nation),
up AS (SELECT cls AS child, base AS ancestor, 1 AS depth FROM h WHERE k > 0 UNION ALL SELECT u.child, h.base, depth + 1 FROM up u JOIN h ON h.cls = u.ancestor AND h.k > 0 WHERE depth < 8),
m AS (SELECT cls || '::all' AS id, cls, 'all' AS name, k < 2 AS abstract FROM h UNION ALL SELECT cls || '::m' || k % 3, cls, 'm' || k % 3, false FROM h),
c AS (SELECT 'App::run' || k AS caller, cls || '::all' AS target FROM h WHERE k < 6)"""


def _classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("N"), "n_nationkey").alias("cls"))
    method = lambda name, abstract: k.select(F.concat_ws("::", "cls", name).alias("id"), F.col("cls").alias("parent"), F.lit("method").alias("type"), name.alias("name"), abstract.alias("is_abstract"))
    nodes = method(F.lit("all"), F.col("k") < 2).unionByName(method(F.concat(F.lit("m"), F.col("k") % 3), F.lit(False)))
    none = F.lit(None).cast("string").alias("call_type")
    extends = k.where("k > 0").select(F.col("cls").alias("from_id"), F.concat(F.lit("N"), F.floor(F.col("k") / 2)).alias("to_id"), F.lit("EXTENDS").alias("type"), none)
    calls = k.where("k < 6").select(F.concat(F.lit("App::run"), "k").alias("from_id"), F.concat("cls", F.lit("::all")).alias("to_id"), F.lit("CALLS").alias("type"), none)
    return nodes, extends.unionByName(calls)


def _derived(kind: str, abstract: str) -> str:
    return f"WITH RECURSIVE {_CLASSES} SELECT DISTINCT c.caller AS from_id, t.id AS to_id, c.target AS via, '{kind}' AS call_type FROM c JOIN m s ON s.id = c.target AND {abstract} JOIN up ON up.ancestor = s.cls JOIN m t ON t.cls = up.child AND t.name = s.name AND NOT t.abstract"


@query(_derived("OVERRIDE_RESOLVED", "NOT s.abstract"))
def override_resolved(spark, sf_dir):
    return resolve.override_calls(*_classes(spark, sf_dir))


@query(_derived("EXTENDS_RESOLVED", "s.abstract"))
def extends_resolved(spark, sf_dir):
    return resolve.extends_calls(*_classes(spark, sf_dir))


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return line.select(F.concat(F.lit("s"), "l_suppkey").alias("from_id"), F.concat(F.lit("p"), "l_partkey").alias("to_id"), F.lit("FLOWS_TO").alias("type"), F.col("l_linenumber").alias("argument_index"), F.col("l_returnflag").alias("via"))


@query("""WITH f AS (SELECT 's' || l_suppkey AS s, 'p' || l_partkey AS p, l_linenumber AS i, l_returnflag AS via FROM lineitem), h AS (SELECT 'p' || p_partkey AS p, 'p' || p_partkey || '::$' || i AS par, i FROM part, (SELECT unnest([1, 2, 3]) AS i))
SELECT s AS from_id, par AS to_id, CAST(f.i AS INTEGER) AS argument_index, min(via) AS via FROM f JOIN h ON f.p = h.p AND f.i = h.i GROUP BY 1, 2, 3""")
def argument_edges(spark, sf_dir):
    method = F.concat(F.lit("p"), "p_partkey")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(method.alias("from_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("argument_index"))
    has = part.select("from_id", F.concat("from_id", F.lit("::$"), "argument_index").alias("to_id"), F.lit("HAS_PARAMETER").alias("type"), "argument_index", F.lit(None).cast("string").alias("via"))
    return resolve.argument_edges(_flows(spark, sf_dir).unionByName(has))


@query("""WITH f AS (SELECT 's' || l_suppkey || 'o' || l_orderkey % 500 AS s, l_linenumber AS i, l_returnflag AS via FROM lineitem), a AS (SELECT s, via FROM f WHERE i = 1)
SELECT type, count(*) AS n FROM (SELECT 'ARGUMENT_TO' AS type FROM a UNION ALL SELECT 'FLOWS_TO' FROM f WHERE i <> 1 AND NOT EXISTS (SELECT 1 FROM a WHERE a.s = f.s AND a.via = f.via)) GROUP BY type""")
def field_flow_filter(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    source = F.concat(F.lit("s"), "l_suppkey", F.lit("o"), F.col("l_orderkey") % 500)
    flows = line.select(source.alias("from_id"), F.concat(F.lit("p"), "l_partkey").alias("to_id"), F.col("l_linenumber").alias("argument_index"), F.col("l_returnflag").alias("via"))
    kinds = flows.withColumn("type", F.when(F.col("argument_index") == 1, "ARGUMENT_TO").otherwise("FLOWS_TO"))
    return navigation.field_flow(kinds).groupBy("type").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT DISTINCT 'm' || o_custkey AS m, 'request_field:' || o_orderpriority AS f FROM orders), a AS (SELECT 'request_field:' || p AS f, '$' || p AS v FROM (SELECT DISTINCT o_orderpriority AS p FROM orders) WHERE p < '3')
SELECT f AS from_id, v AS to_id, 'ASSIGNS' AS type FROM a UNION ALL SELECT m, f, 'READS_FIELD' FROM r WHERE f NOT IN (SELECT f FROM a)""")
def field_intake_filter(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    field = F.concat(F.lit("request_field:"), "o_orderpriority")
    reads = orders.select(F.concat(F.lit("m"), "o_custkey").alias("from_id"), field.alias("to_id"), F.lit("READS_FIELD").alias("type")).distinct()
    assigns = orders.where("o_orderpriority < '3'").select(field.alias("from_id"), F.concat(F.lit("$"), "o_orderpriority").alias("to_id"), F.lit("ASSIGNS").alias("type")).distinct()
    return navigation.field_intake(reads.unionByName(assigns))


@on_graph("SELECT DISTINCT 'v' || c_nationkey AS from_id, n.id AS to_id FROM customer c JOIN nodes n ON n.type = 'method' AND n.visibility = 'public' AND lower(n.name) = 'c' || c.c_custkey")
def blade_calls(nodes, edges):
    views = nodes.where("type = 'method'").where(F.col("id").contains("Controllers"))
    nation = F.regexp_extract("parent", r"N(\d+)Controller", 1)
    refs = views.select(F.concat(F.lit("v"), nation).alias("from_id"), F.concat(F.lit("blade_method_ref:"), F.upper("name")).alias("to_id"), F.lit("BLADE_METHOD_CALL").alias("type"))
    return resolve.view_calls(nodes, refs)


@on_graph("""SELECT 'api:GET:orders/' || split_part(id, '/', 3) || '/{x}' AS from_id, min(id) OVER (PARTITION BY split_part(id, '/', 3)) AS to_id FROM nodes WHERE false
UNION ALL SELECT replace(id, ':/orders', ':api/orders') || '/', id FROM nodes WHERE type = 'api_endpoint'""")
def endpoint_merge(nodes, edges):
    ends = nodes.where("type = 'api_endpoint'").select("id", "type")
    named = ends.select(F.concat(F.replace("id", F.lit(":/orders"), F.lit(":api/orders")), F.lit("/")).alias("id"), "type")
    return resolve.link_endpoints(ends.unionByName(named))


# --- lookups for all nodes at once

_METHODS = "(SELECT id FROM nodes WHERE type = 'method')"


def _all_methods(nodes: DataFrame) -> DataFrame:
    return nodes.where("type = 'method'").select(F.col("id").alias("target"))


@on_graph("SELECT t.id AS target, coalesce(n.type, 'unknown') AS type, n.file FROM (SELECT to_id AS id FROM edges UNION SELECT from_id || '?' FROM edges WHERE type = 'ROUTES_TO') t LEFT JOIN nodes n ON n.id = t.id")
def node_lookup(nodes, edges):
    unknown = edges.where("type = 'ROUTES_TO'").select(F.concat("from_id", F.lit("?")).alias("target"))
    return navigation.lookup(nodes, edges.select(F.col("to_id").alias("target")).unionByName(unknown).distinct()).select("target", "type", "file")


@on_graph("SELECT id, CASE WHEN type = 'method' THEN coalesce(parent, id) ELSE id END AS target FROM nodes")
def relation_targets(nodes, edges):
    return navigation.relation_targets(nodes)


@on_graph(f"SELECT target, from_id, type FROM (SELECT to_id AS target, from_id, type, row_number() OVER (PARTITION BY to_id ORDER BY from_id) AS n FROM edges WHERE type = 'ROUTES_TO' AND to_id IN {_METHODS}) WHERE n <= 3")
def incoming_routes(nodes, edges):
    return navigation.into(edges, _all_methods(nodes), F.col("type") == "ROUTES_TO", 3)


@on_graph(f"SELECT target, to_id, type FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY type, to_id) AS n FROM (SELECT DISTINCT from_id AS target, to_id, type FROM edges WHERE type IN ('CALLS', 'EXTENDS') AND from_id IN {_METHODS})) WHERE n <= 5")
def outgoing_edges_by_type(nodes, edges):
    return navigation.out_of(edges, _all_methods(nodes), F.col("type").isin("CALLS", "EXTENDS"), 5)


@on_graph("SELECT from_id AS endpoint, min(to_id) AS handler FROM edges WHERE type = 'ROUTES_TO' GROUP BY 1")
def route_controllers(nodes, edges):
    return navigation.route_handlers(edges)


_REQUESTS = "req AS (SELECT DISTINCT 'web/N' || c_nationkey || '.vue' AS from_id, 'api:GET:/orders/' || (1 + c_nationkey % 5) || '/' || (CASE WHEN c_custkey % 2 = 0 THEN 'O' ELSE 'F' END) AS to_id FROM customer)"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.concat(F.lit("api:GET:/orders/"), 1 + F.col("c_nationkey") % 5, F.lit("/"), F.when(F.col("c_custkey") % 2 == 0, "O").otherwise("F"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("web/N"), "c_nationkey", F.lit(".vue")).alias("from_id"), end.alias("to_id"), F.lit("HTTP_REQUEST").alias("type"), F.lit(None).cast("string").alias("call_type")).distinct()


@query(f", {_REQUESTS} SELECT to_id AS target, from_id, 'HTTP_REQUEST' AS type FROM (SELECT *, row_number() OVER (PARTITION BY to_id ORDER BY from_id) AS n FROM req WHERE to_id IN (SELECT id FROM nodes)) WHERE n <= 4")
def http_clients(spark, sf_dir):
    nodes = stored_graph(spark, sf_dir).nodes
    return navigation.into(_requests(spark, sf_dir), nodes.where("type = 'api_endpoint'").select(F.col("id").alias("target")), F.col("type") == "HTTP_REQUEST", 4)


@query(f""", {_REQUESTS}, hd AS (SELECT from_id AS endpoint, min(to_id) AS handler FROM edges WHERE type = 'ROUTES_TO' GROUP BY 1),
every AS (SELECT * FROM (SELECT to_id AS target, 0 AS place, 'http_client' AS kind, from_id, row_number() OVER (PARTITION BY to_id ORDER BY from_id) AS n FROM req WHERE to_id IN (SELECT id FROM nodes)) WHERE n <= 4
 UNION ALL SELECT DISTINCT endpoint, 1, 'call', c.from_id, 0 FROM hd JOIN nodes e ON e.id = endpoint JOIN (SELECT * FROM edges WHERE type = 'CALLS' AND (call_type IS NULL OR call_type <> 'INTERFACE_RESOLVED')) c ON c.to_id = handler
 UNION ALL SELECT endpoint, 1, 'call', 'cron', 0 FROM hd)
SELECT target, place, kind, from_id FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY place, from_id) AS k FROM every) WHERE k <= 4""")
def route_scoped_entries(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    edges = g.edges.select("from_id", "to_id", "type", "call_type")
    cron = navigation.route_handlers(edges).select(F.lit("cron").alias("from_id"), F.col("handler").alias("to_id"), F.lit("CALLS").alias("type"), F.lit(None).cast("string").alias("call_type")).distinct()
    return navigation.route_entries(edges.unionByName(_requests(spark, sf_dir)).unionByName(cron), g.nodes.where("type = 'api_endpoint'").select(F.col("id").alias("target")), 4)


@on_graph("""SELECT f.to_id || '::' || m.name AS target, min(m.id) AS implementation FROM (SELECT DISTINCT to_id, from_id FROM edges WHERE type = 'IMPLEMENTS') f JOIN nodes m ON m.type = 'method' AND m.parent = f.from_id GROUP BY 1""")
def interface_implementation(nodes, edges):
    owned = nodes.where("type = 'method'").select(F.col("parent").alias("from_id"), "name")
    asked = edges.where("type = 'IMPLEMENTS'").join(owned, "from_id").select(F.concat_ws("::", "to_id", "name").alias("target")).distinct()
    missing = edges.where("type = 'IMPLEMENTS'").select(F.concat("to_id", F.lit("::none")).alias("target"))
    return navigation.implementations(nodes, edges, asked.unionByName(missing).distinct())


# A graph of fields around the controllers' methods, made of the customers: c_custkey decides which edges a method has.
_FIELDS = r"""cm AS (SELECT c_custkey AS k, 'App\Http\Controllers\N' || c_nationkey || 'Controller::c' || c_custkey AS id FROM customer),
fe AS (SELECT 'api:GET:/c/' || k AS from_id, id AS to_id, 'ROUTES_TO' AS type, NULL AS via FROM cm WHERE k % 2 = 0
 UNION ALL SELECT 'web/' || k || '.vue', 'api:GET:/c/' || k, 'HTTP_REQUEST', NULL FROM cm WHERE k % 4 = 0
 UNION ALL SELECT 'blade:v' || k % 9, id, 'BLADE_USES_ACTION', NULL FROM cm WHERE k % 5 = 0
 UNION ALL SELECT id, 'App\Services\Pay::run' || k % 3, 'CALLS', NULL FROM cm WHERE k % 3 > 0
 UNION ALL SELECT 'request_field:f' || k % 7, id || '::$d', 'ASSIGNS', NULL FROM cm WHERE k % 6 < 4
 UNION ALL SELECT id, 'request_field:f' || k % 7, 'READS_FIELD', NULL FROM cm WHERE k % 6 < 5
 UNION ALL SELECT id || '::$d', 'App\Services\Pay::run1', 'FLOWS_TO', '$d' FROM cm WHERE k % 8 < 4
 UNION ALL SELECT id || '::$d', 'App\Services\Pay::run1::$x', 'ARGUMENT_TO', '$d' FROM cm WHERE k % 8 < 2
 UNION ALL SELECT id, 'validation:' || id || ':f', 'VALIDATES', NULL FROM cm WHERE k % 3 = 0
 UNION ALL SELECT id, 'model_field:App\Models\C:f' || k % 7, 'PERSISTS', NULL FROM cm WHERE k % 4 < 2
 UNION ALL SELECT id, 'config_key:c.' || k % 2, 'REFERENCES', NULL FROM cm WHERE k % 11 = 0)"""
_CONTEXT = f"""{_FIELDS}, argued AS (SELECT from_id, via FROM fe WHERE type = 'ARGUMENT_TO'), taken AS (SELECT to_id, from_id FROM fe WHERE type = 'ASSIGNS'),
ctx AS (SELECT to_id AS target, 'route' AS section, 0 AS place, from_id, to_id FROM fe WHERE type = 'ROUTES_TO' UNION ALL SELECT to_id, 'view', 0, from_id, to_id FROM fe WHERE type = 'BLADE_USES_ACTION'
 UNION ALL SELECT to_id, 'entry', CASE type WHEN 'ROUTES_TO' THEN 1 ELSE 2 END, from_id, to_id FROM fe WHERE type IN ('ROUTES_TO', 'BLADE_USES_ACTION')
 UNION ALL SELECT r.to_id, 'upstream', 0, h.from_id, h.to_id FROM fe h JOIN fe r ON r.type = 'ROUTES_TO' AND r.from_id = h.to_id WHERE h.type = 'HTTP_REQUEST'
 UNION ALL SELECT split_part(to_id, '::$', 1), 'intake', 0, from_id, to_id FROM fe WHERE type = 'ASSIGNS'
 UNION ALL SELECT from_id, 'intake', 0, from_id, to_id FROM fe WHERE type = 'READS_FIELD' AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.from_id = fe.to_id AND t.to_id = fe.from_id || '::$d')
 UNION ALL SELECT split_part(from_id, '::$', 1), 'flow', 0, from_id, to_id FROM fe WHERE type = 'ARGUMENT_TO' OR type = 'FLOWS_TO' AND NOT EXISTS (SELECT 1 FROM argued a WHERE a.from_id = fe.from_id AND a.via = fe.via)
 UNION ALL SELECT from_id, CASE type WHEN 'VALIDATES' THEN 'validates' WHEN 'PERSISTS' THEN 'persists' ELSE 'config' END, 0, from_id, to_id FROM fe WHERE type IN ('VALIDATES', 'PERSISTS', 'REFERENCES'))"""


def _fields(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, targets) of it."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.concat(F.lit("App\\Http\\Controllers\\N"), "c_nationkey", F.lit("Controller")).alias("parent"))
    c = c.withColumn("id", F.concat("parent", F.lit("::c"), "k"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    k, own, none = F.col("k"), F.col("id"), F.lit(None).cast("string")
    local, data = text(own, "::$d"), F.lit("$d")
    kinds = [
        (k % 2 == 0, text("api:GET:/c/", k), own, "ROUTES_TO", none), (k % 4 == 0, text("web/", k, ".vue"), text("api:GET:/c/", k), "HTTP_REQUEST", none), (k % 5 == 0, text("blade:v", k % 9), own, "BLADE_USES_ACTION", none),
        (k % 3 > 0, own, text("App\\Services\\Pay::run", k % 3), "CALLS", none), (k % 6 < 4, text("request_field:f", k % 7), local, "ASSIGNS", none), (k % 6 < 5, own, text("request_field:f", k % 7), "READS_FIELD", none),
        (k % 8 < 4, local, F.lit("App\\Services\\Pay::run1"), "FLOWS_TO", data), (k % 8 < 2, local, F.lit("App\\Services\\Pay::run1::$x"), "ARGUMENT_TO", data), (k % 3 == 0, own, text("validation:", own, ":f"), "VALIDATES", none),
        (k % 4 < 2, own, text("model_field:App\\Models\\C:f", k % 7), "PERSISTS", none), (k % 11 == 0, own, text("config_key:c.", k % 2), "REFERENCES", none),
    ]
    each = F.explode(F.array_compact(F.array(*(F.when(holds, F.struct(a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("type"), via.alias("via"), none.alias("call_type"))) for holds, a, b, kind, via in kinds))))
    nodes = c.select("id", "parent", F.lit("method").alias("type"))
    return nodes, c.select(each.alias("e")).select("e.*"), c.select(own.alias("target"))


@query(f"WITH {_CONTEXT} SELECT target, section, place, from_id, to_id FROM ctx")
def navigation_context(spark, sf_dir):
    return navigation.contexts(*_fields(spark, sf_dir))


@query(f"WITH {_CONTEXT} SELECT target, section, count(*) AS n FROM ctx GROUP BY 1, 2")
def navigation_entry_counts(spark, sf_dir):
    return navigation.entry_counts(navigation.contexts(*_fields(spark, sf_dir)))


@query(f"""WITH {_CONTEXT}, h AS (SELECT cm.id, bool_or(section IN ('entry', 'route', 'view')) AS e, bool_or(section IN ('route', 'view')) AS r, bool_or(section = 'intake') AS i, bool_or(section = 'flow') AS f, any_value(k) % 3 > 0 AS c FROM cm LEFT JOIN ctx ON target = cm.id GROUP BY 1),
w AS (SELECT id, unnest([CASE WHEN NOT coalesce(e, false) THEN 'No CALLS, ROUTES_TO, or BLADE_USES_ACTION entry — symbol may be unreachable, externally invoked, or missing route extraction.' END,
CASE WHEN NOT coalesce(r, false) THEN 'No ROUTES_TO or BLADE_USES_ACTION edges — HTTP/view entry for this controller action is unknown in the graph.' END, CASE WHEN NOT coalesce(i, false) THEN 'No ASSIGNS/request_field edges — request field intake not traced for this action.' END,
CASE WHEN c AND coalesce(i, false) AND NOT coalesce(f, false) THEN 'No FLOWS_TO/ARGUMENT_TO into callees — DTO/field propagation to service calls may be incomplete.' END]) AS warning FROM h) SELECT id AS target, warning FROM w WHERE warning IS NOT NULL""")
def navigation_warnings(spark, sf_dir):
    nodes, edges, targets = _fields(spark, sf_dir)
    return navigation.warnings(edges, targets, navigation.contexts(nodes, edges, targets))


@query(rf"""WITH {_CONTEXT}, st AS (SELECT target, 0 AS turn, from_id, to_id, 0 AS spot, CASE section WHEN 'view' THEN from_id ELSE 'GET ' || split_part(from_id, ':', 3) END AS label FROM ctx WHERE section = 'route'
 UNION ALL SELECT target, 1, from_id, to_id, 0, from_id FROM ctx WHERE section = 'view' UNION ALL SELECT from_id, 2, from_id, to_id, 0, 'Pay::run' || right(to_id, 1) FROM fe WHERE type = 'CALLS'
 UNION ALL SELECT target, 3, from_id, to_id, spot, CASE WHEN starts_with(x, 'request_field:') THEN 'request:' || substr(x, 15) ELSE regexp_extract(x, '[^\\]+$') END FROM (SELECT *, unnest([0, 1]) AS spot, unnest([from_id, to_id]) AS x FROM ctx WHERE section = 'intake')
 UNION ALL SELECT target, 4, from_id, to_id, 0, regexp_extract(to_id, '[^\\]+$') FROM ctx WHERE section = 'flow' UNION ALL SELECT target, 5, from_id, to_id, 0, 'model:App\Models\C::' || split_part(to_id, ':', 3) FROM ctx WHERE section = 'persists'),
g AS (SELECT target, label, min(turn || '|' || from_id || '|' || to_id || '|' || spot) AS o FROM st GROUP BY 1, 2) SELECT target, CAST(row_number() OVER (PARTITION BY target ORDER BY o) AS INTEGER) AS place, label FROM g""")
def navigation_suggested(spark, sf_dir):
    nodes, edges, targets = _fields(spark, sf_dir)
    return navigation.suggested(edges, targets, navigation.contexts(nodes, edges, targets))


# Methods that reach each rung of the ladder of exclusions, made of the parts: p_partkey chooses parent, file, name and kind of parent.
_RUNGS = [
    ("App\\Pay", "app/Pay.php", "__construct", "class"), ("App\\BaseThing", "app/Thing.php", "go", "class"), ("App\\Base", "app/B.php", "go", "class"), ("App\\ThingBase", "app/T.php", "go", "class"), ("App\\Abstract", "app/Odd.php", "go", "class"),
    ("App\\Odd", "app/base/Odd.php", "go", "class"), ("App\\Odd", "app/basething.php", "go", "class"), ("App\\Pay", "app/Pay.php", "__toString", "class"), ("App\\PayTest", "app/tests/PayTest.php", "go", "class"), ("App\\PayTest", "tests/PayTest.php", "go", "class"),
    ("App\\Payable", "app/Payable.php", "go", "interface"), ("App\\PayController", "app/PayController.php", "Index", "class"), ("App\\Other", "app/Http/Controllers/Other.php", "handle", "class"), ("App\\PayController", "app/PayController.php", "render", "class"),
    ("App\\PayRequest", "app/PayRequest.php", "rules", "class"), ("App\\Odd", "app/Http/Requests/Odd.php", "authorize", "class"), ("App\\PayServiceProvider", "app/P.php", "boot", "class"), ("App\\PayJob", "app/PayJob.php", "handle", "class"), ("App\\Odd", "app/jobs/Odd.php", "run", "class"),
    ("App\\Odd", "app/Listeners/Odd.php", "handle", "class"), ("App\\User", "app/Models/User.php", "getName", "class"), ("App\\User", "app/Modeling/User.php", "getName", "class"), ("App\\User", "app/Models/User.php", "getter", "class"), ("App\\Pay", "app/Pay.php", "up", "class"),
]
_RUNG_ROWS = ", ".join(f"({i}, " + ", ".join(f"'{x}'" for x in row) + ")" for i, row in enumerate(_RUNGS))
_LADDER = rf"""rung(i, parent, file, name, kind) AS (VALUES {_RUNG_ROWS}), pm AS (SELECT parent || p_brand || '::' || name || p_partkey AS id, parent, file, name, kind FROM part JOIN rung ON i = p_partkey % {len(_RUNGS)}),
ld AS (SELECT *, CASE WHEN name = '__construct' THEN 'constructor'
 WHEN regexp_matches(regexp_extract(parent, '[^\\]+$'), '^(Base|Abstract)[A-Za-z0-9_]') OR ends_with(parent, 'Base') OR contains(lower(file), '/base/') OR contains(lower(file), '/abstract/') OR regexp_matches(lower(file), '/base[a-z0-9_]*\.php$') THEN 'base_class'
 WHEN starts_with(name, '__') THEN 'magic_method' WHEN contains(lower(file), '/test/') OR contains(lower(file), '/tests/') THEN 'test_file' WHEN kind = 'interface' THEN 'interface_method'
 WHEN (contains(parent, 'Controller') OR contains(file, '/Controllers/') OR contains(file, '/Controller/')) AND lower(name) IN ('index', 'show', 'store', 'create', 'edit', 'update', 'destroy', 'handle') THEN 'controller_action'
 WHEN (ends_with(parent, 'Request') OR contains(lower(file), '/requests/')) AND lower(name) IN ('rules', 'messages', 'attributes', 'authorize') OR ends_with(parent, 'ServiceProvider') AND lower(name) IN ('boot', 'register')
  OR (ends_with(parent, 'Command') OR ends_with(parent, 'Job') OR ends_with(parent, 'Listener') OR ends_with(parent, 'Middleware') OR regexp_matches(lower(file), '/(commands|jobs|listeners|middleware)/')) AND lower(name) = 'handle' THEN 'framework_method'
 WHEN regexp_matches(name, '^(get|set|is|has)[A-Z]') AND regexp_matches(lower(file), '/(entity|entities|dto|dtos|model|models)/') THEN 'entity_accessor' END AS skip_reason FROM pm)"""


def _rungs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(("parent", "file", "name", "kind"), row))) for row in _RUNGS))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", F.get(rows, (F.col("p_partkey") % len(_RUNGS)).cast("int")).alias("r"))
    none = F.lit(None).cast("string")
    methods = part.select(F.concat("r.parent", "p_brand", F.lit("::"), "r.name", "p_partkey").alias("id"), "r.parent", F.lit("method").alias("type"), "r.name", "r.file", F.lit("public").alias("visibility"), F.lit(False).alias("is_abstract"))
    classes = part.select(F.col("r.parent").alias("id"), none.alias("parent"), F.col("r.kind").alias("type"), none.alias("name"), none.alias("file"), none.alias("visibility"), F.lit(False).alias("is_abstract")).distinct()
    return methods.unionByName(classes), spark.createDataFrame([], "from_id string, to_id string, type string, call_type string")


@query(f"WITH {_LADDER} SELECT id, skip_reason FROM ld")
def dead_code_ladder(spark, sf_dir):
    return deadcode.methods(*_rungs(spark, sf_dir)).select("id", "skip_reason")


@query(f"WITH {_LADDER} SELECT id, CASE WHEN contains(parent, 'Controller') OR contains(file, '/Controllers/') OR contains(file, '/Controller/') THEN 'medium' ELSE 'high' END AS confidence FROM ld WHERE skip_reason IS NULL OR skip_reason = 'test_file'")
def dead_code_with_tests(spark, sf_dir):
    return deadcode.dead(*_rungs(spark, sf_dir), off=("tests",)).select("id", "confidence")


# Edges that reach each rule of the layers, made of the parts.
_LAYERED = [
    ("App\\Repositories\\A::go", "App\\Http\\Controllers\\B::go"), ("App\\Services\\A::go", "Illuminate\\Http\\Request::input"), ("App\\Services\\A::go", "Illuminate\\Http\\Response::send"), ("App\\Domain\\A::go", "GuzzleHttp\\Http\\C::send"), ("App\\Services\\OrderRepository::go", "App\\UseCases\\Q::query"),
    ("App\\Infrastructure\\A::go", "App\\Services\\B::go"), ("App\\Infrastructure\\A::go", "App\\Domain\\B::go"), ("App\\UseCase\\A::go", "App\\Controller\\B::go"), ("App\\Services\\A::go", "App\\Repositories\\B::go"), ("App\\Repository\\Safe::go", "App\\Service\\B::go"),
]
_EXPECTED = [
    ("Repositories", "Http", "Controller → Service → Repository", None), ("Services", "Http", "Controller → Service → Repository", "framework"), ("Services", "Http", "Controller → Service → Repository", None), ("Domain", "Http", "Controller → UseCase → Service → Domain", "framework"),
    ("Services", "UseCases", "UseCase → Service → Repository", "query"), ("Infrastructure", "Services", "Service → Repository ← Infrastructure", "rule"), ("Infrastructure", "Domain", "Domain → ... → Infrastructure", "rule"), ("UseCase", "Controller", "Controller → UseCase → Service → Repository", None),
    None, ("Repository", "Service", "Service → Repository", "rule"),
]
_RULED = ", ".join(f"({i}, '{e[0]}', '{e[1]}', '{e[2]}', " + (f"'{e[3]}'" if e[3] else "NULL") + ")" for i, e in enumerate(_EXPECTED) if e)


@query(f"""WITH x(i, from_layer, to_layer, expected, likely_false) AS (VALUES {_RULED}) SELECT p_partkey AS k, CASE WHEN p_partkey % 20 < 10 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, from_layer, to_layer, expected, likely_false,
from_layer || ' code should not ' || CASE WHEN p_partkey % 20 < 10 THEN 'call' ELSE 'depend on' END || ' ' || to_layer || ' code.' AS reason, from_layer || ' → ' || to_layer AS detected FROM part JOIN x ON i = p_partkey % 10""")
def architecture_rules(spark, sf_dir):
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _LAYERED))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), F.get(rows, (F.col("p_partkey") % 10).cast("int")).alias("r"))
    edges = part.select(F.concat("r.a", "k").alias("from_id"), F.col("r.b").alias("to_id"), F.when(F.col("k") % 20 < 10, "CALLS").otherwise("DEPENDS_ON").alias("type"), F.lit(None).cast("string").alias("call_type"))
    found = architecture.violations(edges, ignore=["*Safe* -> App?Service*", "nothing"], allow=["also nothing", {"fromLayer": "Infrastructure"}, {"from": "Service"}])
    return found.select(F.regexp_extract("from_id", r"(\d+)$", 1).cast("long").alias("k"), "severity", "from_layer", "to_layer", "expected", "likely_false", "reason", "detected")


@query("""WITH RECURSIVE p AS (SELECT DISTINCT event_type AS f, t FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events) WHERE t IS NOT NULL AND t <> event_type),
w AS (SELECT [f, t] AS path FROM p WHERE t > f UNION ALL SELECT list_append(path, p.t) FROM w JOIN p ON p.f = path[len(path)] WHERE p.t > path[1] AND NOT list_contains(path, p.t) AND len(path) < 12),
c AS (SELECT path FROM w JOIN p ON p.f = path[len(path)] AND p.t = path[1])
SELECT array_to_string(list_append(path, path[1]), '>') AS cycle, CAST(len(path) AS INTEGER) AS length, array_to_string(list_sort(list_distinct(list_transform(path, lambda n: 'src/' || left(n, 1) || '.php'))), ',') AS files, array_to_string(list_transform(path, lambda n: 'CALLS:' || n), ',') AS labels FROM c""")
def cycle_items(spark, sf_dir):
    pairs = event_pairs(spark, sf_dir)
    edges = pairs.select("from_id", "to_id", F.lit("CALLS").alias("type"), F.col("from_id").alias("call_type"))
    nodes = pairs.select(F.col("from_id").alias("id")).distinct().withColumn("file", F.concat(F.lit("src/"), F.substring("id", 1, 1), F.lit(".php")))
    labelled = cycles.adjacency(edges.unionByName(edges.withColumn("call_type", F.lit("zz"))))
    found = cycles.items(cycles.simple_cycles(labelled), labelled, nodes)
    return found.select(F.array_join("nodes", ">").alias("cycle"), "length", F.array_join("files", ",").alias("files"), F.array_join("labels", ",").alias("labels"))


@query("""WITH RECURSIVE p AS (SELECT DISTINCT event_type AS f, t FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events) WHERE t IS NOT NULL AND t <> event_type),
w AS (SELECT [f, t] AS path FROM p WHERE f = 'click' UNION ALL SELECT list_append(path, p.t) FROM w JOIN p ON p.f = path[len(path)] WHERE NOT list_contains(path, p.t) AND len(path) < 12),
v AS (SELECT ['error', t] AS path FROM p WHERE f = 'error' AND t <> 'click' UNION ALL SELECT list_append(path, p.t) FROM v JOIN p ON p.f = path[len(path)] WHERE p.t <> 'click' AND NOT list_contains(path, p.t) AND len(path) < 12),
c AS (SELECT path FROM w JOIN p ON p.f = path[len(path)] AND p.t = path[1] UNION ALL SELECT path FROM v JOIN p ON p.f = path[len(path)] AND p.t = path[1])
SELECT CAST(len(path) AS INTEGER) AS length, array_to_string(list_append(path, path[1]), '->') AS cycle FROM c ORDER BY 1, 2 LIMIT 20""")
def cycles_from_nodes(spark, sf_dir):
    return cycles.from_nodes(event_pairs(spark, sf_dir), ["click", "error"]).select("length", F.array_join("nodes", "->").alias("cycle"))


# Field names in several spellings, made of the suppliers, matched with paths.
_NAMES = ["is_archived", "isArchived", "request_field:is-archived", "model_field:App\\M:isArchived", "a.is_archived", "b.isArchived", "x.a.isArchived", "16x9", "images.16x9", "isDeleted", "a.b", "c.a.b", "c.b", "b"]


@query("""WITH f(i, name) AS (VALUES """ + ", ".join(f"({i}, '{n}')" for i, n in enumerate(_NAMES)) + r"""), s AS (SELECT s_suppkey AS k, CAST(s_suppkey % 14 AS INTEGER) AS i, CAST((s_suppkey // 14) % 14 AS INTEGER) AS j FROM supplier),
c AS (SELECT k, replace(replace(lower(regexp_replace(regexp_replace(a.name, '^request_field:', ''), '^model_field:[^:]+:', '')), '_', ''), '-', '') AS a, replace(replace(lower(regexp_replace(regexp_replace(b.name, '^request_field:', ''), '^model_field:[^:]+:', '')), '_', ''), '-', '') AS b FROM s JOIN f a ON a.i = s.i JOIN f b ON b.i = s.j)
SELECT k, a = b OR CASE WHEN contains(a, '.') AND contains(b, '.') THEN ends_with(a, '.' || b) OR ends_with(b, '.' || a) ELSE string_split(a, '.')[-1] = string_split(b, '.')[-1] AND length(string_split(a, '.')[-1]) >= 2 END AS matched FROM c""")
def field_matches(spark, sf_dir):
    names, k = F.array(*map(F.lit, _NAMES)), F.col("s_suppkey")
    pick = lambda at: F.get(names, (at % 14).cast("int"))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("k"), ticket.fields_match(pick(k), pick(F.floor(k / 14))).alias("matched"))


# --- reports on all nodes

# The projection's calls, with some of every controller's method into the framework.
_MORE = r""", more AS (SELECT from_id, to_id, call_type FROM edges WHERE type = 'CALLS' UNION ALL SELECT id, 'Illuminate\Http\Request::input', NULL FROM cust
 UNION ALL SELECT id, 'App\Http\Request::only', NULL FROM cust UNION ALL SELECT id, 'Symfony\Mailer::send', 'INTERFACE_RESOLVED' FROM cust)"""


def _with_framework(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    made = [("Illuminate\\Http\\Request::input", None), ("App\\Http\\Request::only", None), ("Symfony\\Mailer::send", "INTERFACE_RESOLVED")]
    each = F.explode(F.array(*(F.struct(F.lit(to).alias("to_id"), F.lit("CALLS").alias("type"), F.lit(kind).cast("string").alias("call_type")) for to, kind in made)))
    added = nodes.where((F.col("type") == "method") & F.col("id").contains("Controllers")).select(F.col("id").alias("from_id"), each.alias("e")).select("from_id", "e.*")
    return edges.select("from_id", "to_id", "type", "call_type").unionByName(added)


@on_graph(rf"""{_MORE}, d AS (SELECT from_id AS target, coalesce(call_type, 'CALLS') AS kind FROM more WHERE NOT starts_with(to_id, 'Illuminate\') AND NOT starts_with(to_id, 'Symfony\') AND to_id <> 'App\Http\Request::only'
 UNION ALL SELECT from_id, call_type FROM more WHERE call_type = 'INTERFACE_RESOLVED'), k AS (SELECT target, kind, count(*) AS n FROM d GROUP BY 1, 2) SELECT target, string_agg(kind || '(' || n || ')', ', ' ORDER BY n DESC, kind) AS kinds FROM k GROUP BY 1""")
def report_dependency_kinds(nodes, edges):
    return report.kinds(report.depends_on(_with_framework(nodes, edges), _all_methods(nodes), resolved=True))


@on_graph("""SELECT target, string_agg(kind || '(' || n || ')', ', ' ORDER BY n DESC, kind) AS kinds FROM (SELECT to_id AS target, coalesce(call_type, 'CALLS') AS kind, count(*) AS n FROM edges WHERE type = 'CALLS' GROUP BY 1, 2) GROUP BY 1""")
def report_usage_kinds(nodes, edges):
    return report.kinds(report.used_by(edges, _all_methods(nodes), resolved=True))


@on_graph("SELECT e.from_id AS target, e.type AS relation, e.to_id, n.type AS node_type, n.name, n.file FROM edges e LEFT JOIN nodes n ON n.id = e.to_id WHERE e.type IN ('EXTENDS', 'IMPLEMENTS')")
def report_supertypes(nodes, edges):
    return report.supertypes(nodes, edges, nodes.where("type = 'class'").select(F.col("id").alias("target")).unionByName(edges.where("type = 'EXTENDS'").select(F.col("from_id").alias("target"))))


@on_graph("""SELECT DISTINCT unnest([c.from_id, c.to_id]) AS target, x.to_id || '::' || split_part(c.to_id, '::', 2) || ' -> ' || c.to_id AS resolution FROM edges c JOIN edges x ON x.type = 'IMPLEMENTS' AND x.from_id = split_part(c.to_id, '::', 1)
WHERE c.type = 'CALLS' AND c.call_type = 'INTERFACE_RESOLVED'""")
def report_resolutions(nodes, edges):
    owners = edges.where("type = 'IMPLEMENTS'").select(F.col("from_id").alias("owner"), F.col("to_id").alias("face"))
    told = edges.withColumn("owner", F.substring_index("to_id", "::", 1)).join(owners, "owner", "left").withColumn("via", F.concat("face", F.lit("::"), F.substring_index("to_id", "::", -1)))
    return report.resolutions(told, _all_methods(nodes))


@on_graph(r""", up AS (SELECT from_id AS target, from_id, to_id FROM calls UNION ALL SELECT m.id, d.to_id, d.from_id FROM members m JOIN edges d ON d.type = 'DEPENDS_ON' AND d.to_id = m.parent),
ranked AS (SELECT *, CASE WHEN contains(from_id, 'Repositor') THEN 'Repository(3)' WHEN contains(from_id, 'Services') THEN 'Service(2)' ELSE 'Controller(0)' END AS low, CASE WHEN contains(to_id, 'Repositor') THEN 'Repository(3)' WHEN contains(to_id, 'Services') THEN 'Service(2)' ELSE 'Controller(0)' END AS high FROM up)
SELECT target, from_id, to_id, low || ' → ' || high || ' — lower layer calls upper layer' AS text FROM ranked WHERE regexp_extract(low, '\d') > regexp_extract(high, '\d')""")
def report_layer_breaks(nodes, edges):
    # Dependencies the other way round, so that services depend on controllers.
    turned = edges.where("type = 'DEPENDS_ON'").select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "type", "call_type")
    return report.layer_breaks(nodes, edges.where("type = 'CALLS'").select("from_id", "to_id", "type", "call_type").unionByName(turned), _all_methods(nodes), dependencies=True)


@on_graph(", used AS (SELECT to_id FROM calls UNION SELECT to_id FROM edges WHERE type = 'ROUTES_TO') SELECT id FROM nodes LEFT JOIN used ON to_id = id WHERE type = 'method' AND visibility = 'public' AND to_id IS NULL")
def report_unused(nodes, edges):
    return report.unused(nodes, edges)


_FLOWS = r"""seeds AS (SELECT parent AS ticket, id FROM nodes WHERE type = 'method' AND parent IS NOT NULL),
touching AS (SELECT ticket, from_id, to_id, type, row_number() OVER (PARTITION BY ticket ORDER BY CASE type WHEN 'ROUTES_TO' THEN 1 WHEN 'READS_FIELD' THEN 2 WHEN 'VALIDATES' THEN 3 WHEN 'VALIDATES_FIELD' THEN 4 WHEN 'ASSIGNS' THEN 5 WHEN 'FLOWS_TO' THEN 6 WHEN 'ARGUMENT_TO' THEN 7 ELSE 8 END, from_id, to_id) AS rank
 FROM (SELECT DISTINCT ticket, e.* FROM (SELECT row_number() OVER () AS number, from_id, to_id, type FROM edges WHERE type IN ('ROUTES_TO', 'CALLS', 'READS_FIELD', 'VALIDATES', 'VALIDATES_FIELD', 'ASSIGNS', 'FLOWS_TO', 'ARGUMENT_TO')) e JOIN seeds ON id = from_id OR id = to_id)),
flows AS (SELECT * FROM touching WHERE rank <= 40 AND NOT regexp_matches(lower(from_id || ' ' || to_id), 'log::|illuminate\\|psr\\log|facade'))"""


def _method_seeds(nodes):
    """Every class is a ticket, and its methods are the seeds."""
    return nodes.where("type = 'method' and parent is not null").select(F.col("parent").alias("ticket"), "id")


@on_graph(f", {_FLOWS} SELECT ticket, from_id, to_id, type, rank FROM flows")
def related_flows(nodes, edges):
    return ticket.related_flows(edges, _method_seeds(nodes))


@on_graph(f""", {_FLOWS} SELECT ticket, id, 10 + CASE WHEN i AND o THEN 140 WHEN i OR o THEN 40 ELSE 0 END AS score FROM
 (SELECT ticket, id, EXISTS (SELECT 1 FROM flows f WHERE f.ticket = s.ticket AND f.to_id = s.id) AS i, EXISTS (SELECT 1 FROM flows f WHERE f.ticket = s.ticket AND f.from_id = s.id) AS o FROM seeds s)""")
def flow_rerank(nodes, edges):
    seeds = _method_seeds(nodes)
    return ticket.rerank_by_flows(seeds.withColumn("score", F.lit(10)), ticket.related_flows(edges, seeds))
