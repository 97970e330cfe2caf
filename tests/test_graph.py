"""Small graphs with known answers."""

import pytest
from pyspark.sql import functions as F

from symbolgraph.operators import cycles, deadcode, hierarchy, impact, navigation, report, resolve, search, ticket
from symbolgraph.sources import scan
from symbolgraph.sources.store import Graph, load, load_json, merge_absent

SHIP = "App\\Http\\Controllers\\ParcelController::ship"
EDGE = "from_id string, to_id string, type string, call_type string, via string, argument_index int"


def edges(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], EDGE)


@pytest.fixture(scope="module")
def parcels(spark):
    nodes = spark.createDataFrame(
        [
            (SHIP, SHIP.split("::")[0], "method", "ship", "ParcelController.php", "public"),
            ("api:PUT:api/parcels", None, "api_endpoint", "PUT api/parcels", None, None),
            ("api:GET:/desk/ship", None, "api_endpoint", "GET /desk/ship", None, None),
            ("resources/views/parcels/label.blade.php", None, "blade_view", "label", None, None),
            ("request_field:weight", None, "request_field", "weight", None, None),
            (SHIP + "::$box.weight", SHIP, "variable_field", "$box.weight", None, None),
        ],
        "id string, parent string, type string, name string, file string, visibility string",
    )
    links = [
        ("api:PUT:api/parcels", SHIP, "ROUTES_TO"),
        ("api:GET:/desk/ship", SHIP, "ROUTES_TO"),
        ("resources/views/parcels/label.blade.php", SHIP, "BLADE_USES_ACTION"),
        ("request_field:weight", SHIP + "::$box.weight", "ASSIGNS"),
        (SHIP, f"validation:{SHIP}:weight", "VALIDATES"),
    ]
    return Graph(nodes, edges(spark, links).withColumn("id", F.concat_ws("->", "from_id", "to_id")))


def test_search(parcels):
    ids = lambda q, kind=None: [r.id for r in search.find(parcels.nodes, q, kind).collect()]
    assert SHIP in ids("ParcelController")
    assert "api:PUT:api/parcels" in ids("PUT api/parcels", "route")
    assert "request_field:weight" in ids("weight", "field")
    assert search.detect_kind("PUT api/parcels") == "route" and search.detect_kind("model_field:x") == "field"


def test_navigation(parcels):
    entries = navigation.incoming_entries(parcels.edges, SHIP).collect()
    assert [r.kind for r in entries] == ["route", "route", "blade"]
    assert navigation.method_edges(parcels.edges, SHIP, ["ASSIGNS", "VALIDATES"]).count() == 2


def test_contexts_of_methods_and_classes(spark, parcels):
    targets = spark.createDataFrame([(SHIP,), ("App\\None::x",)], "target string")
    found = navigation.contexts(parcels.nodes, parcels.edges, targets)
    assert {(r.section, r.n) for r in navigation.entry_counts(found).collect()} == {("route", 2), ("view", 1), ("entry", 3), ("intake", 1), ("validates", 1)}
    warned = {r.target: 0 for r in navigation.warnings(parcels.edges, targets, found).collect()}
    assert warned == {"App\\None::x": 0}
    labels = [r.label for r in navigation.suggested(parcels.edges, targets, found).orderBy("place").collect()]
    assert labels == ["GET /desk/ship", "PUT api/parcels", "resources/views/parcels/label.blade.php", "request:weight", "ParcelController::ship::$box.weight"]
    classes = navigation.class_contexts(parcels.nodes, parcels.edges, spark.createDataFrame([(SHIP.split("::")[0],)], "target string"))
    assert classes.where("section = 'route'").count() == 2


def test_search_scores(spark):
    nodes = spark.createDataFrame([("A\\Box", "class", "Box", "src/Box.php"), ("A\\Boxes", "class", "Boxes", "src/b.php"), ("A\\C", "parameter", "x", "src/box/c.php"), ("box", "composable", "box", None), ("api:PUT:/box/9", "api_endpoint", "put", None)], "id string, type string, name string, file string")
    assert [(r.id, r.score) for r in search.find(nodes, "box").collect()] == [("box", 1000), ("A\\Box", 900), ("A\\Boxes", 700), ("A\\C", 400)]
    assert [(r.id, r.score) for r in search.find(nodes, "put /box/9 ").collect()] == [("api:PUT:/box/9", 300)]
    assert search.find(nodes, " ").count() == 0


def test_tickets_of_whole_words(spark):
    nodes = spark.createDataFrame([("a_box", "n", None, None), ("abox", "n", None, None)], "id string, name string, file string, parent string")
    assert [r.id for r in ticket.mentions(nodes, ["box"]).collect()] == ["a_box"]
    rows = spark.createDataFrame([(1, "nightly import of the xml feed"), (2, "lorem ipsum"), (3, None)], "id int, text string")
    best = {r.id: (r.workflow, r.score, r.confidence) for r in ticket.dominant_workflow(ticket.workflow_scores(rows, "id", "text"), "id").collect()}
    assert best[1] == ("import", 150, 0.95) and best[2][0] == best[3][0] == "unknown"


def test_flow_filters(spark):
    e = edges(spark, [("a", "m", "FLOWS_TO", None, "v"), ("a", "p", "ARGUMENT_TO", None, "v"), ("b", "m", "FLOWS_TO"), ("m", "request_field:x", "READS_FIELD"), ("request_field:x", "y", "ASSIGNS"), ("m", "request_field:z", "READS_FIELD")])
    assert {(r.from_id, r.type) for r in navigation.field_flow(e).collect()} == {("a", "ARGUMENT_TO"), ("b", "FLOWS_TO")}
    assert {r.to_id for r in navigation.field_intake(e).collect()} == {"y", "request_field:z"}


def test_impact_of_entries(spark, parcels):
    seeds = spark.createDataFrame([(SHIP,)], "seed string")
    r = impact.report(parcels.nodes, impact.impact_edges(parcels.edges), seeds, depth=1).first()
    assert (r.callers, r.direct_entries, r.direct_callers, r.score, r.risk) == (3, 3, 0, 14.0, "MEDIUM")


def test_impact_decays_and_expands_once(spark):
    e = edges(spark, [("b", "a", "CALLS"), ("c", "b", "CALLS"), ("c", "a", "CALLS"), ("d", "c", "CALLS"), ("a", "b", "CALLS"), ("x", "a", "CALLS", "INTERFACE_RESOLVED")])
    seeds = spark.createDataFrame([("a",)], "seed string")
    got = {r.from_id: (r.score, r.distance) for r in impact.callers(impact.upstream(impact.impact_edges(e), seeds, 3)).collect()}
    assert got == {"b": (5.0, 1), "c": (8.0, 1), "d": (3.0, 2)}


def test_impact_summary_and_lists_by_hand(spark):
    e = edges(spark, [("b", "a", "CALLS"), ("c", "b", "CALLS"), ("c", "a", "EXTENDS"), ("a", "b", "CALLS"), ("a", "d", "DEPENDS_ON"), ("a", "d", "DEPENDS_ON"), ("d", "a", "ROUTES_TO")])
    nodes = spark.createDataFrame([("a", "fa"), ("b", "fb"), ("c", "fb"), ("d", None), ("z", None)], "id string, file string")
    every = impact.impact_edges(e, dependencies=True)
    seeds = spark.createDataFrame([("a",), ("a",), ("z",)], "seed string")
    got = {r.seed: r.asDict() for r in impact.summary(nodes, every, seeds).collect()}
    counts = {"direct_callers": 3, "call_chain_callers": 1, "direct_entries": 1, "indirect_callers": 0, "callers": 3, "inspected_edges": 10, "callees": 2, "dependency_links": 1, "inheritance_links": 1, "impacted_nodes": 3, "affected_files": 2}
    scores = {"direct_score": 13.0, "indirect_score": 3.0, "callee_score": 6.0, "dependency_score": 4.0, "inheritance_score": 3.0, "score": 22.0, "risk": "HIGH"}
    assert got["a"] == {"seed": "a"} | counts | scores
    assert got["z"] == {"seed": "z"} | dict.fromkeys(counts, 0) | dict.fromkeys(scores, 0.0) | {"risk": "LOW"}
    lists = {}
    for r in impact.top_lists(every, seeds, limit=4).orderBy("list", "rank").collect():
        lists.setdefault(r.list, []).append((r.id, r.score, r.distance))
    assert lists == {"callers": [("c", 6.0, 1), ("b", 5.0, 1), ("d", 5.0, 1)], "callees": [("d", 4.0, 1), ("b", 2.0, 1)], "impacted": [("c", 6.0, 1), ("b", 5.0, 1), ("d", 5.0, 1), ("d", 4.0, 1)]}


def test_related_flows_and_rerank(spark):
    e = edges(spark, [("a", "b", "CALLS"), ("r", "a", "ROUTES_TO"), ("a", "f", "READS_FIELD"), ("a", "g", "EXTENDS"), ("a", "Illuminate\\Http", "ASSIGNS"), ("x", "y", "CALLS"), ("a", "a", "FLOWS_TO"), ("b", "c", "CALLS")])
    seeds = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "y")], "ticket int, id string")
    got = [tuple(r) for r in ticket.related_flows(e, seeds).orderBy("ticket", "rank").collect()]
    assert got == [(1, "r", "a", "ROUTES_TO", 1), (1, "a", "f", "READS_FIELD", 2), (1, "a", "a", "FLOWS_TO", 4), (1, "a", "b", "CALLS", 5), (1, "b", "c", "CALLS", 6), (2, "x", "y", "CALLS", 1)]
    few = ticket.related_flows(e, seeds, limit=3)  # noise takes its place before it goes
    assert few.where("ticket = 1").count() == 2
    matches = spark.createDataFrame([(1, "a", 5), (1, "f", 5), (1, "zz", 5), (2, "y", 1), (2, "a", 1)], "ticket int, id string, score int")
    assert {(r.ticket, r.id): r.score for r in ticket.rerank_by_flows(matches, ticket.related_flows(e, seeds)).collect()} == {(1, "a"): 145, (1, "f"): 45, (1, "zz"): 5, (2, "y"): 41, (2, "a"): 1}


def dead_nodes(spark, rows):
    return Graph(spark.createDataFrame(rows, "id string, parent string, type string, name string, file string, visibility string, is_abstract boolean"), edges(spark, [("q", "q", "CALLS")])).nodes


def test_methods_that_implement_abstract_ones_are_not_dead(spark):
    nodes = dead_nodes(spark, [("Shape", None, "class", "Shape", None, None, None), ("Shape::outline", "Shape", "method", "outline", None, "public", True), ("Circle", None, "class", "Circle", None, None, None), ("Circle::outline", "Circle", "method", "outline", None, "public", None), ("Circle::label", "Circle", "method", "label", None, "public", None)])
    found = {r.id for r in deadcode.dead(nodes, edges(spark, [("Circle", "Shape", "EXTENDS")])).collect()}
    assert "Circle::label" in found and "Circle::outline" not in found


def test_methods_that_overriding_reaches_are_not_dead(spark):
    rows = [(c, None, "class", c, None, None, None) for c in ("Base1", "Child1")] + [(f"{c}::keep", c, "method", "keep", None, "public", None) for c in ("Base1", "Child1")]
    nodes, e = dead_nodes(spark, rows), edges(spark, [("Child1", "Base1", "EXTENDS"), ("Till::close", "Base1::keep", "CALLS")])
    more = resolve.override_calls(nodes, e)
    assert [(r.from_id, r.to_id, r.via) for r in more.collect()] == [("Till::close", "Child1::keep", "Base1::keep")]
    e = e.unionByName(more.withColumn("type", F.lit("CALLS")), allowMissingColumns=True)
    assert deadcode.dead(nodes, e).isEmpty()


def test_abstract_and_interface_calls(spark):
    nodes = dead_nodes(spark, [("A", None, "class", "A", None, None, None), ("A::m", "A", "method", "m", None, "public", True), ("B", None, "class", "B", None, None, None), ("B::m", "B", "method", "m", None, "public", None), ("I", None, "interface", "I", None, None, None)])
    e = edges(spark, [("B", "A", "EXTENDS"), ("C::x", "A::m", "CALLS"), ("B", "I", "IMPLEMENTS"), ("C::y", "I::m", "CALLS"), ("C::y", "I::missing", "CALLS")])
    assert [(r.from_id, r.to_id) for r in resolve.extends_calls(nodes, e).collect()] == [("C::x", "B::m")]
    assert [(r.from_id, r.to_id) for r in resolve.interface_calls(nodes, e).collect()] == [("C::y", "B::m")]
    assert resolve.prune_external_extends(nodes, edges(spark, [("A", "Out", "EXTENDS"), ("B", "A", "EXTENDS")])).count() == 1


def test_arguments_views_and_endpoints(spark):
    e = edges(spark, [("s", "m", "FLOWS_TO", None, "b", 0), ("s", "m", "FLOWS_TO", None, "a", 0), ("m", "m::$p", "HAS_PARAMETER", None, None, 0), ("v", "blade_method_ref:HEADING", "BLADE_METHOD_CALL")])
    assert [(r.from_id, r.to_id, r.via) for r in resolve.argument_edges(e).collect()] == [("s", "m::$p", "a")]
    nodes = dead_nodes(spark, [("P::heading", "P", "method", "heading", None, "public", None), ("api:GET:/a/{id}", None, "api_endpoint", "x", None, None, None), ("api:GET:api/a/${x}/", None, "api_endpoint", "x", None, None, None)])
    assert [(r.from_id, r.to_id) for r in resolve.view_calls(nodes, e).collect()] == [("v", "P::heading")]
    assert [(r.from_id, r.to_id) for r in resolve.link_endpoints(nodes).collect()] == [("api:GET:api/a/${x}/", "api:GET:/a/{id}")]


def test_cycles(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "from_id string, to_id string")
    assert sorted("".join(r.nodes) for r in cycles.simple_cycles(pairs).collect()) == ["aba", "abca"]
    assert sorted("".join(r.nodes) for r in cycles.simple_cycles(pairs, start="b").collect()) == ["bab", "bcab"]
    assert cycles.adjacency(edges(spark, [("a", "a", "CALLS"), ("a", "b", "CALLS")])).count() == 1


def test_closure_ends_on_cycles(spark):
    e = edges(spark, [("a", "b", "EXTENDS"), ("b", "c", "EXTENDS"), ("c", "d", "EXTENDS"), ("d", "b", "EXTENDS")])
    got = {(r.child, r.ancestor): r.depth for r in hierarchy.closure(e).collect()}
    assert got[("a", "d")] == 3 and got[("d", "c")] == 2 and ("b", "b") not in got


def test_sources(spark, tmp_path):
    (tmp_path / "app" / "vendor").mkdir(parents=True)
    (tmp_path / "app" / "vendor" / "x.php").write_text("<?php")
    (tmp_path / "app" / "label.blade.php").write_text("@extends('frames.main') @include('part') <x-tile /> {{ route('door') }} {{ $page->heading() }} action([DoorController::class, 'shut'])")
    files = scan.read_sources(spark, str(tmp_path), "php")
    assert [r.file for r in files.collect()] == ["app/label.blade.php"]
    found = {(r.type, r.to_id) for r in scan.blade_edges(files).collect()}
    assert found == {("BLADE_EXTENDS", "view:frames.main"), ("BLADE_INCLUDES", "view:part"), ("BLADE_INCLUDES", "view:components.tile"), ("BLADE_USES_ROUTE", "route:door"), ("BLADE_METHOD_CALL", "blade_method_ref:heading"), ("BLADE_USES_ACTION", "DoorController::shut")}
    routes = spark.createDataFrame([("routes/api.php", "use App\\Http\\PayController;\nRoute::post('/pay', [PayController::class, 'pay']); Route::apiResource('orders', OrderController::class);")], "file string, content string")
    got = {(r.verb, r.path, r.controller, r.action) for r in scan.routes(routes).collect()}
    assert ("POST", "/pay", "App\\Http\\PayController", "pay") in got and ("GET", "orders/{order}", "OrderController", "show") in got and len(got) == 7


def test_store(spark, parcels, tmp_path):
    parcels.save(str(tmp_path / "p"))
    parcels.save_json(str(tmp_path / "j"))
    assert load(spark, str(tmp_path / "p")).nodes.count() == 6
    again = load_json(spark, str(tmp_path / "j"))
    assert again.edges.count() == 5 and again.edges.where("id like '%ROUTES_TO'").count() == 2
    assert merge_absent(parcels, again).nodes.count() == 6


def test_tickets(spark, parcels):
    tickets = spark.createDataFrame([(1, "The parcel label must validate the weight")], "t int, text string")
    got = ticket.rank(parcels.nodes, tickets, "t", "text").orderBy("rank").collect()
    assert got and any("weight" in r.id for r in got[:3])
    fields = spark.createDataFrame([("box.weight",)], "field string")
    layers = {r.layer for r in ticket.field_layers(parcels.nodes, parcels.edges, fields).collect()}
    assert layers == {"request_input", "data_flow"}


def test_report_counts_resolved_calls_twice_and_leaves_the_framework_out(spark):
    resolved = "INTERFACE_RESOLVED"
    edges = spark.createDataFrame(
        [
            ("Shop\\Till::pay", "Shop\\Bank::take", "CALLS", None, None),
            ("Shop\\Till::pay", "Shop\\Bank::take", "CALLS", resolved, "Shop\\Payer::take"),
            ("Shop\\Till::pay", "Illuminate\\Support\\Str::slug", "CALLS", None, None),
            ("Shop\\Till::pay", "Psr\\Log\\Logger::info", "CALLS", resolved, "Psr\\Log\\Face::info"),
            ("Shop\\Till::pay", "App\\Http\\Request::inputs", "CALLS", None, None),
            ("Shop\\Till", "Gone\\Base", "EXTENDS", None, None),
        ],
        "from_id string, to_id string, type string, call_type string, via string",
    )
    targets = spark.createDataFrame([("Shop\\Till::pay",), ("Shop\\Till::pay",), ("Shop\\Till",), ("Shop\\Bank::take",), (None,)], "target string")
    found = lambda df: sorted(tuple(r) for r in df.collect())
    assert found(report.kinds(report.depends_on(edges, targets, resolved=True))) == [("Shop\\Till::pay", "INTERFACE_RESOLVED(3), CALLS(2)")]
    assert found(report.kinds(report.depends_on(edges, targets))) == [("Shop\\Till::pay", "CALLS(2)")]
    assert found(report.kinds(report.used_by(edges, targets, resolved=True))) == [("Shop\\Bank::take", "CALLS(1), INTERFACE_RESOLVED(1)")]
    assert found(report.resolutions(edges, targets)) == [
        ("Shop\\Bank::take", "Shop\\Payer::take -> Shop\\Bank::take"),
        ("Shop\\Till::pay", "Psr\\Log\\Face::info -> Psr\\Log\\Logger::info"),
        ("Shop\\Till::pay", "Shop\\Payer::take -> Shop\\Bank::take"),
    ]
    nodes = spark.createDataFrame([("Shop\\Till", None, "class", "Till", "till.php", None)], "id string, parent string, type string, name string, file string, visibility string")
    assert [tuple(r) for r in report.supertypes(nodes, edges, targets).collect()] == [("Shop\\Till", "EXTENDS", "Gone\\Base", None, None, None)]


def test_report_layers_are_told_by_what_the_class_contains(spark):
    steps = [
        ("A\\OrderServiceController::go", "A\\DomainThing::x"),  # Controller comes first: rank 0
        ("A\\OrderService::go", "A\\HttpClient::x"),
        ("A\\Repositories\\Order::go", "A\\UseCases\\Pay::x"),
        ("A\\Plain::go", "A\\HttpClient::x"),
        ("A\\Plain::Service", "A\\HttpClient::x"),  # the method's name doesn't count
        ("A\\HttpClient::x", "A\\PresentationThing::y"),  # equal ranks
    ]
    edges = spark.createDataFrame([(a, b, "CALLS", None) for a, b in steps] + [("A\\Infrastructure\\Mail", "A\\Domain\\Post", "DEPENDS_ON", None)], "from_id string, to_id string, type string, call_type string")
    nodes = spark.createDataFrame([("A\\Infrastructure\\Mail::send", "A\\Infrastructure\\Mail", "method", "send", None, "public")], "id string, parent string, type string, name string, file string, visibility string")
    targets = edges.selectExpr("from_id as target").unionByName(nodes.selectExpr("id as target"))
    found = {r.target: r.text for r in report.layer_breaks(nodes, edges, targets, dependencies=True).collect() if "::" in r.target}
    assert found == {
        "A\\OrderService::go": "Service(2) → Http(0) — lower layer calls upper layer",
        "A\\Repositories\\Order::go": "Repositories(3) → UseCase(1) — lower layer calls upper layer",
        "A\\Infrastructure\\Mail::send": "Infrastructure(5) → Domain(4) — lower layer calls upper layer",
    }
    assert [r.id for r in report.unused(nodes, edges).collect()] == ["A\\Infrastructure\\Mail::send"]
