"""Data flow, property types, route groups, anchors, merges and configuration on small cases with known answers."""

import pytest
from pyspark.sql import functions as F

from symbolgraph.operators import anchors, architecture, candidates, dataflow, fixpoint, hierarchy, infrastructure, merge, property_types
from symbolgraph.sources import config, imports, routes, statements


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_fields_flow_through_statements(spark):
    body = """
    $name = $request->input('name');
    $data['total'] = $request->input("amount");
    $dto = $data;
    $form = new Form($name, 5, $dto);
    $this->payments->process($dto, 7, $form);
    if ($ok) { return $request->input('late'); }
    $late = $name == $dto;
    """
    found = statements.statements(spark.createDataFrame([("C::pay", body)], "id string, body string"))
    assert rows(dataflow.reads(found), "to_id") == [("request_field:amount",), ("request_field:late",), ("request_field:name",)]
    assert rows(dataflow.assigns(found), "from_id", "to_id") == [("request_field:amount", "C::pay::$data.total"), ("request_field:name", "C::pay::$name")]
    called = found.withColumn("callee", F.when(F.col("called") == "process", "P::process"))
    flows = dataflow.flows_to(called, dataflow.facts(called))
    assert rows(flows, "from_id", "to_id", "argument_index") == [("C::pay::$dto.total", "P::process", 0), ("C::pay::$form", "P::process", 2), ("C::pay::$form.total", "P::process", 2)]


def test_facts_take_the_earliest_way_and_go_through_calls(spark):
    schema = "method string, at int, kind string, target string, source string, path string, field string, direct boolean, callee string, argument_index int"
    made = [
        ("A", 1, "input", "$a", None, None, "f", True, None, None), ("A", 9, "copy", "$z", "$a", None, None, None, None, None), ("A", 2, "copy", "$b", "$a", None, None, None, None, None), ("A", 3, "copy", "$z", "$b", None, None, None, None, None),
        ("A", 4, "pass", None, "$z", None, None, None, "B", 0), ("A", 0, "pass", None, "$a", None, None, None, "B", 1), ("B", 5, "copy", "$y", "$p", None, None, None, None, None), ("B", 6, "pass", None, "$y", None, None, None, "A", 0),
    ]
    given = spark.createDataFrame(made, schema)
    parameters = spark.createDataFrame([("A", "$q", 0), ("B", "$p", 0), ("B", "$o", 1)], "method string, variable string, argument_index int")
    found = dataflow.facts(given, parameters)
    assert ("A", "$z", 3) in rows(found, "method", "variable", "since") and len(rows(found)) == len(set(rows(found, "method", "variable", "key", "field")))
    assert rows(dataflow.reached(found, parameters)) == [("f", "A::$q"), ("f", "B::$p")]
    assert rows(dataflow.flows_to(given, dataflow.facts(given)), "from_id", "to_id") == [("A::$z", "B")]


def test_fixpoints_raise_at_their_bound(spark):
    seed = spark.createDataFrame([(0,)], "n int")
    grow = lambda fresh: fresh.select((F.col("n") + 1).alias("n")).where("n < 6")
    assert rows(fixpoint.everything(seed, grow)) == [(n,) for n in range(6)]
    with pytest.raises(RuntimeError):
        fixpoint.everything(seed, grow, most=3)


def test_hierarchies_are_climbed_to_the_root(spark):
    chain = [(f"C{k}", f"C{k + 1}", "EXTENDS") for k in range(40)] + [("X", "Y", "EXTENDS"), ("Y", "X", "EXTENDS")]
    edges = spark.createDataFrame(chain, "from_id string, to_id string, type string")
    found = hierarchy.closure(edges)
    assert found.where("child = 'C0'").count() == 40 and found.where("child = 'C0' and ancestor = 'C40'").first().depth == 40
    methods = [("C40::m", "C40", "method", "m")] + [(f"C{k}", None, "class", f"C{k}") for k in range(41)]
    nodes = spark.createDataFrame(methods, "id string, parent string, type string, name string")
    assert hierarchy.resolve_method(nodes, edges).where("cls = 'C0'").first().target == "C40::m"


def test_types_go_down_eight_levels(spark):
    edges = spark.createDataFrame([(f"C{k}", f"C{k + 1}", "EXTENDS") for k in range(10)] + [("A", "B", "EXTENDS"), ("B", "A", "EXTENDS")], "from_id string, to_id string, type string")
    types = spark.createDataFrame([("C9", "p", "Root"), ("C2", "p", "Own"), ("A", "p", "TA"), ("B", "p", "TB")], "class string, property string, type string")
    found = dict((r["class"], r["type"]) for r in property_types.propagate(types, edges).collect())
    assert found == {"C0": "Own", **{f"C{k}": "Root" for k in range(1, 10)}, "A": "TA", "B": "TB"}  # an even number of passes swaps back


def test_routes_nest(spark):
    source = """<?php
use App\\A\\PayController;
use App\\B\\Other as Renamed;
Route::prefix('outer')->group(function () {
    Route::get('/x/{id}', [PayController::class, 'show']);
    Route::group(['middleware' => 'auth', 'prefix' => 'inner'], function () { Route::post('pay', [Renamed::class, 'pay']); });
    Route::delete('plain', PayController::class);
});
Route::resource('things', \\App\\C\\ThingController::class)->except(['destroy', 'update']);
Route::get('none', function () { return view('x'); });
Route::get('open', [PayController::class
"""
    files = spark.createDataFrame([("routes/web.php", source), ("app/x.php", source), ("routes/none.php", None), ("routes/empty.php", "")], "file string, content string")
    assert rows(routes.routes(files), "verb", "path", "controller", "action") == [
        ("DELETE", "outer/plain", "App\\A\\PayController", "plain"), ("GET", "/things", "App\\C\\ThingController", "index"), ("GET", "/things/{param}", "App\\C\\ThingController", "show"), ("GET", "outer/x/{id}", "App\\A\\PayController", "show"),
        ("POST", "/things", "App\\C\\ThingController", "store"), ("POST", "outer/inner/pay", "App\\B\\Other", "pay"),
    ]
    assert ("api:GET:outer/x/{param}", "App\\A\\PayController::show", "ROUTES_TO") in rows(routes.route_edges(routes.routes(files)))


def test_layers_of_the_plural_keep_their_names(spark):
    edges = spark.createDataFrame([("A\\Domain\\X::a", "A\\Repositories\\Y::b", "CALLS", None), ("A\\Controllers\\X::a", "A\\Http\\Y::b", "CALLS", None), ("A\\Services\\X::a", "A\\UseCases\\Y::b", "DEPENDS_ON", None)], "from_id string, to_id string, type string, call_type string")
    assert rows(architecture.violations(edges), "detected", "expected") == [("Domain → Repositories", "Service → Repository → Domain"), ("Services → UseCases", "UseCase → Service → Repository")]


def test_anchors_without_pairs(spark):
    nodes = spark.createDataFrame([("api:PUT:/contents/{id}/parts", "api_endpoint", "e", None), ("api:GET:/contents/{id}/access", "api_endpoint", "e", None), ("App\\Jobs\\SyncJob::handle", "method", "handle", "app/Jobs/SyncJob.php"), ("App\\SyncJobber", "class", "SyncJobber", None)], "id string, type string, name string, file string")
    edges = spark.createDataFrame([("api:PUT:/contents/{id}/parts", "App\\Jobs\\SyncJob::handle", "ROUTES_TO")], "from_id string, to_id string, type string")
    tickets = spark.createDataFrame([(1, "When PATCH api/v1/content/<id> is sent, `SyncJob` runs"), (2, "GET contents/7/access fails"), (3, None), (4, "")], "ticket int, text string")
    assert rows(anchors.route_anchors(nodes, edges, tickets), "ticket", "id", "score") == [(1, "App\\Jobs\\SyncJob::handle", 2200), (1, "api:PUT:/contents/{id}/parts", 2000), (2, "api:GET:/contents/{id}/access", 600)]
    assert rows(anchors.symbol_anchors(nodes, tickets), "ticket", "id", "score") == [(1, "App\\Jobs\\SyncJob::handle", 600), (1, "App\\SyncJobber", 250), (2, "api:GET:/contents/{id}/access", 350)]
    for plan in (anchors.route_anchors(nodes, edges, tickets), anchors.symbol_anchors(nodes, tickets)):
        assert not any(x in plan._jdf.queryExecution().toString() for x in ("NestedLoop", "CartesianProduct"))
    assert rows(anchors.unmatched(nodes, spark.createDataFrame([(5, "`NobodyHasThis` and `SyncJobber`")], "ticket int, text string"))) == [(5, "nobodyhasthis")]


def test_queue_infrastructure_is_one_component(spark):
    nodes = spark.createDataFrame([("config_literal:q", None, "config_literal", "my-expired-queue"), ("config_key:x", None, "config_literal", "a.vod"), ("C", None, "class", "C"), ("C::handle", "C", "method", "handle")], "id string, parent string, type string, name string")
    edges = spark.createDataFrame([("C::handle", "config_literal:q", "REFERENCES"), ("integration:D:sqs_consumer", "C::handle", "HAS_ROLE"), ("C", "E", "EXTENDS")], "from_id string, to_id string, type string")
    tickets = spark.createDataFrame([(1, "read my-expired-queue now"), (2, "in eu-central-1 only"), (3, None)], "ticket int, text string")
    found = infrastructure.linked(edges, infrastructure.seeds(nodes, infrastructure.queue_names(tickets)))
    assert rows(found) == [(1, "C::handle"), (1, "config_key:x"), (1, "config_literal:q"), (1, "integration:D:sqs_consumer")]
    assert rows(infrastructure.linked_classes(nodes, found)) == [(1, "C"), (1, "D")]


def test_queue_classes_are_named_once_for_tickets_that_reach_the_same(spark):
    nodes = spark.createDataFrame([("C", None, "class"), ("C::a", "C", "method"), ("C::b", "C", "method"), ("D", None, "class")], "id string, parent string, type string")
    edges = spark.createDataFrame([("C::a", "C::b", "CALLS"), ("C::b", "integration:I:sqs", "HAS_ROLE"), ("C::a", "C", "REFERENCES")], "from_id string, to_id string, type string")
    start = spark.createDataFrame([(1, "C::a"), (2, "C::b"), (3, "D"), (3, "C::a"), (4, "unknown")], "ticket int, node string")
    found = infrastructure.classes_linked(nodes, edges, start)
    assert rows(found) == rows(infrastructure.linked_classes(nodes, infrastructure.linked(edges, start))) == [(1, "C"), (1, "I"), (2, "C"), (2, "I"), (3, "C"), (3, "D"), (3, "I")]


def test_queue_infrastructure_of_a_long_chain_is_split_into_ways(spark, monkeypatch):
    monkeypatch.setattr(infrastructure, "BLOCK", 40)
    edges = spark.createDataFrame([(f"N{k}", f"N{k + 1}", "CALLS") for k in range(260)], "from_id string, to_id string, type string")
    start = spark.createDataFrame([(1, "N0"), (2, "N200"), (2, "alone"), (3, "N7"), (3, "N8")], "ticket int, node string")
    found = infrastructure.linked(edges, start)
    assert found.count() == found.distinct().count() == 3 * 261 + 1
    assert rows(found.where("node in ('N260', 'alone')")) == [(1, "N260"), (2, "N260"), (2, "alone"), (3, "N260")]
    assert infrastructure.linked(edges, start.limit(0)).count() == 0
    pairs = spark.createDataFrame([("d", "c"), ("c", "d"), ("c", "b"), ("a", "b"), ("x", "x"), ("z", "y")], "a string, b string")
    assert rows(fixpoint.components(pairs)) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("y", "y"), ("z", "y")]


def test_endpoints_merge(spark):
    schema = "id string, type string, name string, file string, keywords array<string>, description string"
    nodes = spark.createDataFrame([("api:get:/a/{x}/", "api_endpoint", "n1", None, ["k1"], "d1"), ("api:GET:/a/{y}", "api_endpoint", "n2", "f2", ["k2", "k1"], None), ("H", "method", "H", None, None, None)], schema)
    edges = spark.createDataFrame([("1", "api:GET:/a/{y}", "H", "ROUTES_TO", None), ("2", "js", "api:get:/a/{x}/", "HTTP_REQUEST", "fetch"), ("3", "js", "api:GET:/a/{y}", "HTTP_REQUEST", "fetch")], "id string, from_id string, to_id string, type string, via string")
    merged, moved = merge.merge_endpoints(nodes, edges)
    assert rows(merged) == [("H", "method", "H", None, None, None), ("api:GET:/a/{param}", "api_endpoint", "n2", "f2", ["k2", "k1"], "d1")]
    alias = "->api:GET:/a/{param}:RESOLVES_TO:"
    assert rows(moved, "id") == [("api:GET:/a/{param}->H:ROUTES_TO:",), ("api:GET:/a/{y}" + alias,), ("api:get:/a/{x}/" + alias,), ("js->api:GET:/a/{param}:HTTP_REQUEST:fetch",)]
    assert rows(merge.backend_linked(merged, moved)) == [("api:GET:/a/{param}",)]


def test_import_paths_and_constants(spark, tmp_path):
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "scan.json").write_text('{"pathAliases": {"@ui": "src/ui", "@ui/x": "lib"}}')
    aliases = imports.read_aliases(spark, str(tmp_path), ("missing.json", "broken.json", "scan.json"))
    given = spark.createDataFrame([("a/b.js", "@ui/x/y"), ("a/b.js", "@ui/z.ts"), ("apps/p/q.js", "~/r"), ("b.js", "./c"), ("a\\b.js", "../d")], "file string, source string")
    assert rows(imports.resolve(given, aliases), "path") == [("apps/p/r.js",), ("c.js",), ("d.js",), ("lib/y.js",), ("src/ui/z.ts",)]
    files = spark.createDataFrame([("m", "const HOST = 'h'; const A = `${HOST}/api/v1/a`; const B = `${A}/${id}`; const L = `${M}`; const M = `${L}`; const U = computed(() => `${B}/u`);")], "file string, content string")
    folded = imports.fold(imports.constants(files).withColumnRenamed("file", "module").drop("computed"))
    assert dict(rows(folded, "name", "value")) == {"HOST": "h", "A": "h/api/v1/a", "B": "h/api/v1/a/{id}", "L": "${M}", "M": "${L}", "U": "h/api/v1/a/{id}/u"}
    assert rows(folded.where("name = 'U'").select(imports.url_path(F.col("value")))) == [("/api/v1/a/{id}/u",)]


def test_settings_and_literals(spark):
    files = spark.createDataFrame([("x/config/jobs.php", "return ['a' => ['b' => ['c' => 'one', 'd' => 2], 'e' => 'two'], 'list' => ['p', 'q'], 'queue' => 'my-vod-queue'];"), ("x/y.php", None)], "file string, content string")
    assert rows(config.settings(files), "key", "value") == [("jobs.a.b.c", "one"), ("jobs.a.e", "two"), ("jobs.queue", "my-vod-queue")]
    assert rows(config.literals(files), "literal") == [("my-vod-queue",)]


def test_first_branch_wins(spark):
    schema = "ticket int, id string, score int, reason string"
    a, b, c = (spark.createDataFrame(r, schema) for r in ([(1, "x", 5, "a")], [(1, "x", 9, "b"), (1, "y", 5, "b")], [(1, "y", 5, "c"), (1, "z", 5, "c")]))
    assert rows(candidates.merge_anchors(a, b, c), "id", "score", "reason", "rank") == [("x", 5, "a", 1), ("y", 5, "b", 2), ("z", 5, "c", 3)]
