from symbolgraph.sources import js

API = """import { get as g, useThing } from './lib/things';
import axios from 'axios';
// function commented() {}
export async function load(id) { return axios.get(`/api/orders/${id}?x=1`); }
const local = (a) => a;
function other() { local(1); useThing(); fetch('/api/ping'); }
"""
THINGS = "export const useThing = () => 1;\nexport class Box {}\n"
VUE = "<template>\n<div>useThing()</div>\n</template>\n<script setup>\nimport { useThing } from '@/lib/things'\nuseThing()\n</script>\n"


def test_js_graph(spark):
    files = spark.createDataFrame([("src/api.js", API), ("src/lib/things.ts", THINGS), ("src/Page.vue", VUE), ("src/none.vue", "<template>\n</template>")], "file string, content string")
    code = js.scripts(files)
    known = js.nodes(code)
    kinds = {r.id: r.type for r in known.collect()}
    assert kinds["js:src/lib/things.ts::useThing"] == "composable" and kinds["js:src/api.js::local"] == "method" and kinds["js:src/lib/things.ts::Box"] == "class"
    assert kinds["js:src/Page.vue::Page"] == "vue_component" and "js:src/api.js::commented" not in kinds
    found = {(r.from_id, r.to_id, r.type, r.confidence) for r in js.edges(code, known, {"@/": "src/"}).collect()}
    assert ("js:src/api.js", "js:src/lib/things.ts", "IMPORTS", None) in found and ("js:src/Page.vue", "js:src/lib/things.ts", "IMPORTS", None) in found
    assert ("js:src/Page.vue", "js:src/lib/things.ts::useThing", "CALLS", 0.8) in found and ("js:src/api.js", "js:src/api.js::local", "CALLS", 0.4) in found
    requests = {b for a, b, t, _ in found if t == "HTTP_REQUEST"}
    assert requests == {"api:GET:/api/orders/{param}", "api:GET:/api/ping"}
    routes = spark.createDataFrame([("api:GET:/api/orders/{order}", "C::show", "ROUTES_TO")], "from_id string, to_id string, type string")
    links = js.link_requests(js.edges(code, known), routes)
    assert [(r.from_id, r.to_id) for r in links.collect()] == [("api:GET:/api/orders/{param}", "api:GET:/api/orders/{order}")]
