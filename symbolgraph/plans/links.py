"""Registered queries on endpoints, import paths, constants, configuration and merged candidates, dealt to the driver's
tables by their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolgraph.operators import candidates, merge
from symbolgraph.plans.catalog import query
from symbolgraph.sources import config, imports

#: Endpoints of routes, and how four kinds of clients spell them.
_SPELLED = """ends AS (SELECT DISTINCT 'api:GET:/p' || p_partkey % 200 || '/{id}' AS id, 'H' || p_partkey % 200 AS handler, p_partkey % 200 AS k FROM part),
asked AS (SELECT p_partkey, p_partkey % 200 AS k, p_partkey // 200 % 4 AS v, CASE p_partkey // 200 % 4 WHEN 0 THEN 'api:get:/p' || p_partkey % 200 || '/{presetId}/' WHEN 1 THEN 'api:GET://p' || p_partkey % 200 || '/${x}' WHEN 2 THEN 'api:GET:/p' || p_partkey % 200 || '/{param}' ELSE 'api:POST:/q' || p_partkey END AS id FROM part),
raw_nodes AS (SELECT id, 'api_endpoint' AS type, id AS name, 'routes.php' AS file, ['b'] AS keywords, NULL AS description FROM ends UNION ALL SELECT DISTINCT id, 'api_endpoint', id, NULL, CASE WHEN v = 3 THEN NULL ELSE ['c' || k % 3, 'v' || v] END, CASE WHEN k % 5 = 0 THEN 'd' || v END FROM asked UNION ALL SELECT DISTINCT handler, 'method', handler, 'h.php', NULL, NULL FROM ends),
raw_edges AS (SELECT 'r' || k AS id, id AS from_id, handler AS to_id, 'ROUTES_TO' AS type, NULL AS via, NULL AS reason FROM ends UNION ALL SELECT 'e' || p_partkey, 'js:f' || p_partkey, id, 'HTTP_REQUEST', 'fetch', NULL FROM asked UNION ALL SELECT DISTINCT 's' || k || '-' || v, 'js:same', id, 'HTTP_REQUEST', NULL, 'v' || v FROM asked),
same AS (SELECT id, 'api:' || upper(split_part(id, ':', 2)) || ':' || regexp_replace(regexp_replace(regexp_replace(substr(id, length(split_part(id, ':', 2)) + 6), '\\$?\\{[^}]+\\}', '{param}', 'g'), '/+', '/', 'g'), '/$', '') AS one FROM raw_nodes WHERE type = 'api_endpoint'),
kept AS (SELECT n.*, coalesce(one, n.id) AS one, row_number() OVER (PARTITION BY coalesce(one, n.id) ORDER BY n.id <> coalesce(one, n.id), n.id) AS r FROM raw_nodes n LEFT JOIN same USING (id)),
moved AS (SELECT e.id, coalesce(a.one, from_id) AS from_id, coalesce(b.one, to_id) AS to_id, type, via, reason FROM raw_edges e LEFT JOIN same a ON a.id = from_id LEFT JOIN same b ON b.id = to_id UNION ALL SELECT '', id, one, 'RESOLVES_TO', NULL, 'Cross-language endpoint alias merged to canonical route node' FROM same WHERE id <> one),
merged AS (SELECT from_id || '->' || to_id || ':' || type || ':' || coalesce(via, '') AS id, * EXCLUDE (id) FROM (SELECT *, row_number() OVER (PARTITION BY from_id, to_id, type, coalesce(via, '') ORDER BY id DESC) AS r FROM moved) WHERE r = 1)"""


def _spelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    k, v, none = F.col("p_partkey") % 200, F.floor(F.col("p_partkey") / 200) % 4, F.lit(None).cast("string")
    says = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    ends = part.select(says("api:GET:/p", k, "/{id}").alias("id"), says("H", k).alias("handler"), k.alias("k")).distinct()
    spelled = F.when(v == 0, says("api:get:/p", k, "/{presetId}/")).when(v == 1, says("api:GET://p", k, "/${x}")).when(v == 2, says("api:GET:/p", k, "/{param}")).otherwise(says("api:POST:/q", F.col("p_partkey")))
    asked = part.select("p_partkey", k.alias("k"), v.alias("v"), spelled.alias("id"))
    end, words = F.lit("api_endpoint").alias("type"), F.lit(None).cast("array<string>").alias("keywords")
    nodes = ends.select("id", end, F.col("id").alias("name"), F.lit("routes.php").alias("file"), F.array(F.lit("b")).alias("keywords"), none.alias("description"))
    nodes = nodes.unionByName(asked.select("id", end, F.col("id").alias("name"), none.alias("file"), F.when(F.col("v") != 3, F.array(says("c", F.col("k") % 3), says("v", F.col("v")))).alias("keywords"), F.when(F.col("k") % 5 == 0, says("d", F.col("v"))).alias("description")).distinct())
    nodes = nodes.unionByName(ends.select(F.col("handler").alias("id"), F.lit("method").alias("type"), F.col("handler").alias("name"), F.lit("h.php").alias("file"), words, none.alias("description")).distinct())
    edges = ends.select(says("r", F.col("k")).alias("id"), F.col("id").alias("from_id"), F.col("handler").alias("to_id"), F.lit("ROUTES_TO").alias("type"), none.alias("via"), none.alias("reason"))
    edges = edges.unionByName(asked.select(says("e", F.col("p_partkey")).alias("id"), says("js:f", F.col("p_partkey")).alias("from_id"), F.col("id").alias("to_id"), F.lit("HTTP_REQUEST").alias("type"), F.lit("fetch").alias("via"), none.alias("reason")))
    edges = edges.unionByName(asked.select(says("s", F.col("k"), "-", F.col("v")).alias("id"), F.lit("js:same").alias("from_id"), F.col("id").alias("to_id"), F.lit("HTTP_REQUEST").alias("type"), none.alias("via"), says("v", F.col("v")).alias("reason")).distinct())
    return nodes, edges


@query(f"""WITH {_SPELLED} SELECT k.one AS id, k.type, k.name, f.file, CASE WHEN k.type = 'api_endpoint' THEN f.keywords END AS keywords, f.description FROM kept k JOIN (SELECT one, array_to_string(list_sort(list_distinct(flatten(list(keywords)))), ',') AS keywords, arg_min(file, r) AS file, arg_min(description, r) AS description FROM kept GROUP BY one) f USING (one) WHERE r = 1""")
def endpoint_merge_nodes(spark, sf_dir):
    nodes, _ = merge.merge_endpoints(*_spelled(spark, sf_dir))
    return nodes.withColumn("keywords", F.when(F.col("type") == "api_endpoint", F.array_join(F.array_sort("keywords"), ",")))


@query(f"WITH {_SPELLED} SELECT id, from_id, to_id, type, via, reason FROM merged")
def endpoint_merge_edges(spark, sf_dir):
    return merge.merge_endpoints(*_spelled(spark, sf_dir))[1]


@query(f"WITH {_SPELLED} SELECT DISTINCT one AS id FROM kept WHERE type = 'api_endpoint' AND one IN (SELECT from_id FROM merged WHERE type = 'ROUTES_TO') AND one IN (SELECT to_id FROM merged WHERE type = 'HTTP_REQUEST')")
def endpoint_backend_linked(spark, sf_dir):
    return merge.backend_linked(*merge.merge_endpoints(*_spelled(spark, sf_dir)))


_SOURCES = ("./a", "../b/c.ts", "../../../../x", "~/k", "@/m.vue", "@app/comp", "@app/deep/u", "lodash", '"~"', "./../d/./e")


@query("""WITH f AS (SELECT p_partkey % 10 AS s, p_partkey % 3 = 0 AS lib, 'packages/p' || p_partkey % 7 AS root, CASE WHEN p_partkey % 3 = 0 THEN 'lib/f' || p_partkey || '.js' ELSE 'packages/p' || p_partkey % 7 || '/src/d' || p_partkey % 5 || '/f' || p_partkey || '.js' END AS file, 'packages/p' || p_partkey % 7 || '/src/d' || p_partkey % 5 AS dir FROM part)
SELECT file, list_extract(['./a', '../b/c.ts', '../../../../x', '~/k', '@/m.vue', '@app/comp', '@app/deep/u', 'lodash', '"~"', './../d/./e'], CAST(s AS INTEGER) + 1) AS source, CASE s WHEN 0 THEN CASE WHEN lib THEN 'lib' ELSE dir END || '/a.js' WHEN 1 THEN CASE WHEN lib THEN '' ELSE root || '/src/' END || 'b/c.ts' WHEN 2 THEN CASE WHEN lib THEN '/../../x.js' ELSE 'x.js' END
WHEN 3 THEN CASE WHEN lib THEN 'HOME/k.js' ELSE root || '/k.js' END WHEN 4 THEN CASE WHEN lib THEN '@/m.vue' ELSE root || '/m.vue' END WHEN 5 THEN 'src/app/comp.js' WHEN 6 THEN 'src/deeper/u.js' WHEN 7 THEN 'lodash.js' WHEN 8 THEN CASE WHEN lib THEN 'HOME.js' ELSE root || '/.js' END ELSE CASE WHEN lib THEN '' ELSE root || '/src/' END || 'd/e.js' END AS path FROM f""")
def import_paths(spark, sf_dir):
    p = F.col("p_partkey")
    file = F.when(p % 3 == 0, F.concat(F.lit("lib/f"), p, F.lit(".js"))).otherwise(F.concat(F.lit("packages/p"), p % 7, F.lit("/src/d"), p % 5, F.lit("/f"), p, F.lit(".js")))
    source = F.element_at(F.array(*map(F.lit, _SOURCES)), (p % 10 + 1).cast("int"))
    aliases = spark.createDataFrame([("@app", "src/app"), ("@app/deep", "src/deeper"), ("~", "HOME")], "alias string, target string")
    return imports.resolve(spark.read.parquet(f"{sf_dir}/part.parquet").select(file.alias("file"), source.alias("source")), aliases)


#: Chains of ten constants in each of fifty modules, the last of some a cycle; one constant stands on another module's.
@query("""WITH RECURSIVE c AS (SELECT 'm' || p_partkey % 50 AS module, p_partkey AS p, p_partkey // 50 AS i FROM part), loops AS (SELECT p FROM c WHERE i % 10 = 9 AND p % 7 = 0),
v AS (SELECT module, p, i, '/api/v1/base' || p || '/{unk}/{param}' AS value FROM c WHERE i % 10 = 0 UNION ALL SELECT c.module, c.p, c.i, v.value || '/s' || c.p FROM v JOIN c ON c.p = v.p + 50 AND c.i % 10 <> 0 WHERE c.p NOT IN (SELECT p FROM loops)),
own AS (SELECT module, 'C' || i AS name, value FROM v UNION ALL SELECT module, 'C' || i, '${C' || i || '}x' FROM c WHERE p IN (SELECT p FROM loops))
SELECT * FROM own UNION ALL SELECT 'm' || (CAST(substr(module, 2) AS INTEGER) + 49) % 50, 'D', value || '/d' FROM own WHERE name = 'C1'""")
def constant_urls(spark, sf_dir):
    p, i = F.col("p_partkey"), F.floor(F.col("p_partkey") / 50)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    module = F.concat(F.lit("m"), p % 50)
    value = F.when(i % 10 == 0, F.concat(F.lit("/api/v1/base"), p, F.lit("/${unk}/${a.b}"))).when((i % 10 == 9) & (p % 7 == 0), F.concat(F.lit("${C"), i, F.lit("}x"))).otherwise(F.concat(F.lit("${C"), i - 1, F.lit("}/s"), p))
    found = part.select(module.alias("module"), F.concat(F.lit("C"), i).alias("name"), value.alias("value"))
    found = found.unionByName(found.select("module").distinct().withColumns({"name": F.lit("D"), "value": F.lit("${B}/d")}))
    after = F.concat(F.lit("m"), (F.substr("module", F.lit(2)).cast("int") + 1) % 50)
    return imports.fold(found, found.select("module").distinct().select("module", F.lit("B").alias("name"), after.alias("from_module"), F.lit("C1").alias("from_name")))


_SET = "<?php return ['queue' => 'vod-expired-queue-#', 'deep' => ['a' => ['b' => 'v#', 'n' => 5], 'c' => 'arn:aws:sqs:eu-west-1:12:my-jobs-#'], 'your' => 'your-sqs-name', 'short' => 'abc'];"


def _config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("app/config/c"), key, F.lit(".php")).alias("file"), F.replace(F.lit(_SET), F.lit("#"), key).alias("content"))


@query("""WITH s AS (SELECT 'c' || s_suppkey AS f, unnest(['vod-expired-queue-' || s_suppkey, 'my-jobs-' || s_suppkey, 'arn:aws:sqs:eu-west-1:12:my-jobs-' || s_suppkey, 'your-sqs-name']) AS literal FROM supplier),
r AS (SELECT 'U' || c_custkey AS from_id, unnest(['c' || c_custkey % 120 || '.queue', 'c' || c_custkey % 120 || '.deep.a', 'none.k']) AS key FROM customer),
e AS (SELECT DISTINCT from_id, 'config_key:' || key AS to_id, 0 AS place, 'Reads Laravel config key' AS reason FROM r UNION ALL SELECT DISTINCT 'config_key:' || f || '.queue', 'config_literal:' || literal, 1, 'Config file default queue value' FROM s WHERE regexp_matches(literal, 'queue|sqs|expired|vod')
UNION ALL SELECT DISTINCT 'config_key:' || key, 'config_literal:' || literal, 2, 'Config key resolves to file literal' FROM r JOIN s ON f = split_part(key, '.', 1)) SELECT from_id, to_id, 'REFERENCES' AS type, arg_min(reason, place) AS reason FROM e GROUP BY 1, 2""")
def config_edges(spark, sf_dir):
    key = F.col("c_custkey")
    body = F.concat(F.lit("$x = config('c"), key % 120, F.lit(".queue') . Config::get(\"c"), key % 120, F.lit(".deep.a\") . config('none.k');"))
    methods = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("U"), key).alias("id"), body.alias("body"))
    return config.edges(config.literals(_config_files(spark, sf_dir)), config.reads(methods))


@query("""WITH x(k, v) AS (VALUES ('.queue', 'vod-expired-queue-#'), ('.deep.a.b', 'v#'), ('.deep.c', 'arn:aws:sqs:eu-west-1:12:my-jobs-#'), ('.your', 'your-sqs-name'), ('.short', 'abc'))
SELECT 'app/config/c' || s_suppkey || '.php' AS file, 'c' || s_suppkey || k AS key, replace(v, '#', CAST(s_suppkey AS VARCHAR)) AS value FROM supplier, x""")
def config_settings(spark, sf_dir):
    return config.settings(_config_files(spark, sf_dir))


_KINDS = "WITH a AS (SELECT o_custkey AS ticket, CAST(o_orderkey % 3 AS INTEGER) AS branch, 'n' || o_orderkey // 3 % 6 AS id, max(CAST(o_orderkey // 18 % 4 * 100 AS INTEGER)) AS score FROM orders GROUP BY ALL)"


@query(f"{_KINDS}, w AS (SELECT *, row_number() OVER (PARTITION BY ticket, id ORDER BY branch) AS r FROM a) SELECT ticket, id, score, 'kind' || branch AS reason, CAST(row_number() OVER (PARTITION BY ticket ORDER BY score DESC, branch, id) AS INTEGER) AS rank FROM w WHERE r = 1")
def anchors_merged(spark, sf_dir):
    key = F.col("o_orderkey")
    made = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("ticket"), (key % 3).alias("branch"), F.concat(F.lit("n"), F.floor(key / 3) % 6).alias("id")).agg(F.max((F.floor(key / 18) % 4 * 100).cast("int")).alias("score"))
    made = made.withColumn("reason", F.concat(F.lit("kind"), "branch"))
    return candidates.merge_anchors(*(made.where(F.col("branch") == k).drop("branch") for k in range(3)))


#: Candidates of three sources dealt to the orders, tickets of five workflows to the customers.
_ITEMS = r"""WITH t AS (SELECT c_custkey AS ticket, list_extract(['queue', 'import', 'ui', 'api', 'unknown'], CAST(c_custkey % 5 AS INTEGER) + 1) AS workflow, c_custkey % 2 = 0 AS cms FROM customer),
o AS (SELECT o_custkey AS ticket, o_orderkey AS place, o_orderkey // 3 AS k, o_orderkey % 3 AS source FROM orders),
methods AS (SELECT ticket, place, 'App\' || list_extract(['Plain', 'ExpiredVodJob', 'XmlParser', 'OrderService', 'K1'], CAST(k % 5 AS INTEGER) + 1) || '::' || list_extract(['handle', 'run'], CAST(k // 5 % 2 AS INTEGER) + 1) AS id, 'method' AS type, 'm' AS name, list_extract(['a.php', 'x/views/a/import.php', NULL], CAST(k // 10 % 3 AS INTEGER) + 1) AS file FROM o WHERE source = 0),
roles AS (SELECT ticket, place, k, CASE WHEN k % 3 = 2 THEN 'config_literal' ELSE 'integration_entrypoint' END AS type, list_extract(['sqs_consumer', 'queue_listener', 'queue_job', 'import_handler', 'artisan_command'], CAST(k // 3 % 5 AS INTEGER) + 1) AS name, 'App\' || list_extract(['K1', 'ExpiredVodJob', 'Plain'], CAST(k // 15 % 3 AS INTEGER) + 1) AS class FROM o WHERE source = 1),
integrations AS (SELECT ticket, place, CASE WHEN type = 'config_literal' THEN CASE WHEN k // 3 % 2 = 0 THEN 'config_key:q' ELSE 'config_literal:q' END || k % 4 ELSE 'integration:' || class || ':' || name END AS id, type, name, NULL AS file, class FROM roles),
frontend AS (SELECT ticket, place, 'vue:' || k % 6 AS id, list_extract(['vue_component', 'js_module'], CAST(k % 2 AS INTEGER) + 1) AS type, 'f' AS name, list_extract(['x/views/a/Import.vue', 'y.vue'], CAST(k // 6 % 2 AS INTEGER) + 1) AS file FROM o WHERE source = 2)"""
_MERGED = r""", pri AS (SELECT i.*, CASE WHEN name = 'queue_job' THEN 1 ELSE 0 END AS job, CASE name WHEN 'sqs_consumer' THEN 3 WHEN 'queue_listener' THEN 2 ELSE 1 END AS role FROM integrations i JOIN t USING (ticket) WHERE workflow = 'queue' AND type = 'integration_entrypoint' AND (name IN ('sqs_consumer', 'queue_listener') OR (name = 'queue_job' AND regexp_matches(lower(id), 'expired|archive|vod|sqs')))),
best AS (SELECT *, min(place) OVER (PARTITION BY ticket, job, class) AS first, row_number() OVER (PARTITION BY ticket, job, class ORDER BY role DESC, place) AS r FROM pri),
m AS (SELECT *, lower(id || ' ' || coalesce(file, '')) AS low FROM methods JOIN t USING (ticket)), f AS (SELECT *, lower(id || ' ' || coalesce(file, '')) AS low FROM frontend JOIN t USING (ticket)),
every AS (SELECT ticket, job AS branch, first AS place, id, type, name, file FROM best WHERE r = 1 UNION ALL SELECT ticket, 2, place, id, type, name, file FROM integrations JOIN t USING (ticket) WHERE workflow = 'queue' AND type = 'config_literal' AND id LIKE 'config_key:%'
 UNION ALL SELECT ticket, 3, place, id, type, name, file FROM m WHERE workflow = 'queue' AND regexp_matches(lower(id), 'expiredvod|archiverecording|archivecontent|archivecontentpath')
 UNION ALL SELECT m.ticket, 4, min(b.job * 1000000000000 + b.first), m.id, m.type, m.name, arg_min(m.file, m.place) FROM m JOIN best b ON b.r = 1 AND b.ticket = m.ticket AND m.id = b.class || '::handle' GROUP BY ALL
 UNION ALL SELECT ticket, 5, place, id, type, name, file FROM integrations JOIN t USING (ticket) WHERE workflow = 'import' AND type = 'integration_entrypoint' AND name = 'import_handler'
 UNION ALL SELECT ticket, 6, place, id, type, name, file FROM m WHERE workflow = 'import' AND regexp_matches(low, 'import|parser|feed|externalmatch|transform|xml|providercategory') AND (NOT regexp_matches(low, '/views/.*/import') OR cms)
 UNION ALL SELECT ticket, 7, place, id, type, name, file FROM f WHERE workflow = 'import' AND cms AND regexp_matches(low, '/views/.*/import') UNION ALL SELECT ticket, 8, place, id, type, name, file FROM f WHERE workflow = 'ui' AND type = 'vue_component'
 UNION ALL SELECT ticket, 9, place, id, type, name, file FROM m WHERE workflow = 'api' AND regexp_matches(low, 'controller|service|resource|request|resolver|provider') UNION ALL SELECT ticket, 10, place, id, type, name, file FROM m WHERE workflow = 'api'
 UNION ALL SELECT ticket, 11, place, id, type, name, file FROM m WHERE workflow <> 'api' UNION ALL SELECT ticket, 12, place, id, type, name, file FROM f WHERE workflow = 'ui' UNION ALL SELECT ticket, 13, place, id, type, name, file FROM f WHERE workflow = 'api' AND id IN ('vue:1', 'vue:2')),
one AS (SELECT *, row_number() OVER (PARTITION BY ticket, id ORDER BY branch, place) AS r FROM every)
SELECT ticket, id, type, branch, CAST(row_number() OVER (PARTITION BY ticket ORDER BY branch, place, id) AS INTEGER) AS rank FROM one WHERE r = 1"""


@query(_ITEMS + _MERGED)
def candidates_merged(spark, sf_dir):
    customer, orders = spark.read.parquet(f"{sf_dir}/customer.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (F.floor(k) % len(names) + 1).cast("int"))
    c, key = F.col("c_custkey"), F.col("o_orderkey")
    k = F.floor(key / 3)
    flows = customer.select(c.alias("ticket"), pick(("queue", "import", "ui", "api", "unknown"), c).alias("workflow"), F.when(c % 2 == 0, "shown in the CMS").otherwise("shown").alias("text"))
    base = [F.col("o_custkey").alias("ticket"), key.alias("place")]
    last = F.lit(0).alias("score")
    of = lambda source: orders.where(key % 3 == source)
    methods = of(0).select(*base, F.concat(F.lit("App\\"), pick(("Plain", "ExpiredVodJob", "XmlParser", "OrderService", "K1"), k), F.lit("::"), pick(("handle", "run"), k / 5)).alias("id"), F.lit("method").alias("type"), F.lit("m").alias("name"), pick(("a.php", "x/views/a/import.php", None), k / 10).alias("file"), last)
    name = pick(("sqs_consumer", "queue_listener", "queue_job", "import_handler", "artisan_command"), k / 3)
    literal = F.concat(F.when(F.floor(k / 3) % 2 == 0, "config_key:q").otherwise("config_literal:q"), k % 4)
    entry = F.concat(F.lit("integration:App\\"), pick(("K1", "ExpiredVodJob", "Plain"), k / 15), F.lit(":"), name)
    integrations = of(1).select(*base, F.when(k % 3 == 2, literal).otherwise(entry).alias("id"), F.when(k % 3 == 2, "config_literal").otherwise("integration_entrypoint").alias("type"), name.alias("name"), F.lit(None).cast("string").alias("file"), last)
    frontend = of(2).select(*base, F.concat(F.lit("vue:"), k % 6).alias("id"), pick(("vue_component", "js_module"), k).alias("type"), F.lit("f").alias("name"), pick(("x/views/a/Import.vue", "y.vue"), k / 6).alias("file"), last)
    anchored = flows.select("ticket", F.explode(F.array(F.lit("vue:1"), F.lit("vue:2"))).alias("id"))
    return candidates.merge_by_workflow(flows, methods, integrations, frontend, anchored).select("ticket", "id", "type", "branch", "rank")
