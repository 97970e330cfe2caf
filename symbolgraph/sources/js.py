"""Modules, functions, imports and requests of JavaScript, TypeScript and Vue sources, by regular expressions.

All of it is expressions over the text column: a file is one row, what is found in it is exploded, and imports
are resolved to modules by joins. In single-file components only the script counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolgraph.operators.resolve import endpoint_key
from symbolgraph.sources.scan import split_component

# What declares a function or class, what imports, and what requests.
FUNCTION = r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*\("
ARROW = r"(?m)^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)\n]*\)|[A-Za-z_$][\w$]*)\s*(?::\s*[^=\n]+)?=>"
EXPORTED = r"(?m)^\s*export\s+(?:default\s+)?(?:async\s+)?(?:function\s*\*?|const|let|var|class)\s+([A-Za-z_$][\w$]*)"
CLASS = r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"
IMPORT = r"import\s+(?:type\s+)?([^'\";]+?)\s+from\s+['\"]([^'\"]+)['\"]"
REQUEST = r"\b(?:axios|http|api|client|\$http|\$axios)\.(get|post|put|patch|delete)\s*(?:<[^>]*>)?\(\s*['\"`]([^'\"`]+)['\"`]"
FETCH = r"\b(?:fetch|\$fetch|useFetch)\(\s*['\"`]([^'\"`]+)['\"`]"
CALL = r"(?<![\w$.])([A-Za-z_$][\w$]*)\("


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def scripts(files: DataFrame) -> DataFrame:
    """(file, module, code): comments cut; of components the script only."""
    body = F.when(F.col("file").endswith(".vue"), F.coalesce(split_component(F.col("content"))["script"], F.lit(""))).otherwise(F.col("content"))
    code = F.regexp_replace(F.regexp_replace(body, r"(?s)/\*.*?\*/", " "), r"(?m)(^|\s)//[^\n]*", "$1")
    return files.select("file", F.concat(F.lit("js:"), "file").alias("module"), code.alias("code"))


def nodes(code: DataFrame) -> DataFrame:
    """Modules, components, and the functions and classes of modules; exported functions named use... are composables."""
    none = F.lit(None).cast("string")
    name = F.regexp_extract("file", r"([^/]+?)(\.[^./]+)?$", 1)
    modules = code.select(F.col("module").alias("id"), none.alias("parent"), F.lit("js_module").alias("type"), name.alias("name"), "file")
    components = code.where(F.col("file").endswith(".vue")).select(F.concat_ws("::", "module", name).alias("id"), F.col("module").alias("parent"), F.lit("vue_component").alias("type"), name.alias("name"), "file")
    exported = _all(F.col("code"), EXPORTED)
    functions = code.select("module", "file", exported.alias("exported"), F.explode(F.array_distinct(F.concat(_all(F.col("code"), FUNCTION), _all(F.col("code"), ARROW)))).alias("name"))
    kind = F.when(F.array_contains("exported", F.col("name")) & F.col("name").rlike("^use[A-Z]"), "composable").otherwise("method")
    functions = functions.select(F.concat_ws("::", "module", "name").alias("id"), F.col("module").alias("parent"), kind.alias("type"), "name", "file")
    classes = code.select("module", "file", F.explode(F.array_distinct(_all(F.col("code"), CLASS))).alias("name")).select(F.concat_ws("::", "module", "name").alias("id"), F.col("module").alias("parent"), F.lit("class").alias("type"), "name", "file")
    return modules.unionByName(components).unionByName(functions).unionByName(classes).dropDuplicates(["id"])


def _path(file: Column, target: Column, aliases: dict[str, str]) -> Column:
    """The file that an import names, without extension; null for packages."""
    folder = F.regexp_replace(file, r"[^/]*$", "")
    joined = F.when(target.startswith("."), F.concat(folder, target))
    for alias, path in aliases.items():
        joined = F.when(target.startswith(alias), F.concat(F.lit(path), F.substring(target, len(alias) + 1, 1 << 20))).otherwise(joined)
    parts = F.filter(F.split(joined, "/"), lambda p: (p != ".") & (p != ""))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.regexp_replace(F.array_join(up, "/"), r"(/index)?\.(js|mjs|cjs|ts|vue)$", "")


def imports(code: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(module, name, target): names that a module imports and the module that they come from, where it is known."""
    pairs = F.arrays_zip(_all(F.col("code"), IMPORT, 1).alias("names"), _all(F.col("code"), IMPORT, 2).alias("target"))
    found = code.select("file", "module", F.explode(pairs).alias("p")).select("module", _path(F.col("file"), F.col("p.target"), aliases or {}).alias("stem"), F.explode(_all(F.col("p.names"), r"([A-Za-z_$][\w$]*)(?:\s+as\s+[A-Za-z_$][\w$]*)?", 1)).alias("name"))
    stems = code.select(F.regexp_replace("file", r"(/index)?\.(js|mjs|cjs|ts|vue)$", "").alias("stem"), F.col("module").alias("target"))
    return found.where("stem is not null").join(stems, "stem").select("module", "name", "target").distinct()


def edges(code: DataFrame, known: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """IMPORTS, CONTAINS, HTTP_REQUEST, and CALLS of a module to its own and imported functions with their confidence."""
    brought = imports(code, aliases)
    out = brought.select(F.col("module").alias("from_id"), F.col("target").alias("to_id"), F.lit("IMPORTS").alias("type")).distinct().withColumn("confidence", F.lit(None).cast("double"))
    out = out.unionByName(known.where("parent is not null").select(F.col("parent").alias("from_id"), F.col("id").alias("to_id"), F.lit("CONTAINS").alias("type"), F.lit(None).cast("double").alias("confidence")))
    asked = F.arrays_zip(F.transform(_all(F.col("code"), REQUEST, 1), F.upper).alias("verb"), _all(F.col("code"), REQUEST, 2).alias("url"))
    fetched = F.transform(_all(F.col("code"), FETCH), lambda u: F.struct(F.lit("GET").alias("verb"), u.alias("url")))
    requests = code.select("module", F.explode(F.concat(asked, fetched)).alias("r"))
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("r.url", r"\$\{[^}]*\}", "{param}"), r"[?#].*$", ""), "^/+", "")
    out = out.unionByName(requests.select(F.col("module").alias("from_id"), F.concat(F.lit("api:"), F.col("r.verb"), F.lit(":/"), path).alias("to_id"), F.lit("HTTP_REQUEST").alias("type"), F.lit(None).cast("double").alias("confidence")).distinct())
    called = code.select("module", F.explode(F.array_distinct(_all(F.col("code"), CALL))).alias("name"))
    functions = known.where("type in ('method', 'composable', 'class')").select(F.col("parent").alias("target"), "name", "id")
    own = called.join(functions, (called.module == functions.target) & (called.name == functions.name)).select(F.col("module").alias("from_id"), F.col("id").alias("to_id"), F.lit("CALLS").alias("type"), F.lit(0.4).alias("confidence"))
    imported = called.join(brought, ["module", "name"]).join(functions, ["target", "name"]).select(F.col("module").alias("from_id"), F.col("id").alias("to_id"), F.lit("CALLS").alias("type"), F.lit(0.8).alias("confidence"))
    return out.unionByName(own).unionByName(imported)


def link_requests(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """(from_id, to_id): requested endpoints to the routes' endpoints of the same verb and path, parameters aside."""
    asked = requests.where("type = 'HTTP_REQUEST'").select(F.col("to_id").alias("from_id")).distinct().withColumn("key", endpoint_key(F.col("from_id")))
    given = routes.where("type = 'ROUTES_TO'").select(F.col("from_id").alias("to_id")).distinct().withColumn("key", endpoint_key(F.col("to_id"))).groupBy("key").agg(F.min("to_id").alias("to_id"))
    return asked.join(given, "key").where("from_id <> to_id").select("from_id", "to_id")
