"""Source files as rows, and what regular expressions find in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that aren't read, file patterns of each language, and what Blade templates are searched for.
IGNORED = ("vendor", "node_modules", "tests", "test", "cache", "logs", "bin", "bootstrap", "build", "database", "docker", "docs", "storage", "artisan", "composer.json", "composer.lock", "package.json", "package-lock.json", "boost.json", "certs")
PATTERNS = {"php": "*.php", "js": "*.{js,mjs,cjs,vue,ts}"}
BLADE = {
    "BLADE_EXTENDS": (r"@extends\(\s*['\"]([^'\"]+)['\"]", "view:"),
    "BLADE_INCLUDES": (r"@include(?:If|When|Unless|First)?\(\s*['\"]([^'\"]+)['\"]", "view:"),
    "BLADE_COMPONENT": (r"<x-([a-zA-Z0-9_.:-]+)", "view:components."),
    "BLADE_USES_ROUTE": (r"\broute\(\s*['\"]([^'\"]+)['\"]", "route:"),
    "BLADE_METHOD_CALL": (r"\$[a-zA-Z_]\w*->([a-zA-Z_]\w*)\(", "blade_method_ref:"),
}
ACTION = r"\[\s*\\?([A-Za-z_\\]+)::class\s*,\s*['\"](\w+)['\"]\s*\]"
SYMBOL = r"([A-Za-z0-9_\\]+)::([A-Za-z0-9_]+)"
#: REST actions of a resource route: action, verb, whether the path names one item, and what follows it.
REST = (("index", "GET", "", ""), ("store", "POST", "", ""), ("show", "GET", "{}", ""), ("update", "PUT", "{}", ""), ("update", "PATCH", "{}", ""), ("destroy", "DELETE", "{}", ""))


def read_sources(spark: SparkSession, root: str, language: str, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(file, content): files below root outside ignored and hidden folders; file is relative to root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", PATTERNS[language]).load(root)
    base = root.rstrip("/").rsplit("/", 1)[-1]
    relative = F.regexp_replace(F.regexp_extract("path", rf".*?/{base}/(.*)$", 1), r"\\", "/")
    rows = files.select(relative.alias("file"), F.decode("content", "UTF-8").alias("content"))
    hidden = F.exists(F.split("file", "/"), lambda part: part.isin(*ignored) | part.startswith("."))
    return rows.where(~hidden)


def _matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))


def blade_edges(files: DataFrame) -> DataFrame:
    """(from_id, to_id, type) of Blade templates (file, content)."""
    view = F.concat(F.lit("blade:"), "file")
    out = None
    for kind, (pattern, prefix) in BLADE.items():
        name = "BLADE_INCLUDES" if kind == "BLADE_COMPONENT" else kind
        found = files.select(view.alias("from_id"), F.explode(_matches(F.col("content"), pattern)).alias("x")).select("from_id", F.concat(F.lit(prefix), "x").alias("to_id"), F.lit(name).alias("type"))
        out = found if out is None else out.unionByName(found)
    classes, methods = (F.regexp_extract_all(F.col("content"), F.lit(ACTION), F.lit(g)) for g in (1, 2))
    pairs = F.zip_with(classes, methods, lambda c, m: F.concat(F.regexp_replace(c, r"^\\", ""), F.lit("::"), m))
    actions = files.select(view.alias("from_id"), F.explode(F.array_distinct(pairs)).alias("to_id")).withColumn("type", F.lit("BLADE_USES_ACTION"))
    names, symbols = (F.regexp_extract_all(F.col("content"), F.lit(SYMBOL), F.lit(g)) for g in (1, 2))
    named = F.filter(F.zip_with(names, symbols, lambda c, m: F.when((c != "class") & (m != "class"), F.concat(c, F.lit("::"), m))), lambda x: x.isNotNull())
    symbols = files.select(view.alias("from_id"), F.explode(F.array_distinct(named)).alias("to_id")).withColumn("type", F.lit("BLADE_REFERENCES_SYMBOL"))
    return out.unionByName(actions).unionByName(symbols).distinct()


def routes(files: DataFrame) -> DataFrame:
    """(verb, path, controller, action) of single routes and of resource routes in route files (file, content)."""
    uses = F.map_from_entries(F.array_distinct(F.transform(F.regexp_extract_all(F.col("content"), F.lit(r"use\s+([A-Za-z_\\]+);"), F.lit(1)), lambda c: F.struct(F.substring_index(c, "\\", -1).alias("k"), c.alias("v")))))
    base = files.withColumn("uses", uses)
    resolved = lambda c: F.coalesce(F.element_at("uses", F.substring_index(c, "\\", -1)), F.regexp_replace(c, r"^\\", ""))
    single = r"Route::(get|post|put|patch|delete)\(\s*['\"]([^'\"]*)['\"]\s*,\s*\[\s*\\?([A-Za-z_\\]+)::class\s*,\s*['\"](\w+)['\"]"
    parts = [F.regexp_extract_all("content", F.lit(single), F.lit(g)) for g in (1, 2, 3, 4)]
    one = base.select("uses", F.explode(F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("verb", "path", "cls", "action"))))).alias("r"))
    one = one.select(F.upper("r.verb").alias("verb"), F.col("r.path").alias("path"), resolved(F.col("r.cls")).alias("controller"), F.col("r.action").alias("action"))
    many = r"Route::(?:apiResource|resource)\(\s*['\"]([^'\"]*)['\"]\s*,\s*\\?([A-Za-z_\\]+)::class"
    found = base.select("uses", F.explode(F.arrays_zip(F.regexp_extract_all("content", F.lit(many), F.lit(1)).alias("path"), F.regexp_extract_all("content", F.lit(many), F.lit(2)).alias("cls"))).alias("r"))
    rest = F.explode(F.array(*(F.struct(F.lit(a).alias("action"), F.lit(v).alias("verb"), F.lit(i).alias("item")) for a, v, i, _ in REST)))
    found = found.select("uses", "r.path", "r.cls", rest.alias("x"))
    name = F.regexp_replace(F.substring_index("path", "/", -1), "s$", "")
    path = F.when(F.col("x.item") != "", F.concat("path", F.lit("/{"), name, F.lit("}"))).otherwise(F.col("path"))
    return one.unionByName(found.select(F.col("x.verb").alias("verb"), path.alias("path"), resolved(F.col("cls")).alias("controller"), F.col("x.action").alias("action")))


def route_edges(found: DataFrame) -> DataFrame:
    end = F.concat(F.lit("api:"), "verb", F.lit(":/"), F.regexp_replace("path", "^/+", ""))
    return found.select(end.alias("from_id"), F.concat_ws("::", "controller", "action").alias("to_id"), F.lit("ROUTES_TO").alias("type"))


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, link) of each link of each page."""
    return pages.select(id_col, F.explode(F.regexp_extract_all(html_col, F.lit(r'href="([^"]*)"'), F.lit(1))).alias("link"))


def tags(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, tag, n): how often each element begins in a template."""
    return pages.select(id_col, F.explode(F.regexp_extract_all(html_col, F.lit(r"<([a-zA-Z][a-zA-Z0-9-]*)"), F.lit(1))).alias("tag")).groupBy(id_col, "tag").agg(F.count("*").alias("n"))


def keywords(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Words of camel- and snake-case names, letters folded, distinct."""
    split = F.split(F.lower(F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")), " ")
    return F.array_distinct(F.filter(split, lambda w: (F.char_length(w) > 1) & ~w.isin(*stop) if stop else F.char_length(w) > 1))


def split_component(content: Column) -> Column:
    """struct<template, script>: the parts of a single-file component; of several parts of a kind the last counts."""
    part = lambda tag: F.try_element_at(F.regexp_extract_all(content, F.lit(rf"(?ms)^<{tag}\b[^>]*>(.*?)^</{tag}>"), F.lit(1)), F.lit(-1))
    return F.struct(part("template").alias("template"), part("script").alias("script"))


def http_resources(content: Column) -> Column:
    """array<struct<property, url>> of `property: new X({ ... url: '...' })`."""
    pattern = r"(\w+)\s*:\s*new\s+\w+\(\s*\{[^}]*?url\s*:\s*['\"`]([^'\"`]+)['\"`]"
    found = [F.regexp_extract_all(content, F.lit(pattern), F.lit(g)).alias(n) for g, n in ((1, "property"), (2, "url"))]
    return F.arrays_zip(*found)
