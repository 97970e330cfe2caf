"""Import paths of JavaScript modules: package roots, aliases, relative paths, and the URLs that constants make."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolgraph.functions.lineage import cut
from symbolgraph.operators.fixpoint import MOST_ROUNDS

# Roots of packages, and endings that a path may have already.
ROOT = r"^(packages/[^/]+|apps/[^/]+|clientPackages/[^/]+)"
ENDING = r"(?i)\.(js|ts|vue|mjs|cjs|jsx|tsx)$"


def read_aliases(spark: SparkSession, root: str, names: tuple[str, ...], key: str = "pathAliases") -> DataFrame:
    """(alias, target) of the first of the configuration files `names` below root that is JSON and an object."""
    for name in names:
        path = os.path.join(root, name)
        if os.path.exists(path):
            try:
                with open(path, encoding="utf-8") as file:
                    found = json.load(file)
            except ValueError:
                continue
            if isinstance(found, dict):
                return spark.createDataFrame([(str(a), str(t)) for a, t in (found.get(key) or {}).items()], "alias string, target string")
    return spark.createDataFrame([], "alias string, target string")


def _normal(path: Column) -> Column:
    """A path without `.` and empty steps, each `..` with the step before it; steps out of the root stay."""
    up = lambda acc: (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")) != "..")
    step = lambda acc, s: F.when((s == "") | (s == "."), acc).when((s == "..") & up(acc), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolve(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """imports (file, source) with `path`, the file that each source names.

    `~/` and `@/` are the root of the file's package. Then the longest alias that begins the source is replaced: every
    prefix of a source meets the aliases in one equi-join. What begins with a dot is relative to the file, and a path
    without an ending gets `.js`.
    """
    file, source = F.regexp_replace("file", r"\\", "/"), F.regexp_replace("source", "^[\"']|[\"']$", "")
    root = F.regexp_extract(file, ROOT, 1)
    bare = F.when(source.isin("~", "@/"), "").otherwise(F.substr(source, F.lit(3)))
    rooted = F.when((root != "") & (source.startswith("~/") | source.startswith("@/") | (source == "~")), F.concat(root, F.lit("/"), bare)).otherwise(source)
    rows = cut(imports.select("file", "source", file.alias("clean_file"), rooted.alias("clean")).distinct())
    begins = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("clean"), F.lit(1))), lambda k: F.substr("clean", F.lit(1), k)))
    met = rows.select("clean").distinct().select("clean", begins.alias("alias")).join(aliases.groupBy("alias").agg(F.max("target").alias("target")), "alias")
    longest = met.groupBy("clean").agg(F.max_by(F.struct("alias", "target"), F.char_length("alias")).alias("a"))
    rows = rows.join(longest, "clean", "left")
    named = F.when(F.col("a").isNull(), F.col("clean")).otherwise(F.concat("a.target", F.substr("clean", F.char_length("a.alias") + 1)))
    folder = F.when(F.contains("clean_file", F.lit("/")), F.regexp_replace("clean_file", "/[^/]*$", "")).otherwise("")
    joined = _normal(F.concat_ws("/", folder, F.col("named")))
    relative = F.when(joined.startswith("."), F.substr(joined, F.lit(3))).otherwise(joined)
    path = F.when(F.col("named").startswith("."), relative).otherwise(F.col("named"))
    out = rows.withColumn("named", named).withColumn("path", path)
    return out.select("file", "source", F.when(F.col("path").rlike(ENDING), F.col("path")).otherwise(F.concat("path", F.lit(".js"))).alias("path"))


def module_id(path: Column) -> Column:
    return F.concat(F.lit("js:"), F.regexp_replace(path, r"\\", "/"))


def constants(files: DataFrame) -> DataFrame:
    """(file, name, value, computed): constants that are strings, templates, or computed templates, of files (file, content)."""
    form = r"(?s)\b(?:const|let|var)\s+(\w+)\s*=\s*(computed\s*\(\s*\(\s*\)\s*=>\s*\(?\s*)?(?:'([^'\n]*)'|\"([^\"\n]*)\"|`([^`]*)`)"
    groups = [F.regexp_extract_all("content", F.lit(form), F.lit(g)).alias(n) for g, n in ((1, "name"), (2, "computed"), (3, "a"), (4, "b"), (5, "c"))]
    found = files.select("file", F.explode(F.arrays_zip(*groups)).alias("x"))
    return found.select("file", "x.name", F.coalesce(F.nullif("x.a", F.lit("")), F.nullif("x.b", F.lit("")), "x.c").alias("value"), (F.col("x.computed") != "").alias("computed")).where("value <> ''").dropDuplicates(["file", "name"])


def fold(found: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    """constants (module, name, value) with their value folded: each `${other}` that names a constant of the module, or one
    that it imports, replaced by that constant's folded value, `{other}` for what none is. Constants on or behind a
    cycle keep their text.

    bindings is (module, name, from_module, from_name) of imports. Pieces of templates are rows; a constant is folded in the
    round after the last that it needs, so rounds are as many as constants stand upon each other.
    """
    own = found.select("module", "name", F.col("module").alias("at"), F.col("name").alias("as"))
    scope = own if bindings is None else own.unionByName(bindings.select("module", "name", F.col("from_module").alias("at"), F.col("from_name").alias("as")).join(own.select("module", "name"), ["module", "name"], "left_anti"))
    pieces = found.select("module", "name", F.posexplode(F.split("value", r"(?=\$\{)|(?<=\})")).alias("k", "text"))
    word = F.regexp_extract("text", r"^\$\{\s*(\w+)\s*\}$", 1)
    pieces = cut(pieces.withColumn("ref", F.nullif(word, F.lit(""))))
    uses = pieces.where("ref is not null").select("module", "name", "k", "ref")
    refs = uses.join(scope.select("module", F.col("name").alias("ref"), "at", "as"), ["module", "ref"]).join(found.select(F.col("module").alias("at"), F.col("name").alias("as")), ["at", "as"], "left_semi")
    refs = cut(refs.select("module", "name", "k", "at", "as"))
    text = F.when(F.col("ref").isNotNull(), F.concat(F.lit("{"), "ref", F.lit("}"))).otherwise(F.regexp_replace("text", r"\$\{[^}]*\}", "{param}"))
    base = pieces.withColumn("text", text).join(refs, ["module", "name", "k"], "left")
    whole = lambda rows: rows.groupBy("module", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "").alias("value"))
    waits = cut(base)
    done = cut(whole(waits.join(waits.where("at is not null").select("module", "name").distinct(), ["module", "name"], "left_anti")))
    for _ in range(MOST_ROUNDS):
        rest = waits.join(done.select("module", "name"), ["module", "name"], "left_anti")
        filled = rest.join(done.select(F.col("module").alias("at"), F.col("name").alias("as"), F.col("value").alias("folded")), ["at", "as"], "left")
        open_ = filled.where("at is not null and folded is null").select("module", "name").distinct()
        now = cut(whole(filled.withColumn("text", F.coalesce("folded", "text")).join(open_, ["module", "name"], "left_anti")))
        if now.isEmpty():
            return done.select("module", "name", "value").unionByName(found.join(done, ["module", "name"], "left_anti").select("module", "name", "value"))
        done = cut(done.unionByName(now))
    raise RuntimeError(f"constants still fold after {MOST_ROUNDS} rounds")


def url_path(text: Column) -> Column:
    """The path of a folded URL: from `api/v1/` on if it holds that, else without leading parameters; with a leading slash."""
    flat = F.regexp_replace(F.regexp_replace(text, r"\$\{[^}]+\}", "{param}"), "/+", "/")
    api = F.regexp_extract(flat, r"/?api/v\d+/[^?\s]*", 0)
    bare = F.regexp_replace(flat, r"^(\{[^{}]+\})+", "")
    slashed = lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    return F.when(api != "", slashed(api)).when(bare == "", "/").otherwise(slashed(bare))
