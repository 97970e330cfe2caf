"""Routes of route files, with the prefixes of the groups around them.

A group is the interval from the line that names its prefix to the brace that closes what was open at that line. How
deep a place is nested is a running sum over the braces before it, so groups, routes and arguments are matched by
windows and one equi-join by file; nothing is read with a stack.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Forms of route files, and the six rows of a resource: action, verb, what follows the path.
FILE = r"(?i)(^|/)routes/[^/]+\.php$"
CALL = r"(?i)Route::(get|post|put|patch|delete|resource|apiResource)\s*\($"
GROUP_PREFIX = r"['\"]prefix['\"]\s*=>\s*['\"]([^'\"]+)['\"]"
CHAIN_PREFIX = r"Route::prefix\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"
STRING = r"""(['"])(?:\\.|(?!\1)[^\\])*\1"""
ACTION = r"\[([A-Za-z0-9_\\]+)::class,\s*['\"]([^'\"]+)['\"]\s*\]"
CLASS = r"([A-Za-z0-9_\\]+)::class"
RESOURCE = (("index", "GET", ""), ("store", "POST", ""), ("show", "GET", "/{param}"), ("update", "PUT", "/{param}"), ("update", "PATCH", "/{param}"), ("destroy", "DELETE", "/{param}"))


def _some(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def _pieces(files: DataFrame) -> DataFrame:
    """(file, end, mark, verb, length): the text cut after each bracket `mark`, `end` characters in; verb and length of a
    route's name if the bracket opens its arguments."""
    cut = files.select("file", F.posexplode(F.split("content", r"(?<=[{}()])")).alias("k", "text"))
    end = F.sum(F.char_length("text")).over(Window.partitionBy("file").orderBy("k"))
    call = F.regexp_extract("text", CALL, 0)
    return cut.select("file", end.alias("end"), F.right("text", F.lit(1)).alias("mark"), F.when(call != "", F.lower(F.regexp_extract("text", CALL, 1))).alias("verb"), F.char_length(call).alias("length"))


def calls(pieces: DataFrame) -> DataFrame:
    """(file, verb, at, open, close): calls of routes, from the name's first character to the bracket that ends them."""
    level = F.sum(F.when(F.col("mark") == "(", 1).otherwise(-1)).over(Window.partitionBy("file").orderBy("end"))
    round_ = pieces.where("mark in ('(', ')')").withColumn("level", level + F.when(F.col("mark") == ")", 1).otherwise(0))
    next_ = F.lead("end").over(Window.partitionBy("file", "level").orderBy("end"))
    found = round_.withColumn("close", next_).where("verb is not null and close is not null")
    return found.select("file", "verb", (F.col("end") - F.col("length")).alias("at"), F.col("end").alias("open"), (F.col("close") - 1).alias("close"))


def prefixes(files: DataFrame) -> DataFrame:
    """(file, at, seen, prefix): lines that name a prefix, from the line's first character, seen where the name ends."""
    lines = files.select("file", F.posexplode(F.split("content", "\n")).alias("k", "line"))
    start = F.sum(F.char_length("line") + 1).over(Window.partitionBy("file").orderBy("k")) - F.char_length("line") - 1
    lines = lines.withColumn("at", start)
    ends = lambda pattern: F.regexp_instr("line", F.lit(pattern)) - 1 + F.char_length(F.regexp_extract("line", pattern, 0))
    group, chain = _some(F.col("line"), GROUP_PREFIX, 1), _some(F.col("line"), CHAIN_PREFIX, 1)
    found = lines.where(group.isNotNull() | chain.isNotNull())
    return found.select("file", "at", (F.col("at") + F.when(group.isNotNull(), ends(GROUP_PREFIX)).otherwise(ends(CHAIN_PREFIX))).alias("seen"), F.coalesce(group, chain).alias("prefix"))


def groups(pieces: DataFrame, named: DataFrame) -> DataFrame:
    """(file, prefix, depth, seen, until, replaced): how deep each prefix's line is nested, the brace at which it ends,
    and where the next prefix of the same depth takes its place."""
    none = F.lit(None)
    braces = pieces.where("mark in ('{', '}')").select("file", (F.col("end") - 1).alias("at"), F.when(F.col("mark") == "{", 1).otherwise(-1).alias("delta"), none.cast("long").alias("seen"), none.cast("string").alias("prefix"))
    events = braces.unionByName(named.withColumn("delta", F.lit(0)))
    order = Window.partitionBy("file").orderBy("at", F.abs("delta"))
    events = events.withColumn("sum", F.sum("delta").over(order)).withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(order)))
    # a prefix of depth d ends at the first closing brace that leaves depth d, or d - 1 where none was opened since
    leaves = events.where("delta < 0").select("file", "at", F.col("depth").alias("leaves"), F.lit(True).alias("closing"), none.cast("long").alias("seen"), none.cast("string").alias("prefix"), none.cast("long").alias("depth"))
    waits = events.where("delta = 0").select("file", "at", F.explode(F.array(F.col("depth"), F.col("depth") - 1)).alias("leaves"), F.lit(False).alias("closing"), "seen", "prefix", "depth")
    after = Window.partitionBy("file", "leaves").orderBy("at", "closing").rowsBetween(1, Window.unboundedFollowing)
    ended = leaves.unionByName(waits).withColumn("until", F.min(F.when(F.col("closing"), F.col("at"))).over(after)).where("not closing")
    ended = ended.groupBy("file", "at", "prefix", "depth", "seen").agg(F.min("until").alias("until"))
    return ended.withColumn("replaced", F.lead("seen").over(Window.partitionBy("file", "depth").orderBy("at"))).drop("at")


def _joined(prefix: Column, path: Column) -> Column:
    right = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.regexp_replace(F.concat(F.regexp_replace(prefix, "/+$", ""), right), "/+", "/")


def imports(content: Column) -> Column:
    """array<struct<alias, name>> of the classes that a file uses."""
    used = F.filter(F.regexp_extract_all(content, F.lit(r"(?m)^use\s+([^;]+);"), F.lit(1)), lambda u: ~F.ltrim(u).startswith("function "))
    parts = lambda u: F.split(F.trim(u), r"(?i)\s+as\s+")
    name = lambda u: F.regexp_replace(F.trim(F.get(parts(u), F.lit(0))), r"^\\", "")
    return F.transform(used, lambda u: F.struct(F.coalesce(F.trim(F.get(parts(u), F.lit(1))), F.substring_index(name(u), "\\", -1)).alias("alias"), name(u).alias("name")))


def _class(raw: Column, uses: Column) -> Column:
    name = F.regexp_replace(F.trim(raw), r"^\\", "")
    return F.when(name.contains("\\"), name).otherwise(F.coalesce(F.try_element_at(F.filter(uses, lambda u: u["alias"] == name), F.lit(-1))["name"], name))


def routes(files: DataFrame) -> DataFrame:
    """(file, at, verb, path, controller, action) of the routes in files (file, content) below a folder `routes`.

    Resources give a row for each of their actions that only() and except() leave. A route without a controller gives
    none. Texts without an end to a call's brackets give no route there; null contents give none.
    """
    files = files.where(F.col("file").rlike(FILE) & F.col("content").isNotNull()).select("file", "content")
    pieces = _pieces(files)
    found, around = calls(pieces), groups(pieces, prefixes(files))
    inside = found.select("file", "at").join(around, "file").where("seen <= at and (until is null or at <= until) and (replaced is null or at < replaced)")
    nested = inside.groupBy("file", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "prefix"))), lambda x: x["prefix"]), "/").alias("prefix"))
    text = found.join(nested, ["file", "at"], "left").join(files.withColumn("uses", imports(F.col("content"))), "file")
    args, tail = F.expr("substring(content, int(open) + 1, int(close - open))"), F.expr("substring(content, int(close) + 2)")
    listed = lambda word: F.regexp_extract_all(F.regexp_extract(tail, rf"^\s*->{word}\s*\(\s*\[([^\]]+)\]", 1), F.lit(r"['\"]([^'\"]+)['\"]"), F.lit(1))
    literal = F.regexp_extract(args, STRING, 0)
    named = F.coalesce(_some(args, ACTION, 1), _some(args, CLASS, 1))
    rows = text.select("file", "at", "verb", F.coalesce("prefix", F.lit("")).alias("prefix"), F.substr(literal, F.lit(2), F.char_length(literal) - 2).alias("path"), _class(named, F.col("uses")).alias("controller"), _some(args, ACTION, 2).alias("action"), listed("only").alias("only"), listed("except").alias("skip"))
    rows = rows.where("controller is not null and path <> ''")
    last = F.filter(F.split("path", "/"), lambda s: s != "")
    single = rows.where("verb not in ('resource', 'apiresource')").select("file", "at", F.upper("verb").alias("verb"), _joined(F.col("prefix"), F.col("path")).alias("path"), "controller", F.coalesce("action", F.try_element_at(last, F.lit(-1)), F.lit("__invoke")).alias("action"))
    six = F.explode(F.array(*(F.struct(F.lit(a).alias("action"), F.lit(v).alias("verb"), F.lit(s).alias("suffix")) for a, v, s in RESOURCE)))
    many = rows.where("verb in ('resource', 'apiresource')").withColumn("x", six).where("(size(only) = 0 or array_contains(only, x.action)) and not array_contains(skip, x.action)")
    many = many.select("file", "at", F.col("x.verb").alias("verb"), F.regexp_replace(F.concat(_joined(F.col("prefix"), F.col("path")), "x.suffix"), "/+", "/").alias("path"), "controller", F.col("x.action").alias("action"))
    return single.unionByName(many)


def endpoint_id(verb: Column, path: Column) -> Column:
    steps = ((r"\{[^}]+\}", "{param}"), ("/+", "/"), ("/$", ""))
    clean = reduce(lambda p, s: F.regexp_replace(p, *s), steps, path)
    return F.concat(F.lit("api:"), F.upper(verb), F.lit(":"), F.when(clean == "", "/").otherwise(clean))


def route_edges(found: DataFrame) -> DataFrame:
    """ROUTES_TO of what routes() finds."""
    return found.select(endpoint_id(F.col("verb"), F.col("path")).alias("from_id"), F.concat_ws("::", "controller", "action").alias("to_id"), F.lit("ROUTES_TO").alias("type")).distinct()
