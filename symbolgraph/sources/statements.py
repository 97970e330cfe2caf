"""Statements of PHP methods, as far as fields of requests flow through them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Forms of statements of the language.
VARIABLE = r"\$[a-zA-Z_]\w*"
INPUT = r"\$request\w*(?:->\w+)*->input\(\s*['\"]([^'\"]+)['\"]"
ASSIGNED = rf"(?s)^\s*({VARIABLE})(?:\[\s*['\"]([^'\"]+)['\"]\s*\])?\s*=(?![=>])\s*(.*)$"
DIRECT = r"(?s)^\$request\w*(?:->\w+)*->input\([^()]*\)\s*$"
MADE = r"(?s)^new\s+[\\\w]+\s*\((.*)\)\s*$"
CALLED = r"(?s)(\$this->\w+(?:->\w+)*|\$\w+|\\?[A-Z][\\\w]*)(?:->|::)(\w+)\(([^()]*)\)\s*$"


def _some(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def statements(methods: DataFrame) -> DataFrame:
    """(method, at, kind, target, source, path, field, direct, receiver, called, argument_index) of methods (id, body).

    Calls keep receiver and name; resolve() of the types says which method that is. Statements end at semicolons.
    """
    pieces = methods.select(F.col("id").alias("method"), F.posexplode(F.split("body", r"[;{}]")).alias("at", "text"))
    right = _some(F.col("text"), ASSIGNED, 3)
    rows = pieces.select("method", "at", "text", _some(F.col("text"), ASSIGNED, 1).alias("target"), _some(F.col("text"), ASSIGNED, 2).alias("path"), F.coalesce(right, F.lit("")).alias("value"))
    fields = F.array_distinct(F.regexp_extract_all("value", F.lit(INPUT), F.lit(1)))
    none = F.lit(None).cast("string")
    base = ["method", "at"]
    taken = rows.where("target is not null").select(*base, F.lit("input").alias("kind"), "target", none.alias("source"), "path", F.explode(fields).alias("field"), (F.col("path").isNull() & F.col("value").rlike(DIRECT)).alias("direct"), none.alias("receiver"), none.alias("called"), F.lit(None).cast("int").alias("argument_index"))
    bare = rows.where("target is null").select(*base, F.lit("input").alias("kind"), none.alias("target"), none.alias("source"), none.alias("path"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(INPUT), F.lit(1)))).alias("field"), F.lit(False).alias("direct"), none.alias("receiver"), none.alias("called"), F.lit(None).cast("int").alias("argument_index"))
    plain = rows.where("target is not null and path is null")
    empty = [none.alias("path"), none.alias("field"), F.lit(False).alias("direct"), none.alias("receiver"), none.alias("called"), F.lit(None).cast("int").alias("argument_index")]
    root = _some(F.col("value"), rf"^({VARIABLE})", 1)
    copied = plain.where(root.isNotNull() & (F.col("value") != "")).select(*base, F.lit("copy").alias("kind"), "target", root.alias("source"), *empty)
    inside = F.transform(F.split(F.regexp_extract("value", MADE, 1), ","), lambda a: F.regexp_extract(a, rf"^\s*({VARIABLE})", 1))
    made = plain.where(F.col("value").rlike(MADE)).select(*base, F.lit("new").alias("kind"), "target", F.explode(inside).alias("source"), *empty).where("source <> ''")
    arguments = F.posexplode(F.split(F.regexp_extract("text", CALLED, 3), ","))
    given = rows.where(F.col("text").rlike(CALLED)).select(*base, F.lit("pass").alias("kind"), none.alias("target"), none.alias("path"), none.alias("field"), F.lit(False).alias("direct"), F.regexp_extract("text", CALLED, 1).alias("receiver"), F.regexp_extract("text", CALLED, 2).alias("called"), arguments.alias("argument_index", "argument"))
    given = given.withColumn("source", F.regexp_extract("argument", rf"^\s*({VARIABLE})", 1)).where("source <> ''").drop("argument")
    out = taken.unionByName(bare).unionByName(copied).unionByName(made)
    return out.unionByName(given.select(*out.columns)).distinct()
