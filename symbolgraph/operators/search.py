"""Search for nodes by id, name and file."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Node types of each kind of search.
KINDS = {
    "symbol": ("class", "interface", "trait", "method", "property", "parameter", "vue_component", "js_module", "blade_view"),
    "route": ("api_endpoint", "route_name"),
    "field": ("request_field", "model_field", "response_field", "variable_field"),
    "config": ("config_literal",),
}
#: What a query asks for by its form, in this order; a symbol otherwise.
FORMS = (
    (r"^api:", "route"),
    (r"(?i)^(get|post|put|patch|delete)\s+/", "route"),
    (r"^(request_field|model_field):", "field"),
    (r"^config_key:", "config"),
    (r"(?is)^(?=.*/).*\b(get|post|put|patch|delete)\b", "route"),
)


def kind_of(query: Column) -> Column:
    """The kind of search that each query asks for."""
    return F.coalesce(*(F.when(query.rlike(form), kind) for form, kind in FORMS), F.lit("symbol"))


def detect_kind(query: str) -> str:
    return next((kind for form, kind in FORMS if re.search(form, query)), "symbol")


def find(nodes: DataFrame, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """(id, type, name, score) of the best matches; an exact id is found whatever its type."""
    query = query.strip()
    if not query:
        return nodes.select("id", "type", "name", F.lit(0).cast("long").alias("score")).limit(0)
    kind = kind or detect_kind(query)
    q = query.lower()
    low = {c: F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("id", "name", "file")}
    verb = re.match(r"(get|post|put|patch|delete)\s+(\S+)", q)
    if kind == "route":  # ids that hold the query, or what verb and path make of it
        variants = [q, f"{verb[1]}:{verb[2]}", verb[2]] if verb else [q]
        held = reduce(Column.__or__, (low["id"].contains(v) for v in variants))
    else:
        held = reduce(Column.__or__, (c.contains(q) for c in low.values()))
    typed = F.lit(True) if kind == "all" else F.col("type").isin(*KINDS[kind])
    words = [w for w in re.split(r"[\s/:.\\_-]+", q) if len(w) >= 2]
    hits = sum((F.when(reduce(Column.__or__, (c.contains(w) for c in low.values())), 1).otherwise(0) for w in words), F.lit(0))
    score = (
        F.when(F.col("id") == query, 1000)
        .when(low["id"].endswith(f"::{q}") | low["id"].endswith(f"\\{q}"), 900)
        .when((low["id"] == q) | (low["name"] == q), 850)
        .when(low["id"].contains(q), 700)
        .when(low["name"].contains(q), 600)
        .when(low["file"].contains(q), 400)
        .when(hits > 0, 200 + 50 * hits)
        .otherwise(0)
    )
    found = nodes.where((typed & held) | (F.col("id") == query)).select("id", "type", "name", score.cast("long").alias("score")).where("score > 0")
    return found.dropDuplicates(["id"]).orderBy(F.desc("score"), "id").limit(limit)
