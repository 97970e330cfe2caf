"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Edge types that count as entries, weights of edges for change impact, and layers with their ranks.
ENTRY_TYPES = ("ROUTES_TO", "BLADE_USES_ACTION")
WEIGHT_IN = {"CALLS": 5, "DEPENDS_ON": 4, "EXTENDS": 3, "IMPLEMENTS": 2, "ROUTES_TO": 5, "BLADE_USES_ACTION": 4}
WEIGHT_OUT = {"CALLS": 2, "DEPENDS_ON": 2, "EXTENDS": 3, "IMPLEMENTS": 2, "ROUTES_TO": 0, "BLADE_USES_ACTION": 0}
RISKS = ((40, "CRITICAL"), (20, "HIGH"), (8, "MEDIUM"))
LAYERS = (
    ("Infrastructure", "Infrastructure", 5),
    ("Domain", "Domain", 4),
    ("Presentation", "Presentation", 0),
    ("Http", "Http", 0),
    ("Controllers?", "Controller", 0),
    ("UseCases", "UseCases", 1),
    ("UseCase", "UseCase", 1),
    ("Services", "Services", 2),
    ("Service", "Service", 2),
    ("Repositories", "Repositories", 3),
    ("Repository", "Repository", 3),
)


def calls(resolved: bool = False, prefix: str = "") -> Column:
    """CALLS edges; those resolved through an interface only if asked for."""
    kind = F.col(f"{prefix}call_type")
    return (F.col(f"{prefix}type") == "CALLS") & (F.lit(resolved) | kind.isNull() | (kind != "INTERFACE_RESOLVED"))


def usages(resolved: bool = False, dependencies: bool = False) -> Column:
    """Edges that use their target: calls, entries and, if asked for, dependencies."""
    return calls(resolved) | F.col("type").isin(*ENTRY_TYPES) | (F.lit(dependencies) & (F.col("type") == "DEPENDS_ON"))


def weight(table: dict[str, int], kind: Column | None = None) -> Column:
    kind = F.col("type") if kind is None else kind
    out = F.lit(0)
    for name, w in table.items():
        out = F.when(kind == name, w).otherwise(out)
    return out


def risk(score: Column) -> Column:
    out = F.lit("LOW")
    for least, name in reversed(RISKS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def class_of(node: Column) -> Column:
    return F.substring_index(node, "::", 1)


def layer(node: Column) -> Column:
    """The first layer of which a namespace segment of the node's class is the name; null if none."""
    found = [F.when(class_of(node).rlike(rf"(^|\\){segment}(\\|$)"), name) for segment, name, _ in LAYERS]
    return F.coalesce(*found)


def layer_rank(name: Column) -> Column:
    return F.create_map(*(F.lit(x) for label, rank in {label: rank for _, label, rank in LAYERS}.items() for x in (label, rank)))[name]


def short_label(node: Column) -> Column:
    """The last segment of a namespaced id; endpoints as `VERB path`; the tail of field ids."""
    return (
        F.when(node.startswith("api:"), F.regexp_replace(F.regexp_replace(node, "^api:", ""), "^([A-Z]+):", "$1 "))
        .when(node.startswith("request_field:"), F.concat(F.lit("request:"), F.regexp_replace(node, "^request_field:", "")))
        .when(node.startswith("model_field:"), F.concat(F.lit("model:"), F.substring_index(F.substring_index(node, ":", -2), ":", 1), F.lit("::"), F.substring_index(node, ":", -1)))
        .otherwise(F.substring_index(node, "\\", -1))
    )


def haystack(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *columns))


def round2(x: Column) -> Column:
    return F.round(x, 2)
