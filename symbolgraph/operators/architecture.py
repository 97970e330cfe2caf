"""Layer rules: edges from an inner layer to an outer one."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolgraph.functions.graph import calls, layer, layer_rank


def glob(pattern: str) -> str:
    """`*` for any characters, `?` for one."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in pattern) + "$"


# The path that a violation between two layers (inner, outer) should take; layers that count as another there; framework namespaces of HTTP, and
# the members of requests.
EXPECTED = {
    ("Infrastructure", "Controller"): "Controller → Service → Repository ← Infrastructure",
    ("Infrastructure", "UseCase"): "UseCase → Service → Repository ← Infrastructure",
    ("Infrastructure", "Service"): "Service → Repository ← Infrastructure",
    ("Infrastructure", "Repository"): "Service → Repository ← Infrastructure",
    ("Domain", "Controller"): "Controller → UseCase → Service → Domain",
    ("Domain", "UseCase"): "UseCase → Service → Domain",
    ("Domain", "Service"): "Service → Repository → Domain",
    ("Domain", "Repository"): "Service → Repository → Domain",
    ("Repository", "Controller"): "Controller → Service → Repository",
    ("Repository", "UseCase"): "UseCase → Service → Repository",
    ("Repository", "Service"): "Service → Repository",
    ("Service", "Controller"): "Controller → Service → Repository",
    ("Service", "UseCase"): "UseCase → Service → Repository",
    ("UseCase", "Controller"): "Controller → UseCase → Service → Repository",
}
SAME = {"Presentation": "Controller", "Http": "Controller", "UseCases": "UseCase", "Services": "Service", "Repositories": "Repository"}
HTTP_NAMESPACES = r"^(Illuminate\\Http(\\|$)|Illuminate\\Support\\Facades\\Http(::|\\|$)|Psr\\Http(\\|$)|Symfony\\Component\\HttpFoundation(\\|$)|GuzzleHttp(\\|$))"
HTTP_CLIENTS = r"^(Illuminate\\Http\\Client|Psr\\Http|Symfony\\Component\\HttpFoundation|GuzzleHttp)"
REQUEST_MEMBERS = ("all", "cookie", "filled", "get", "getClientIp", "getHost", "getMethod", "getPathInfo", "has", "hasHeader", "header", "input", "is", "path", "query", "route", "userAgent")


def violations(edges: DataFrame, resolved: bool = False, ignore: list[str] | None = None, allow: list[dict | str] | None = None) -> DataFrame:
    """One row for each edge that goes from a layer to one of lower rank. likely_false says why it may be none: `rule`, if it
    fits a pattern `a -> b` of ignore or allow, or an object of allow (fromLayer, toLayer, edgeType); `framework`; `query`."""
    found = edges.where(calls(resolved) | (F.col("type") == "DEPENDS_ON")).select("from_id", "to_id", "type", "call_type")
    found = found.withColumn("from_layer", layer(F.col("from_id"))).withColumn("to_layer", layer(F.col("to_id")))
    found = found.where(layer_rank(F.col("from_layer")) > layer_rank(F.col("to_layer")))
    depends = F.col("type") == "DEPENDS_ON"
    paths = F.create_map(*(F.lit(x) for (a, b), path in EXPECTED.items() for x in (f"{a}>{b}", path)))
    same = F.create_map(*(F.lit(x) for pair in SAME.items() for x in pair))
    canonical = lambda c: F.coalesce(same[F.col(c)], F.col(c))
    expected = F.coalesce(paths[F.concat_ws(">", canonical("from_layer"), canonical("to_layer"))], F.concat_ws(" → ... → ", "to_layer", "from_layer"))
    reason = F.concat(F.col("from_layer"), F.lit(" code should not "), F.when(depends, "depend on").otherwise("call"), F.lit(" "), F.col("to_layer"), F.lit(" code."))
    found = found.withColumns({"severity": F.when(depends, "MEDIUM").otherwise("HIGH"), "expected": expected, "detected": F.concat_ws(" → ", "from_layer", "to_layer"), "reason": reason})
    return found.withColumn("likely_false", likely_false(ignore or [], allow or []))


def _fits(rule: dict | str) -> Column | None:
    """Whether an edge fits a rule; None for a rule that says nothing."""
    if isinstance(rule, str):
        parts = [x.strip() for x in rule.split("->")]
        return F.col("from_id").rlike(glob(parts[0])) & F.col("to_id").rlike(glob(parts[1])) if len(parts) == 2 else None
    wanted = [F.col(column) == rule[key] for key, column in (("fromLayer", "from_layer"), ("toLayer", "to_layer"), ("edgeType", "type")) if rule.get(key)]
    return reduce(Column.__and__, wanted) if wanted else None


def likely_false(ignore: list[str], allow: list[dict | str]) -> Column:
    to, member = F.col("to_id"), F.substring_index("to_id", "::", -1)
    fits = [c for c in map(_fits, [*ignore, *allow]) if c is not None]
    framework = (F.col("to_layer") == "Http") & to.rlike(HTTP_NAMESPACES) & (member.isin(*REQUEST_MEMBERS) | to.rlike(r"Request(::|\\|$)") | to.rlike(HTTP_CLIENTS))
    return F.when(reduce(Column.__or__, fits, F.lit(False)), "rule").when(framework, "framework").when(F.col("from_id").contains("Repository") & to.endswith("::query"), "query")


def scan(found: DataFrame) -> DataFrame:
    """All violations in the order of a report: HIGH first, then by source and target."""
    return found.orderBy(F.when(F.col("severity") == "HIGH", 0).otherwise(1), F.concat_ws("->", "from_id", "to_id"))


def by_layer(found: DataFrame) -> DataFrame:
    return found.groupBy("from_layer", "to_layer", "severity").agg(F.count("*").alias("n"))


def of_nodes(found: DataFrame, ids: DataFrame) -> DataFrame:
    """The violations that touch one of ids (id), once each."""
    a = found.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(*found.columns)
    b = found.join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(*found.columns)
    return a.unionByName(b).dropDuplicates(["from_id", "to_id", "type"])
