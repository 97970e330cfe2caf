"""The secret scan in DuckDB's SQL."""

from .secrets import BASE, RULES, Rule


def _rule(rule: Rule, order: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    counted = "m[i]" if rule.group == 0 else f"regexp_extract(m[i], '^(?:{pattern})$', {rule.group})"
    return f"""
    SELECT n, {order} AS k, '{rule.kind}' AS kind, first AS s, first + length(m[i]) AS e
    FROM (SELECT n, m, i, CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS first
          FROM (SELECT n, m, b, unnest(range(1, len(m) + 1)) AS i
                FROM (SELECT n, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS b FROM d)))
    WHERE length({counted}) >= {rule.least}"""


def oracle() -> str:
    base = len(BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE k = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))
    shown = "kind || ':' || s || ':' || e"
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_rule(r, i) for i, r in enumerate(RULES))}),
g AS (SELECT n, {counts}, string_agg({shown}, ',' ORDER BY s, k) FILTER (WHERE k < {base}) AS base, string_agg({shown}, ',' ORDER BY s, k) AS spans FROM f GROUP BY n)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.n = g.n"""
