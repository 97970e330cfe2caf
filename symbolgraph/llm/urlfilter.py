"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern over host and path: literal characters, `*` for any characters, a first `||` for the host or
any of its subdomains, a first or last `|` for the url's ends, `^` for a separator or the end. Tokens are runs of
a-z and 0-9, letters folded. A token that a pattern holds between two characters that can't be part of a
token is in every url that the rule fits, so the rule is filed under the rarest such token, by the tokens' counts
over all urls; a rule without one is tried on every url. A url's tokens fetch the rules filed under them, and only
those run their regular expressions.

Of the host rules that fit, the longest decides. Where none fits, the first pattern rule that fits decides: it
blocks. Else the url is allowed.

Defined results: a null url, or one without `://`, has empty host and path, fits no rule and is allowed; repeated
rows are each judged; an empty table gives an empty result; only the named columns are read. The rules are a
parameter; their number is checked against `MOST_RULES`.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RULES = 500_000


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str
    host_rule: bool = False


def host_rule(name: str, verdict: str) -> Rule:
    """A rule like `example.net/en/`: that host and its subdomains, paths that start so."""
    return Rule(name, verdict, "||" + name, True)


# The rules over hosts and paths, then patterns of unwanted hosts and paths.
HOST_RULES = [host_rule("net/", "block"), host_rule("example.net/en/", "allow"), host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow")]
PATTERNS = [
    "||*.cheap-pills.*^",
    "||*.casino-win.*^",
    "||*.free-bets.*^",
    "||*.spam-farm.*^",
    "||*.ads-track.*^",
    "||*.adult-x.*^",
    "/adserver/",
    "/doubleclick/",
    "||*.pharmacy.*^",
    "||*.poker.*^",
    "||*.xxx^",
]
RULES = HOST_RULES + [Rule(p, "block", p) for p in PATTERNS]

_TOKEN = re.compile(r"[a-z0-9]+")
_URL = re.compile(r"\A.*?://([^/?#]*)([^?#]*)", re.S)
_FOLD = {i: i + 32 for i in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    m = _URL.match(url or "")
    return (m[1].translate(_FOLD), m[2]) if m else ("", "")


def regex(pattern: str) -> str:
    """The regular expression of a pattern, over host followed by path."""
    body, head, tail = pattern, "", ""
    if body.startswith("||*."):
        body, head = body[4:], r"\A(?:[^/]*\.)?"
    elif body.startswith("||"):
        body, head = body[2:], r"\A(?:[^/]*\.)?"
    elif body.startswith("|"):
        body, head = body[1:], r"\A"
    if body.endswith("|"):
        body, tail = body[:-1], r"\Z"
    return head + "".join({"*": ".*", "^": r"(?:[^a-zA-Z0-9._%-]|\Z)"}.get(c) or re.escape(c) for c in body) + tail


def tokens(pattern: str) -> set[str]:
    """Tokens that are in every url that fits, whole."""
    anchored = pattern.startswith("|")
    body = pattern.removeprefix("||*.").lstrip("|") if pattern.startswith("||") else pattern.removeprefix("|")
    ends = body.endswith("|")
    body = body.removesuffix("|")
    found = set()
    for m in _TOKEN.finditer(body.translate(_FOLD)):
        left = anchored if m.start() == 0 else body[m.start() - 1] != "*"
        right = ends if m.end() == len(body) else body[m.end()] != "*"
        if left and right and not any(ord(c) > 127 for c in body[max(0, m.start() - 1) : m.end() + 1]):
            found.add(m[0])
    return found


class Index:
    """Rules by their rarest token."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        if len(rules) > MOST_RULES:
            raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are sent to the tasks")
        self.rules = rules
        self.patterns = [re.compile(regex(r.pattern), re.S) for r in rules]
        self.filed: dict[str, list[int]] = defaultdict(list)
        self.always = []
        for i, r in enumerate(rules):
            of = tokens(r.pattern)
            if of:
                self.filed[min(of, key=lambda t: (counts.get(t, 0), t))].append(i)
            else:
                self.always.append(i)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None]:
        """host, path, the host rule that decides, the verdict, the pattern that decides."""
        host, path = split_url(url)
        text = host + path
        ids = set(self.always)
        for t in set(_TOKEN.findall(text.translate(_FOLD))):
            ids.update(self.filed.get(t, ()))
        fit = [i for i in sorted(ids) if self.patterns[i].search(text)] if text else []
        hosts = [self.rules[i] for i in fit if self.rules[i].host_rule]
        if hosts:
            r = max(hosts, key=lambda r: (len(r.name), r.name))
            return host, path, r.name, r.verdict, None
        others = [self.rules[i] for i in fit]
        return host, path, None, others[0].verdict if others else "allow", others[0].name if others else None


def token_counts(urls: DataFrame, url_col: str, wanted: set[str]) -> dict[str, int]:
    """How many urls hold each of the wanted tokens: no more rows than those come back."""

    def count(batches):
        n: dict[str, int] = defaultdict(int)
        for batch in batches:
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                for t in wanted.intersection(_TOKEN.findall((host + path).translate(_FOLD))):
                    n[t] += 1
        yield pa.record_batch({"token": list(n), "n": list(n.values())}, schema=pa.schema([("token", pa.string()), ("n", pa.int64())]))

    got = urls.select(F.col(url_col).alias("url")).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r.token: r.n for r in got.collect()}


def judge_column(url: Column | str, index: Index) -> Column:
    @F.arrow_udf("struct<host:string,path:string,rule:string,verdict:string,pattern:string>")
    def of(urls: pa.Array) -> pa.Array:
        found = [index.judge(u) for u in urls.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in range(5)], names=["host", "path", "rule", "verdict", "pattern"])

    return of(url)


def judge(pages: DataFrame, rules: list[Rule] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, pattern) of each row of pages."""
    index = Index(rules, token_counts(pages, url_col, set().union(*(tokens(r.pattern) for r in rules))))
    found = pages.select(F.col(id_col), judge_column(F.col(url_col), index).alias("x"))
    return found.select(F.col(id_col), *(F.col(f"x.{c}").alias(c) for c in ("host", "path", "rule", "verdict", "pattern")))


def oracle(rules: list[Rule] = RULES) -> str:
    """The same in DuckDB's SQL: every rule on every url."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    re2 = lambda r: quote("(?s)" + regex(r.pattern).replace(r"\Z", r"\z"))
    by_length = sorted((r for r in rules if r.host_rule), key=lambda r: (-len(r.name), r.name))
    others = [r for r in rules if not r.host_rule]
    case = lambda rs, what: "CASE " + " ".join(f"WHEN regexp_matches(u, {re2(r)}) THEN {quote(what(r))}" for r in rs) + " END"
    return f"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?s).*?://([^/?#]*)', 1) ELSE '' END AS h,
                  CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?s).*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
q AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
f AS (SELECT page_id, host, path, host || path AS u FROM q),
g AS (SELECT page_id, host, path, {case(by_length, lambda r: r.name)} AS rule, {case(by_length, lambda r: r.verdict)} AS ruled, {case(others, lambda r: r.name)} AS other FROM f)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN other IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN rule IS NULL THEN other END AS pattern FROM g"""
