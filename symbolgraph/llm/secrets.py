"""Secret scans over a trigram inverted index, with DataFrame operations only.

From each rule's regular expression a Boolean trigram query is derived: an OR of ANDs of trigrams that any
match must hold. The index keeps, for the trigrams that some query names, the rows that hold them, letters
folded. A search intersects the postings of each AND, unites the ORs, and verifies only the rows found. A rule
without mandatory trigrams is verified on every row.

Offsets are code points, ends exclusive. Spans of one kind are leftmost and don't overlap; a match that is too
short is dropped, and what it covered isn't searched again.

Defined results: a null text counts as empty; a row without secrets has empty lists; rows with equal or null
ids keep one row each, and each is judged by its own text; an empty table gives an empty result; only the named
columns are read.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, cut


@dataclass(frozen=True)
class Rule:
    """least: characters that `group` needs at least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules and the published forms of further credentials, in the order of kinds.
BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
]
FURTHER = [
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----", 0, 20),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
]
RULES = BASE + FURTHER
#: An alternative that could be more strings than this is not expanded; the query goes on without it.
MOST_STRINGS = 64
#: Matches that are gone through at once.
RUN = 128
SPANS = "array<struct<start:int,end:int,kind:string>>"


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """An OR of ANDs of folded trigrams of which a match holds one wholly; None if there is no such query."""
    runs = _literal_runs(re._parser.parse(pattern))
    best = None
    for run in runs:  # each run is a set of strings of which a match holds one
        clauses = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if frozenset() in clauses:
            continue
        if best is None or min(map(len, clauses)) > min(map(len, best)):
            best = clauses
    return None if best is None else sorted((c for c in best if not any(d < c for d in best)), key=sorted)


def _literal_runs(parsed) -> list[set[str]]:
    """Sets of folded strings such that a match of the parsed pattern holds one string of each set."""
    runs, now = [], {""}

    def close():
        nonlocal now
        runs.append(now)
        now = {""}

    def extend(options: set[str] | None):
        nonlocal now
        if options is None or len(now) * len(options) > MOST_STRINGS:
            close()
        else:
            now = {a + b for a in now for b in options}

    for part in parsed:
        options = _strings([part])
        if options is None and str(part[0]) in ("SUBPATTERN", "MAX_REPEAT"):
            close()
            inner, least = (part[1][-1], 1) if str(part[0]) == "SUBPATTERN" else (part[1][2], part[1][0])
            if least:
                runs += _literal_runs(inner)
        else:
            extend(options)
    close()
    return runs


def _strings(parsed) -> set[str] | None:
    """All folded strings that the parsed pattern matches, if they are few."""
    found = {""}
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            more = {chr(arg).lower()}
        elif op == "IN" and all(str(x[0]) == "LITERAL" for x in arg):
            more = {chr(x[1]).lower() for x in arg}
        elif op == "SUBPATTERN":
            more = _strings(arg[-1])
        elif op == "BRANCH":
            each = [_strings(x) for x in arg[1]]
            more = None if None in each else set().union(*each)
        elif op == "MAX_REPEAT" and arg[1] != re._constants.MAXREPEAT and arg[1] <= 3:
            inner = _strings(arg[2])
            more = None if inner is None else {"".join(x) for n in range(arg[0], arg[1] + 1) for x in itertools.product(inner, repeat=n)}
        else:
            more = None
        if more is None or len(found) * len(more) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in more}
    return found


def build_index(docs: DataFrame, rules: list[Rule], id_col: str, text_col: str) -> DataFrame:
    """Postings (trigram, id) of the trigrams that the rules' queries name. The size of the list is that of the rules."""
    named = sorted({t for r in rules for c in trigram_query(r.pattern) or [] for t in c})
    folded = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("t"))
    held = F.array_compact(F.array(*(F.when(F.contains("t", F.lit(g)), F.lit(g)) for g in named)))
    return folded.select("id", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(id, kinds): the rows whose postings satisfy some rule's query, and for which rules."""
    named = sorted({t for r in rules for c in trigram_query(r.pattern) or [] for t in c})
    place = {t: i for i, t in enumerate(named)}
    # The postings of a row meet as bits, 32 to a word, so intersecting them is one aggregation with map-side combine.
    words = range((len(named) + 31) // 32)
    bits = lambda w: F.create_map(*itertools.chain.from_iterable((F.lit(t), F.lit(1 << (i % 32)).cast("long")) for t, i in place.items() if i // 32 == w))
    held = index.groupBy("id").agg(*(F.bit_or(F.coalesce(bits(w)[F.col("trigram")], F.lit(0).cast("long"))).alias(f"w{w}") for w in words))

    def satisfied(rule: Rule) -> Column:
        either = F.lit(False)
        for clause in trigram_query(rule.pattern):
            every = F.lit(True)
            for w in words:
                mask = sum(1 << (place[t] % 32) for t in clause if place[t] // 32 == w)
                if mask:
                    every = every & (F.col(f"w{w}").bitwiseAND(F.lit(mask).cast("long")) == F.lit(mask))
            either = either | every
        return either

    kinds = F.array_compact(F.array(*(F.when(satisfied(r), F.lit(r.kind)) for r in rules)))
    return held.select("id", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _spans(text: Column, rule: Rule) -> tuple[Column, Column, Column]:
    """The matches of one rule, the pieces between them, and, from columns m and b that hold these two,
    array<struct<start, end, kind>> of the matches that are long enough."""
    pattern = rule.pattern
    if rule.group == 0 and re.fullmatch(r"\[[^\]]+\]\+", pattern):  # in runs of one class only those that are long enough need be found
        pattern = f"{pattern[:-1]}{{{rule.least},}}"

    def step(acc: Column, i: Column) -> Column:
        match = F.get("m", i)
        start = acc["at"] + F.char_length(F.get("b", i))
        end = start + F.char_length(match)
        counted = match if rule.group == 0 else F.regexp_extract(match, f"^(?:{pattern})$", rule.group)
        more = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(F.char_length(counted) >= rule.least, F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"))

    # The pieces and the matches alternate; their lengths add up to the offsets. Matches are gone through in runs, as an array
    # that grows by one is copied each time.
    start = lambda at: F.struct(at.alias("at"), F.array().cast(SPANS).alias("out"))
    last = F.size("m") - 1

    def run(acc: Column, j: Column) -> Column:
        inner = F.aggregate(F.sequence(j * RUN, F.least(j * RUN + (RUN - 1), last)), start(acc["at"]), step)
        return F.get(F.transform(F.array(inner), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out"))), F.lit(0))

    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out"))
    found = F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor(last / RUN).cast("int")), none, run, lambda acc: acc["out"]))
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.split(text, pattern, -1), found


def _with_spans(rows: DataFrame, text: str, rules: list[Rule], when=None) -> DataFrame:
    """rows with a column of spans for each rule, empty where `when(rule)` is false."""
    none = F.array().cast(SPANS)
    for rule in rules:
        whole, between, found = _spans(F.col(text), rule)
        if when is not None:
            whole = F.when(when(rule), whole).otherwise(F.array().cast("array<string>"))
        rows = rows.withColumn("m", whole).withColumn("b", F.when(F.size("m") > 0, between)).withColumn(f"__spans_{rule.kind}", F.when(F.size("m") > 0, found).otherwise(none)).drop("m", "b")
    return rows


def scan(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, text, and __spans_<kind> for each rule): row holds all columns of docs, whatever their names; text is its text,
    empty for null."""
    indexed = [r for r in rules if trigram_query(r.pattern)]
    full = [r for r in rules if r not in indexed]
    found = cut(candidates(build_index(docs, indexed, id_col, text_col), indexed)).withColumnRenamed("id", "k")
    # Rows are verified where they are read if the candidates are few, else after one shuffle by id; candidates are the side that is hashed.
    rows = boxed(docs, id=F.col(id_col), text=F.coalesce(F.col(text_col), F.lit("")))
    rows = rows.join(found.hint("shuffle_hash"), rows.id.eqNullSafe(found.k), "left")
    rows = _with_spans(rows, "text", full)
    rows = _with_spans(rows, "text", indexed, lambda r: F.array_contains("kinds", r.kind))
    return rows.drop("k", "kinds")


def _joined(kinds: list[str]) -> Column:
    order = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(i)) for i, k in enumerate(kinds)))
    every = F.concat(*(F.transform(f"__spans_{k}", lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("n"), s["end"].alias("end"), s["kind"].alias("kind"))) for k in kinds))
    return F.array_join(F.transform(F.array_sort(every), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of each row."""
    base = [r.kind for r in BASE]
    return scan(docs.select(id_col, text_col), rules, id_col, text_col).select(
        F.col("id").alias(id_col),
        *(F.size(f"__spans_{k}").cast("long").alias(f"n_{k}") for k in base),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined([r.kind for r in rules]).alias("spans"),
    )


def redact(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of its text replaced by the mask, spans that overlap by one. Null texts stay null."""
    rows = scan(docs, rules, id_col, text_col)
    every = F.array_sort(F.concat(*(F.transform(f"__spans_{r.kind}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for r in rules)))
    # What isn't masked lies between the furthest end so far and the next start beyond it.
    gaps = F.aggregate(
        F.col("spans"),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), s["start"].alias("end"))))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), F.char_length("text").alias("end")))),
    )
    pieces = F.transform(gaps, lambda g: F.substring(F.col("text"), g["start"] + 1, g["end"] - g["start"]))
    masked = F.when(F.size("spans") > 0, F.array_join(pieces, mask)).otherwise(F.col("row")[text_col])
    return rows.withColumn("spans", every).select(F.col("row").withField(f"`{text_col}`", masked).alias("row")).select("row.*")
