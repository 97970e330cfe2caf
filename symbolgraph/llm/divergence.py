"""Audit of sources: how far each source's word use lies from every other's, and by which terms from its language's.

Tasks count terms of their documents first and pass on a row for each (language, term, source) and stretch of documents;
the rows are dealt by (language, term), and each task sums what it got by Arrow's hash grouping, so that nothing is sorted
but the numbers of the sums: that gives each term's run, its document frequency and its counts. Terms of enough documents
are kept, with which the sizes of groups and vocabularies are known; the kept runs, much fewer, are dealt alike, sorted
with the term first, as Spark compares a key's first bytes at once, and scanned, and each run emits its terms and its
share of the pairs of sources.

A pair's value is a sum over all kept terms, most of which either source lacks. So it is split exactly into the value
of a term that both lack, times the vocabulary; corrections for the terms of each source alone, which hang only on a
term's count and so come from a histogram of counts; and corrections for the terms of both, which the runs emit.

Null texts, languages and sources are ''. A document is a row, so repeated rows count each. Texts without terms make no
terms, but their (language, source) group occurs. A language without a kept term gives pairs of value 0. An empty table
gives an empty result. Very long texts are taken in stretches. A task holds the sums of its partition, and not many rows beside.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, cut, utf8

LEAST_DOCUMENTS, SCALE, TOP_TERMS = 3, 1_000_000_000, 200
#: Counted terms that a task holds before it passes them on, bytes of a text taken at once, pairs computed at once.
HELD, STRETCH, PAIRS = 800_000, 1 << 20, 1 << 20
#: Rows that are summed at once, and rows of a batch of runs.
SUMMED, RUN_ROWS = 2_000_000, 1 << 16
#: Ways into which rows of one language are split where they meet its groups.
WAYS = 16

TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
GAP = re.compile(rb"[^A-Za-z\x80-\xff]")
COUNTED = "lang string, term string, source string, docs long, n long"
RUN = "lang string, term string, source string, n long, lang_n long, head boolean"
EMITTED = "part string, lang string, source string, item string, value long"


def stretches(text: bytes) -> Iterator[bytes]:
    """text in pieces that end between terms."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + STRETCH)
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


class Counts:
    """Documents and occurrences of each term of (language, source), passed on when they have become many."""

    def __init__(self) -> None:
        self.of: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
        self.rows = 0

    def add(self, lang: bytes, source: bytes, text: bytes) -> None:
        docs, n = self.of.setdefault((lang, source), (Counter(), Counter()))
        before, seen = len(n), set()
        for piece in stretches(text.lower()):  # of bytes, so only A-Z become lower
            found = TERM.findall(piece)
            n.update(found)
            seen.update(found)
        docs.update(seen)
        self.rows += len(n) - before

    def out(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), (docs, n) in self.of.items():
            k = len(n)
            if k:
                same = [pa.array([v] * k, pa.binary()).cast(pa.string()) for v in (lang, source)]
                counted = [pa.array([c[t] for t in n], pa.int64()) for c in (docs, n)]
                yield pa.RecordBatch.from_arrays([same[0], pa.array(list(n), pa.binary()).cast(pa.string()), same[1], *counted], COUNTED_NAMES)
        self.of, self.rows = {}, 0


COUNTED_NAMES = ["lang", "term", "source", "docs", "n"]
RUN_NAMES = ["lang", "term", "source", "n", "lang_n", "head"]
EMITTED_NAMES = ["part", "lang", "source", "item", "value"]
RESULT = ["lang", "source", "part", "item", "value", "rank"]


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = Counts()
    for batch in batches:
        for lang, source, text in zip(utf8(batch["lang"]), utf8(batch["source"]), utf8(batch["text"])):
            counts.add(lang, source, text)
            if counts.rows >= HELD:
                yield from counts.out()
    yield from counts.out()


def _changes(batch: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    """True at rows that differ from the row before in one of the columns; the first is True."""
    out = np.zeros(batch.num_rows, bool)
    out[0] = True
    for name in names:
        values = batch[name]
        out[1:] |= pa.compute.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
    return out


def whole_runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches none of which ends within a run of equal columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = np.flatnonzero(_changes(batch, names))
        if held and all(held[-1][n][-1] == batch[n][0] for n in names):
            if len(starts) == 1:
                held.append(batch)
                continue
            head = int(starts[1])
        else:
            head = 0
        if held or head:
            yield _joined([*held, batch.slice(0, head)])
        last = int(starts[-1])
        if last > head:
            yield batch.slice(head, last - head)
        held = [batch.slice(last)]
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def summed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """A row for each (lang, term, source), its documents and occurrences summed."""
    key = ["lang", "term", "source"]
    found = pa.Table.from_batches(batches).group_by(key, use_threads=False).aggregate([("docs", "sum"), ("n", "sum")])
    return _joined(found.select([*key, "docs_sum", "n_sum"]).rename_columns(COUNTED_NAMES).to_batches())


def gather(least: int):
    """The runs of terms in at least so many documents: a row for each source, with the language's count beside."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, most = [], 0, SUMMED
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= most:
                held = [summed(held)]
                rows, most = held[0].num_rows, max(SUMMED, 2 * held[0].num_rows)
        if not held:
            return
        sums = summed(held)
        lang, term = (sums[c].dictionary_encode().indices.to_numpy().astype(np.int64) for c in ("lang", "term"))
        key = term * (lang.max() + 1) + lang
        order = np.argsort(key, kind="stable")
        key, docs, n = key[order], sums["docs"].to_numpy()[order], sums["n"].to_numpy()[order]
        first = np.append(True, key[1:] != key[:-1])
        heads, run = np.flatnonzero(first), np.cumsum(first) - 1
        keep = np.flatnonzero((np.add.reduceat(docs, heads) >= least)[run])
        of_lang = np.add.reduceat(n, heads)
        for low in range(0, len(keep), RUN_ROWS):
            at = keep[low : low + RUN_ROWS]
            names = sums.take(pa.array(order[at]))
            yield pa.RecordBatch.from_arrays([names["lang"], names["term"], names["source"], pa.array(n[at]), pa.array(of_lang[run[at]]), pa.array(first[at])], RUN_NAMES)

    return found


def share(n: np.ndarray, whole: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """1 + floor(scale * n / whole) for n <= whole, without leaving 64 bits: three digits of the quotient at a time."""
    out, rest = np.zeros(np.broadcast(n, whole).shape, np.int64), n
    while scale > 1:
        step = min(scale, 1000)
        out = out * step + rest * step // whole
        rest, scale = rest * step % whole, scale // step
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run: the terms that a source uses more than its language does; of all runs of a batch, summed by pair of
    sources, what the terms of both add to the pair's value beyond what either alone adds."""
    for batch in whole_runs(batches, ("lang", "term")):
        heads = np.flatnonzero(_changes(batch, ("lang", "term")))
        n, of_lang, size, lang_size = (batch[c].to_numpy() for c in ("n", "lang_n", "size", "lang_size"))
        p, zero, q = share(n + 1, size), share(np.ones_like(n), size), share(of_lang + 1, lang_size)
        more = np.flatnonzero(p > q)
        if len(more):
            rows = batch.take(pa.array(more))
            yield _emitted("term", rows["lang"], rows["source"], rows["term"], apart(p[more], q[more]))
        lengths = np.diff([*heads, len(n)])
        start, width = np.repeat(heads, lengths), np.repeat(lengths, lengths)
        pair = batch["lang"].dictionary_encode(), batch["source"].dictionary_encode()
        lang, source = (c.indices.to_numpy().astype(np.int64) for c in pair)
        names, k = pair[1].dictionary, len(pair[1].dictionary)
        cuts = np.searchsorted(np.cumsum(width), np.arange(PAIRS, width.sum() + PAIRS, PAIRS))
        for a, b in zip([0, *cuts[:-1] + 1], cuts + 1):
            b = min(b, len(n))
            if a >= b:
                continue
            left = np.repeat(np.arange(a, b), width[a:b])
            right = np.arange(len(left)) - np.repeat(np.cumsum(width[a:b]) - width[a:b], width[a:b]) + start[left]
            left, right = left[left != right], right[left != right]
            if not len(left):
                continue
            both = apart(p[left], p[right]) - apart(p[left], zero[right]) - apart(zero[left], p[right]) + apart(zero[left], zero[right])
            key, at = np.unique((lang[left] * k + source[left]) * k + source[right], return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, at, both)
            yield _emitted("pair", pair[0].dictionary.take(pa.array(key // k // k)), names.take(pa.array(key // k % k)), names.take(pa.array(key % k)), total)


def _emitted(part: str, lang: pa.Array, source: pa.Array, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part] * len(value), pa.string()), lang, source, item, pa.array(value, pa.int64())], EMITTED_NAMES)


def _share(n: str, size: str) -> Column:
    """share() as a column."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({n} as decimal(19,0))) div cast({size} as decimal(19,0))")


def _apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def sizes(given: DataFrame, runs: DataFrame) -> DataFrame:
    """Each occurring (lang, source): kept terms of the language, and the divisors of its and its language's shares."""
    own = runs.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("head").cast("long")).alias("heads"))
    langs = own.groupBy("lang").agg(F.sum("heads").alias("v"), F.sum("n").alias("all_n"))
    found = given.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    v = F.coalesce("v", F.lit(0).cast("long"))
    return found.select("lang", "source", v.alias("v"), (F.coalesce("n", F.lit(0).cast("long")) + v).alias("size"), (F.coalesce("all_n", F.lit(0).cast("long")) + v).alias("lang_size"))


def pair_values(runs: DataFrame, groups: DataFrame, emitted: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each ordered pair of a language's sources."""
    zero = _share("1", "nullif(size, 0)")
    others = groups.select("lang", F.col("source").alias("other"), zero.alias("q0"), F.explode(F.array(*map(F.lit, range(WAYS)))).alias("way"))
    base = groups.select("lang", "source", "v", zero.alias("p0"), F.pmod(F.hash("source"), F.lit(WAYS)).alias("way")).join(others, ["lang", "way"]).where("source <> other")
    neither = base.select("lang", "source", F.col("other").alias("item"), F.when(F.col("v") > 0, F.col("v") * _apart("p0", "q0")).otherwise(0).alias("value"))
    counts = runs.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).join(groups, ["lang", "source"])
    counts = counts.select("lang", "source", "terms", _share("n + 1", "size").alias("p"), zero.alias("p0"), F.pmod(F.hash("source", "n"), F.lit(WAYS)).alias("way"))
    met = counts.join(others, ["lang", "way"]).where("source <> other")
    pairs = [("source", "other", _apart("p", "q0") - _apart("p0", "q0")), ("other", "source", _apart("q0", "p") - _apart("q0", "p0"))]
    both = F.explode(F.array(*(F.struct(F.col(a).alias("source"), F.col(b).alias("item"), (F.col("terms") * v).alias("value")) for a, b, v in pairs))).alias("x")
    alone = met.select("lang", both).select("lang", "x.*")
    parts = neither.unionByName(alone).unionByName(emitted.where("part = 'pair'").select("lang", "source", "item", "value"))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): of part `pair` each other source of the language, of part `term` the
    `top` terms that the source uses more than its language, the largest values first, ties by the item's UTF-8."""
    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    tables = Tables(docs.sparkSession)
    try:
        counted = given.mapInArrow(count, COUNTED).repartition("lang", "term")
        runs = tables.put("runs", counted.mapInArrow(gather(least), RUN))
        groups = tables.put("groups", sizes(given, runs))
        sized = runs.join(groups.select("lang", "source", "size", "lang_size"), ["lang", "source"]).repartition("lang", "term").sortWithinPartitions("term", "lang", "source")
        emitted = tables.put("emitted", sized.mapInArrow(emit, EMITTED))
        place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        pairs = pair_values(runs, groups, emitted).withColumn("rank", F.row_number().over(place)).withColumn("part", F.lit("pair"))
        terms = emitted.where("part = 'term'").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
        return cut(pairs.select(RESULT).unionByName(terms.select(RESULT)))
    finally:
        tables.clear()
