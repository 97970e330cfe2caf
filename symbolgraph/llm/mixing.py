"""Mixing sources to target weights by iterative proportional fitting.

Every document falls into a cell of source, language and topic. The tokens kept of each cell are raked to the
targets of the three marginals in turn, starting from one rate for all, until the marginals hold; a cell's rate never
exceeds 1. The rate is the inclusion probability of each of the cell's documents, and a hash of the id decides.

A target is a share of the kept tokens. A marginal of which none is given takes its targets from one table of all cells:
their present shares raised to `TEMPERATURE` and normed, so large cells give way to small ones, and none gets more than it
has. Such targets agree with each other, being the marginals of one table that can be drawn. A category that can't fill a
target that is given gives all it has, and the others of its marginal share the rest. What a category that no target names
has is left out.

Topics, where no column has them, are the nearest of `TOPICS` centroids of hashed words, found by `LLOYD` rounds of
spherical k-means over all documents. Words count whole; scripts without spaces give overlapping pairs of characters.

There is a row for each cell; up to `driver_cells` cells, a parameter, are raked in the driver, more by joins and
aggregations: the same steps, ended by the same rule. Targets that contradict each other, or what the sources hold, can't
be met: raking then ends when the rates stay, or after `ROUNDS`, with a warning; `residuals` shows what is missed.

Defined results: a null source or language is a category of its own; null and empty texts have no tokens and topic 0;
rows with equal ids share one draw, as do all rows with a null id; an empty table gives an empty result; columns that are
not named are kept by `mix` and not read.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, boxed, cut, utf8

MARGINALS = ("source", "language", "topic")
TEMPERATURE = 0.6
KEEP = 0.7
TOPICS = 12
DIMENSIONS = 1024
LLOYD = 8
ROUNDS = 60
CLOSE = 1e-4
DRIVER_CELLS = 200_000
SEED = 5
_NULL = "\x00"


#: Bytes of words once A-Z is lower-cased: ASCII letters and digits, and all of other scripts.
_IN_WORD = np.array([48 <= b < 58 or 97 <= b < 123 or b >= 128 for b in range(256)])
#: An odd number and its inverse modulo 2**64, for hashes of stretches by differences of running sums.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
PIECE = 1 << 20


def _powers(of: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, of, np.uint64))))


def _unspaced(a: np.ndarray) -> np.ndarray:
    """Where characters of three bytes begin whose scripts set no spaces: Thai, Lao, Burmese, Khmer, kana, Chinese."""
    b, c = np.append(a[1:], 0), np.append(a[2:], (0, 0))[: len(a)]
    thai, burmese, khmer = (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB), (a == 0xE1) & (b >= 0x80) & (b <= 0x82), (a == 0xE1) & (b >= 0x9E) & (b <= 0x9F)
    return (thai | burmese | khmer | ((a >= 0xE3) & (a <= 0xE9) & ~((a == 0xE3) & (b == 0x80)))) & (c >= 0x80)


def _stretches(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words and pairs of characters of lower-cased UTF-8."""
    word = _IN_WORD[a]
    if (a >= 0xE0).any():
        first = _unspaced(a)
        at = np.flatnonzero(first)
        word[at] = word[at + 1] = word[at + 2] = False
        after, before = first[np.minimum(at + 3, len(a) - 1)] & (at + 3 < len(a)), first[np.maximum(at - 3, 0)] & (at >= 3)
        pairs, alone = at[after], at[~after & ~before]
    else:
        pairs = alone = np.empty(0, np.intp)
    edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
    return np.concatenate((np.flatnonzero(edge == 1), pairs, alone)), np.concatenate((np.flatnonzero(edge == -1), pairs + 6, alone + 3))


def _pieces(text: bytes):
    """The text in pieces of about `PIECE` bytes that end at a space, a tab or a line's end; whole where it has none."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            ends = [x for x in (text.find(s, end) for s in (b" ", b"\n", b"\t")) if x >= 0]
            end = min(ends, default=len(text))
        yield text[at:end]
        at = end


def _count(pieces: list[bytes], of: list[int], out: np.ndarray) -> None:
    """Adds the hashed words of each piece to row `of` of out; the pieces are read as one, a zero byte between two."""
    a = np.frombuffer(b"\0".join(pieces), np.uint8)
    begin, end = _stretches(a)
    up, down = _powers(_BASE, len(a)), _powers(_INVERSE, len(a))  # made here, as the package travels with each closure
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], dtype=np.uint64)))
    code = (sums[end] - sums[begin]) * down[begin]
    code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    lasts = np.cumsum([len(p) + 1 for p in pieces])
    rows = np.asarray(of)[np.searchsorted(lasts, begin, side="right")]
    flat, counts = np.unique(rows * DIMENSIONS + (code >> np.uint64(54)).astype(np.intp), return_counts=True)
    out.reshape(-1)[flat] += counts


def features(texts: list[bytes | None]) -> np.ndarray:
    """Counts of hashed words, and of pairs of characters where a script sets no spaces: a row for each text."""
    out = np.zeros((len(texts), DIMENSIONS), np.int64)
    pieces, of, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in _pieces((text or b"").lower()):
            if pieces and size + len(piece) >= PIECE:
                _count(pieces, of, out)
                pieces, of, size = [], [], 0
            pieces.append(piece)
            of.append(i)
            size += len(piece) + 1
    if pieces:
        _count(pieces, of, out)
    return out


class Topics:
    """Centroids of unit length, and the weights of features."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray):
        self.idf, self.centroids = idf, centroids

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        w = np.sqrt(counts) * self.idf
        return w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12)

    def of(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.empty(len(texts), np.int64)
        for at in range(0, len(texts), 256):
            part = texts[at : at + 256]
            out[at : at + 256] = (self.weigh(features(part)) @ self.centroids.T).argmax(axis=1)
        return out


#: A feature as it is stored: the step from the one before, and its count.
_STORED = np.dtype([("step", "<u2"), ("count", "<u4")])


def _packed(counts: np.ndarray) -> list[bytes]:
    """Each row's counts, all first bytes of its features before all second ones and so on: most are 0, and compress."""
    row, k = np.nonzero(counts)
    out, ends = np.empty(len(k), _STORED), np.searchsorted(row, np.arange(len(counts) + 1))
    out["step"] = np.where(np.diff(row, prepend=-1) > 0, k, np.diff(k, prepend=0))
    out["count"] = counts[row, k]
    planes = out.view(np.uint8).reshape(-1, _STORED.itemsize)
    return [planes[b:e].T.tobytes() for b, e in zip(ends, ends[1:])]


def _dense(rows: list[bytes]) -> np.ndarray:
    """Counts, from rows as stored."""
    sizes = np.array([len(r) // _STORED.itemsize for r in rows], np.intp)
    flat, before = np.frombuffer(b"".join(rows), np.uint8), np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(rows)), sizes)
    at = np.arange(len(row)) + (before * (_STORED.itemsize - 1))[row]
    x = np.stack([flat[at + plane * sizes[row]] for plane in range(_STORED.itemsize)], axis=1).view(_STORED)[:, 0]
    k = np.cumsum(x["step"], dtype=np.intp)
    out = np.zeros((len(rows), DIMENSIONS))
    out[row, k - np.concatenate((np.zeros(1, np.intp), k))[before][row]] = x["count"]
    return out


def _summed(rows: DataFrame, sums) -> np.ndarray:
    """The sum over all tasks of what sums(counts) gives of a batch of rows, (topic, feature) -> value: TOPICS x DIMENSIONS."""

    def total(batches):
        held = np.zeros((TOPICS, DIMENSIONS))
        for batch in batches:
            for at in range(0, len(batch), 512):
                held += sums(_dense(batch.column("x").slice(at, 512).to_pylist()))
        k = np.flatnonzero(held)
        yield pa.record_batch({"k": k, "value": held.ravel()[k]})

    got = rows.select("x").mapInArrow(total, "k long, value double").groupBy("k").agg(F.sum("value").alias("value")).toPandas()  # TOPICS x DIMENSIONS at most
    out = np.zeros(TOPICS * DIMENSIONS)
    out[got.k.to_numpy()] = got.value.to_numpy()
    return out.reshape(TOPICS, DIMENSIONS)


def fit_topics(docs: DataFrame, id_col: str, text_col: str) -> Topics:
    """Spherical k-means over all documents, from the documents of the smallest hashes of their text."""

    @F.arrow_udf("binary")
    def counted(texts: pa.Array) -> pa.Array:
        rows = utf8(texts)
        return pa.array([x for at in range(0, len(rows), 256) for x in _packed(features(rows[at : at + 256]))], pa.binary())

    tables = Tables(docs.sparkSession)
    rows = tables.put("features", docs.select(F.col(text_col).alias("t")).where("t is not null").select(F.xxhash64("t", F.lit(SEED)).alias("h"), counted("t").alias("x")).where(F.octet_length("x") > 0))
    least = [r.h for r in rows.select("h").distinct().orderBy("h").limit(TOPICS).collect()]  # different texts
    first = rows.where(F.col("h").isin(least)).groupBy("h").agg(F.first("x").alias("x")).orderBy("h").collect() if least else []
    count = rows.count()
    if not first:
        return Topics(np.zeros(DIMENSIONS), np.zeros((1, DIMENSIONS)))

    def held(x: np.ndarray) -> np.ndarray:
        out = np.zeros((TOPICS, DIMENSIONS))
        out[0] = (x > 0).sum(axis=0)
        return out

    topics = Topics(np.log((1 + count) / (1 + _summed(rows, held)[0])), np.zeros((1, DIMENSIONS)))
    topics.centroids = topics.weigh(_dense([bytes(r.x) for r in first]))

    def nearest(x: np.ndarray) -> np.ndarray:
        x = topics.weigh(x)
        of = (x @ topics.centroids.T).argmax(axis=1)
        out = np.zeros((TOPICS, DIMENSIONS))
        for k in range(len(topics.centroids)):
            out[k] = x[of == k].sum(axis=0)
        return out

    for _ in range(LLOYD):
        sums = _summed(rows, nearest)[: len(topics.centroids)]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        before, topics.centroids = topics.centroids, np.where(norms > 0, sums / np.maximum(norms, 1e-12), topics.centroids)
        if np.abs(topics.centroids - before).max() < 1e-3:
            break
    topics.centroids = np.round(topics.centroids, 9)  # the order in which tasks are added doesn't matter
    tables.clear()
    return topics


def topic_column(text: Column | str, topics: Topics) -> Column:
    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([str(k) for k in topics.of(utf8(texts))], pa.string())

    return of(text)


def tokens_column(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def target_tokens(have: dict[str, float], wanted: dict[str, float] | None, keep: float, temperature: float) -> dict[str, float]:
    """The tokens to keep of each category of one marginal: no more than it has, keep x all in sum where they suffice."""
    share = {k: wanted.get(k, 0.0) if wanted else (v**temperature if v > 0 else 0.0) for k, v in have.items()}
    out = dict.fromkeys(have, 0.0)
    left, open_ = keep * sum(have.values()), {k for k, s in share.items() if s > 0}
    while open_ and left > 1e-9:
        total = sum(share[k] for k in open_)
        full = {k for k in open_ if left * share[k] / total >= have[k]}
        if not full:
            return out | {k: left * share[k] / total for k in open_}
        out |= {k: float(have[k]) for k in full}
        left -= sum(have[k] for k in full)
        open_ -= full
    return out


def _ended(worst: float, moved: float, round_: int) -> bool:
    """Whether raking is over: the marginals hold, or the rates stay, or its rounds are used up."""
    if worst < CLOSE:
        return True
    if moved < CLOSE / 100 or round_ == ROUNDS - 1:
        warnings.warn(f"raking ends with a marginal that misses its targets by {worst:.3g} of its tokens", stacklevel=2)
        return True
    return False


def rake(cells: pd.DataFrame, targets: dict[str, dict[str, float]], keep: float) -> np.ndarray:
    """Each cell's rate, in the driver."""
    rate, tokens = np.full(len(cells), keep), cells.tokens.to_numpy(float)
    codes = {m: pd.Categorical(cells[m], categories=sorted(targets[m])).codes for m in targets}
    wanted = {m: np.array([targets[m][k] for k in sorted(targets[m])]) for m in targets}
    for round_ in range(ROUNDS):
        worst, before = 0.0, rate
        for m, code in codes.items():
            now = np.bincount(code, rate * tokens, len(wanted[m]))
            worst = max(worst, np.abs(now - wanted[m]).sum() / max(wanted[m].sum(), 1e-9))
            factor = np.divide(wanted[m], now, out=np.where(wanted[m] > 0, 1.0, 0.0), where=now > 0)
            rate = np.minimum(1.0, rate * factor[code])
        if _ended(worst, np.abs(rate - before) @ tokens / max(rate @ tokens, 1e-9), round_):
            break
    return rate


def rake_distributed(cells: DataFrame, targets: dict[str, DataFrame], keep: float) -> DataFrame:
    """The same for any number of cells and categories; targets are (category, wanted) of each marginal."""
    tables = Tables(cells.sparkSession)
    cells = tables.put("cells", cells.withColumn("rate", F.lit(float(keep))))
    for round_ in range(ROUNDS):
        new, worst = cells.withColumn("before", F.col("rate")), 0.0
        for m, wanted in targets.items():
            now = tables.put("now", new.groupBy(m).agg(F.sum(F.col("rate") * F.col("tokens")).alias("now")).join(wanted, m))
            off = now.agg(F.sum(F.abs(F.col("now") - F.col("wanted"))), F.sum("wanted")).first()
            worst = max(worst, (off[0] or 0.0) / max(off[1] or 0.0, 1e-9))
            factor = now.select(m, F.when(F.col("now") > 0, F.col("wanted") / F.col("now")).otherwise(F.signum("wanted")).alias("factor"))
            new = new.join(factor, m).withColumn("rate", F.least(F.lit(1.0), F.col("rate") * F.col("factor"))).drop("factor")
            new = tables.put(f"raked_{m}", new)
        moved = new.agg(F.sum(F.abs(F.col("rate") - F.col("before")) * F.col("tokens")), F.sum(F.col("rate") * F.col("tokens"))).first()
        cells = tables.put("cells", new.drop("before"))
        if _ended(worst, (moved[0] or 0.0) / max(moved[1] or 0.0, 1e-9), round_):
            break
    return cells


def residuals(assigned: DataFrame, targets: dict[str, dict[str, float]]) -> DataFrame:
    """(marginal, category, target, share): what share of the kept tokens each category was to have, and has in expectation."""
    out = None
    for m in targets:
        expected = F.coalesce(F.sum(F.col("tokens") * F.col("probability")), F.lit(0.0))
        total = assigned.agg(expected.alias("total"))
        wanted = assigned.sparkSession.createDataFrame(sorted(targets[m].items()), "category string, target double")
        have = assigned.groupBy(F.coalesce(m, F.lit(_NULL)).alias("category")).agg(expected.alias("have"))
        of = have.join(wanted, "category", "full").join(F.broadcast(total)).select(F.lit(m).alias("marginal"), "category", F.coalesce("target", F.lit(0.0)).alias("target"), (F.coalesce("have", F.lit(0.0)) / F.greatest("total", F.lit(1e-9))).alias("share"))
        out = of if out is None else out.unionByName(of)
    return out


def _fill(have: DataFrame, share: Column, keep: float) -> DataFrame:
    """Rows with `have`, and `wanted`: keep x all in sum by share, no row more than it has. Water-filling: rows that their
    share exhausts are set aside until none is left to."""
    open_ = have.withColumn("share", F.when(F.col("have") > 0, share).otherwise(0.0))
    left, level = keep * (have.agg(F.sum("have")).first()[0] or 0.0), None
    full = F.lit(False)
    for _ in range(100):
        state = open_.agg(F.sum(F.when(~full, F.col("share")).otherwise(0.0)), F.sum(F.when(full, F.col("have")).otherwise(0.0))).first()
        new = (left - (state[1] or 0.0)) / state[0] if state[0] else 0.0
        if level is not None and abs(new - level) <= 1e-12 * max(1.0, abs(level)):
            break
        level = new
        full = F.col("share") * level >= F.col("have")
    return cut(open_.withColumn("wanted", F.least("have", F.col("share") * level)).drop("share"))


def wanted_tokens(cells: pd.DataFrame, targets: dict[str, dict[str, float]] | None, keep: float, temperature: float) -> dict[str, dict[str, float]]:
    """The tokens to keep of each category of each marginal, in the driver: given, or of one tempered table of all cells."""
    tempered = cells.assign(wanted=cells.index.map(target_tokens(cells.tokens.to_dict(), None, keep, temperature)).astype(float))
    return {m: target_tokens(cells.groupby(m).tokens.sum().to_dict(), targets[m], keep, temperature) if (targets or {}).get(m) else tempered.groupby(m).wanted.sum().to_dict() for m in MARGINALS}


def rates(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, temperature: float = TEMPERATURE, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """cells (source, language, topic, tokens) with their rates."""
    spark = cells.sparkSession
    cells = cut(cells)
    if cells.count() <= driver_cells:
        local = cells.toPandas()
        local["rate"] = rake(local, wanted_tokens(local, targets, keep, temperature), keep) if len(local) else []
        return spark.createDataFrame(pa.Table.from_pandas(local[[*MARGINALS, "rate"]].astype({"rate": float}), schema=pa.schema([*((m, pa.string()) for m in MARGINALS), ("rate", pa.float64())]), preserve_index=False))
    tempered = None
    if any(not (targets or {}).get(m) for m in MARGINALS):
        tempered = _fill(cells.withColumn("have", F.col("tokens").cast("double")), F.pow("have", F.lit(temperature)), keep)
    wanted = {}
    for m in MARGINALS:
        if (targets or {}).get(m):
            have = cut(cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("have")))
            wanted[m] = _fill(have, F.coalesce(F.create_map(*(F.lit(x) for kv in targets[m].items() for x in kv))[F.col(m)], F.lit(0.0)), keep).select(m, "wanted")
        else:
            wanted[m] = cut(tempered.groupBy(m).agg(F.sum("wanted").alias("wanted")))
    return rake_distributed(cells, wanted, keep).select(*MARGINALS, "rate")


def _filed(docs: DataFrame, topics: Topics | None, id_col: str, text_col: str, lang_col: str, source_col: str, topic_col: str | None) -> DataFrame:
    """(row, id, source, language, topic, tokens) of each row of docs; row holds all its columns."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(_NULL))
    topic = named(topic_col) if topic_col else topic_column(F.col(text_col), topics)
    return boxed(docs, id=F.col(id_col), source=named(source_col), language=named(lang_col), topic=topic, tokens=tokens_column(F.col(text_col)))


def _drawn(filed: DataFrame, rated: DataFrame, small: bool) -> DataFrame:
    """filed with its rate, the probability, and whether the draw keeps the row."""
    draw = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return filed.join(F.broadcast(rated) if small else rated, list(MARGINALS), "left").withColumn("rate", F.coalesce("rate", F.lit(0.0))).withColumn("kept", draw < F.col("rate"))


def assign(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, temperature: float = TEMPERATURE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", topic_col: str | None = None, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """(id, source, language, topic, tokens, probability, kept) of each row."""
    topics = None if topic_col else fit_topics(docs, id_col, text_col)
    slim = cut(_filed(docs.select(*dict.fromkeys(c for c in (id_col, text_col, lang_col, source_col, topic_col) if c)), topics, id_col, text_col, lang_col, source_col, topic_col).drop("row"))
    cells = cut(slim.groupBy(*MARGINALS).agg(F.sum("tokens").alias("tokens")))
    drawn = _drawn(slim, rates(cells, targets, keep, temperature, driver_cells), cells.count() <= driver_cells)
    shown = lambda c: F.when(F.col(c) != _NULL, F.col(c)).alias(c)
    return drawn.select(F.col("id").alias(id_col), shown("source"), shown("language"), shown("topic"), "tokens", F.col("rate").alias("probability"), "kept")


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, temperature: float = TEMPERATURE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", topic_col: str | None = None, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """The rows of docs that the draw keeps, with all their columns; rows are judged where they are read."""
    topics = None if topic_col else fit_topics(docs, id_col, text_col)
    filed = _filed(docs, topics, id_col, text_col, lang_col, source_col, topic_col)
    cells = cut(filed.groupBy(*MARGINALS).agg(F.sum("tokens").alias("tokens")))
    return _drawn(filed, rates(cells, targets, keep, temperature, driver_cells), cells.count() <= driver_cells).where("kept").select("row.*")
