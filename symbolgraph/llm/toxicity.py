"""Toxicity by the nearest labelled examples, under exact TF-IDF cosine over a block-max inverted index.

A word gives two terms, letters folded: its first `OPENING` letters, which its forms have in common, and what follows
them, at the weight `REST`; so every letter counts. Words of scripts that write no spaces give each pair of neighbouring
letters instead. The vocabulary is every term that a labelled example holds, whatever its label; their document
frequencies are counted over all rows. Labelled examples with equal vectors are one example that remembers how many
rows, and how many toxic ones, it stands for. The index lists each term's examples with their weights in blocks of
`BLOCK` examples and the largest weight in each block. A search bounds every block's cosine by these, scores the
blocks of the largest bounds, then those whose bound isn't below the k-th best cosine found. What common terms add is
summed in single precision, so all within its error of the k-th are kept and scored again in double precision: the
result is that of a full scan.

A text's vote is the share of toxic rows among the examples found, weighted by cosine (nearer examples count more); a
monotone table from votes to the share of toxic rows, measured on the training rows with each one's own row left out,
gives the score. A text without a term of the vocabulary gets the share of toxic rows among such training rows.

Training takes at most about `max_rows` labelled rows (a hash of the id chooses them), of an id that has several texts one.
Document frequencies, and scoring, cover all rows and whole texts.

Defined results: null and empty texts are texts without terms; without labels, or with labels of one class only, every
score is 0; labels other than 0 and 1 and null labels don't train; of several labels of one id the largest counts; ids cast
to long; equal cosines go to the example that comes first in the index; an empty table gives an empty result; only the
named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_share, bucket, hash_share

NEAREST = 15
BLOCK = 64
#: Blocks that a search scores at first; then all that may hold a nearer example.
FIRST = 4
#: Texts that are searched for together.
TOGETHER = 64
#: A term that so large a share of the examples hold keeps a weight for each example instead of a list; so many terms at most.
COMMON, MOST_COMMON = 0.05, 2_048
OPENING = 4
REST = 0.25
MAX_ROWS = 6_000
THRESHOLD = 0.5
SEED = 8
BINS = 200

#: Bytes of texts that are cut into words together, if more than one.
AT_ONCE = 1 << 22

_WORD = re.compile(r"[^\W_]+")
#: ASCII capitals to small letters, all else of ASCII that isn't a letter or digit to a space: no word goes beyond that.
_PIECES = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))
#: Thai to Burmese, Khmer, kana and Chinese characters.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]+")


def parts(text: str | None) -> tuple[list[str], list[str]]:
    """The openings of a text's words and the pairs of unspaced scripts; what follows the openings."""
    low, pairs = (text or "").lower(), []
    if not low.isascii() and _UNSPACED.search(low):
        for run in _UNSPACED.findall(low):
            pairs += [run[k : k + 2] for k in range(max(1, len(run) - 1))]
        low = _UNSPACED.sub(" ", low)
    words = _WORD.findall(low)
    return pairs + [w[:OPENING] for w in words], [w[OPENING:] for w in words if len(w) > OPENING]


def terms(text: str | None) -> Counter:
    """All terms of a text, rests of words with a plus before them."""
    first, rest = parts(text)
    return Counter(first + [f"+{t}" for t in rest])


@dataclass
class Vocabulary:
    places: dict[str, int]

    def __post_init__(self) -> None:
        self.rests = {t[1:]: k for t, k in self.places.items() if t[0] == "+"}

    @cached_property
    def tables(self) -> list[tuple[pa.Array, np.ndarray]]:
        """The terms that openings, and what follows them, are looked up in, and their places; -1 for what isn't there."""
        openings = {t: k for t, k in self.places.items() if t[0] != "+"}
        return [(pa.array([t.encode() for t in held], pa.large_binary()), np.array([*held.values(), -1], np.intp)) for held in (openings, self.rests)]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tables"}  # each task makes its own

    def found(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text, the places of its terms in order, and how often each is there."""
        # A capital sigma's small letter depends on what stands beside it, in other pieces too.
        raw = [(t.lower() if "\u03a3" in t else t).encode() if t else b"" for t in texts]
        size = np.cumsum([0, *map(len, raw)])
        low = 0
        while low < len(raw):
            high = max(low + 1, int(np.searchsorted(size, size[low] + AT_ONCE)) - 1)
            text, at = self._places(b"".join(raw[low:high]), size[low : high + 1] - size[low])
            key, n = np.unique(text * max(len(self.places), 1) + at, return_counts=True)
            ends = np.searchsorted(key, np.arange(high - low + 1) * max(len(self.places), 1))
            at = key % max(len(self.places), 1)
            yield from ((at[a:b], n[a:b]) for a, b in zip(ends[:-1], ends[1:]))
            low = high

    def _places(self, raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts one after another, every known term: the number of its text, and its place."""
        texts = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw.translate(_PIECES))])
        split = pc.ascii_split_whitespace(texts)
        of, pieces = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy()), split.flatten()
        plain = pc.string_is_ascii(pieces)
        words, whose = pieces.filter(plain).cast(pa.large_binary()), of[plain.to_numpy(zero_copy_only=False)]
        text, at = [], []
        for (held, places), part in zip(self.tables, (pc.binary_slice(words, 0, OPENING), pc.binary_slice(words, OPENING, len(raw) + OPENING))):
            k = places[pc.index_in(part, held).fill_null(len(held)).to_numpy()]
            text.append(whose[k >= 0])
            at.append(k[k >= 0])
        # Other pieces may hold several words, or none.
        other = ~plain.to_numpy(zero_copy_only=False)
        if other.any():
            rest, ends = pieces.filter(pc.invert(plain)).to_numpy(zero_copy_only=False), np.searchsorted(of[other], np.arange(len(texts) + 1))
            for i in np.flatnonzero(np.diff(ends)):
                first, after = parts(" ".join(rest[ends[i] : ends[i + 1]]))
                k = np.fromiter(chain(map(self.places.get, first, repeat(-1)), map(self.rests.get, after, repeat(-1))), np.intp, len(first) + len(after))
                at.append(k[k >= 0])
                text.append(np.full(len(at[-1]), i))
        return np.concatenate(text), np.concatenate(at)

    def weights(self) -> np.ndarray:
        out = np.ones(len(self.places))
        out[list(self.rests.values())] = REST
        return out


def unit(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a text, and their TF-IDF weights in a vector of length 1."""
    w = n * idf[at]
    norm = np.sqrt(w @ w)
    return (at, w / norm) if norm > 0 else (at[:0], w[:0])


def runs(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of n numbers from `first`, all numbers one after another, and where each run ends among them."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n), ends


@dataclass
class Model:
    vocabulary: Vocabulary
    idf: np.ndarray
    rows: np.ndarray  # of each example, rows and toxic rows
    toxic: np.ndarray
    ids: np.ndarray  # the smallest id of each example's rows
    common: np.ndarray  # of each term, its row among the common ones, or -1
    starts: np.ndarray  # of each example, its first common term (their row) and weight below, and one more
    held_rows: np.ndarray
    held_weights: np.ndarray
    lists: np.ndarray  # of each term, its first list below, and one more; a list is of a term and a block that holds it
    block: np.ndarray  # of each list its block, the largest weight, the first posting, and how many
    bounds: np.ndarray
    first: np.ndarray
    held: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    empty: float
    votes: np.ndarray
    shares: np.ndarray

    def vector(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return unit(at, n, self.idf)

    @cached_property
    def whole(self) -> np.ndarray:
        """Common term x example, all blocks filled up with zeros: the weight."""
        out = np.zeros((self.common.max(initial=-1) + 1, -(-len(self.rows) // BLOCK) * BLOCK), np.float32)
        out[self.held_rows, np.repeat(np.arange(len(self.rows)), np.diff(self.starts))] = self.held_weights
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "whole"}  # each task fills its own

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each vector, the k examples of largest cosine above 0, and their cosines."""
        out = []
        for low in range(0, len(vectors), TOGETHER):
            part = vectors[low : low + TOGETHER]
            x = np.zeros((len(part), len(self.whole)))
            for i, (at, w) in enumerate(part):
                row = self.common[at]
                x[i, row[row >= 0]] = w[row >= 0]
            out += [self._nearest(at, w, own, begun, k) for (at, w), own, begun in zip(part, x, x.astype(np.float32) @ self.whole)]
        return out

    def _nearest(self, at: np.ndarray, w: np.ndarray, own: np.ndarray, begun: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """own: the vector's weights of common terms. begun: what these add to each example, in single precision."""
        # A sum of n products of two vectors of length 1 errs by less than n + 4 half units of its precision: twice that.
        slack = (len(self.whole) + 8) * float(np.finfo(np.float32).eps) + 1e-6
        rare = self.common[at] < 0
        at, w = at[rare], w[rare]
        n = self.lists[at + 1] - self.lists[at]
        lists, _ = runs(self.lists[at], n)
        at, w = self.block[lists], np.repeat(w, n)
        best = begun.reshape(-1, BLOCK).max(axis=1)
        bound = best + np.bincount(at, w * self.bounds[lists], len(best))
        # Rare terms only add to what an example has, so the k-th largest of that is a first floor.
        least = np.partition(best, len(best) - k)[len(best) - k] if len(best) >= k else 0.0
        open_ = bound > 0
        found, rest, score = np.empty(0, np.intp), np.empty(0), np.empty(0)
        for last in (False, True):
            now = open_ & (bound >= least - slack)
            if not last and len(bound) > FIRST:
                now &= bound >= np.partition(bound, len(bound) - FIRST)[len(bound) - FIRST]
            open_ &= ~now
            blocks = np.flatnonzero(now)
            if not len(blocks):
                continue
            some = np.flatnonzero(now[at])
            chosen = lists[some]
            n = self.held[chosen]
            posting, _ = runs(self.first[chosen], n)
            added = np.bincount(self.example[posting], np.repeat(w[some], n) * self.weight[posting], len(begun))
            total = (begun + added).reshape(-1, BLOCK)[blocks]
            row, inside = np.nonzero(total > max(0.0, least - slack))
            these = blocks[row] * BLOCK + inside
            found, rest, score = np.append(found, these), np.append(rest, added[these]), np.append(score, total[row, inside])
            if len(score) >= k:
                least = max(least, np.partition(score, len(score) - k)[len(score) - k])
        near = score >= least - slack
        found, score = found[near], rest[near]
        n = self.starts[found + 1] - self.starts[found]
        posting, _ = runs(self.starts[found], n)
        score = score + np.bincount(np.repeat(np.arange(len(found)), n), own[self.held_rows[posting]] * self.held_weights[posting], len(found))
        order = np.lexsort((found, -np.round(score, 12)))[:k]
        return found[order], score[order]

    def vote(self, found: np.ndarray, score: np.ndarray, own: int | None = None) -> float | None:
        """The cosine-weighted share of toxic rows among the examples found. own: the label of a training row, which is left
        out of the example that it is part of."""
        rows, toxic = self.rows[found].astype(float), self.toxic[found].astype(float)
        if own is not None and len(found) and score[0] > 1 - 1e-9:
            rows[0], toxic[0] = rows[0] - 1, toxic[0] - own
        # An example of many rows votes once for each, up to as many as were asked for in all.
        left = np.clip(NEAREST - np.concatenate(([0], np.cumsum(rows)[:-1])), 0, None) if len(rows) else rows
        weight = score * np.minimum(rows, left)
        total = weight.sum()
        return float(weight @ (toxic / np.maximum(rows, 1)) / total) if total > 0 else None

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[tuple[int, float]]]]:
        """The score of each text, and its nearest examples' ids and cosines; texts that are equal are searched for once."""
        different, out = list(dict.fromkeys(texts)), {}
        for text, (found, score) in zip(different, self.nearest([self.vector(*found) for found in self.vocabulary.found(different)], NEAREST)):
            vote = self.vote(found, score)
            out[text] = self.empty if vote is None else float(np.interp(vote, self.votes, self.shares)), list(zip(self.ids[found].tolist(), score.tolist()))
        return [out[t] for t in texts]


def build(vocabulary: Vocabulary, idf: np.ndarray, vectors: list[tuple[int, int, tuple]]) -> Model:
    """vectors: (id, label, sorted (term, count) pairs) of the training rows."""
    groups: dict[tuple, list[int]] = {}
    for doc, label, key in vectors:
        g = groups.setdefault(key, [doc, 0, 0])
        g[0], g[1], g[2] = min(g[0], doc), g[1] + 1, g[2] + label
    none = groups.pop((), [0, 0, 0])
    rate = sum(x[1] for x in vectors) / len(vectors) if vectors else 0.0
    # Examples whose weightiest term is the same lie together, so that blocks differ in their bounds.
    keys = sorted(groups, key=lambda key: (max((n * idf[t], t) for t, n in key)[1], key))
    found = [unit(*np.array(key, np.intp).T, idf) for key in keys]
    term = np.concatenate([np.empty(0, np.intp), *(at for at, _ in found)])
    weight = np.concatenate([np.empty(0), *(w for _, w in found)])
    example = np.repeat(np.arange(len(keys)), [len(at) for at, _ in found])
    blocks = -(-len(keys) // BLOCK)
    often = np.bincount(term, minlength=len(idf))
    often = np.argsort(-often, kind="stable")[: min(MOST_COMMON, int((often > COMMON * len(keys)).sum()))]
    common = np.full(len(idf), -1)
    common[often] = np.arange(len(often))
    dense = common[term] >= 0
    forward = np.searchsorted(example[dense], np.arange(len(keys) + 1)), common[term[dense]].astype(np.int32), weight[dense]
    term, weight, example = term[~dense], weight[~dense], example[~dense]
    order = np.lexsort((example, term))
    term, weight, example = term[order], weight[order], example[order]
    key, first, held = np.unique(term * max(blocks, 1) + example // BLOCK, return_index=True, return_counts=True)
    bounds = np.nextafter(np.maximum.reduceat(weight, first).astype(np.float32), np.float32(2)) if len(key) else np.empty(0, np.float32)
    lists = np.searchsorted(key, np.arange(len(idf) + 1) * max(blocks, 1))
    model = Model(vocabulary, idf, np.array([groups[k][1] for k in keys]), np.array([groups[k][2] for k in keys]), np.array([groups[k][0] for k in keys], np.int64), common, *forward, lists, key % max(blocks, 1), bounds, first, held, example, weight, (none[2] + rate) / (none[1] + 1), np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    # Calibration: pool adjacent violators over the training rows' votes.
    alike: dict[tuple, int] = {}
    for _, label, key in vectors:
        if key:
            alike[key, label] = alike.get((key, label), 0) + 1
    votes = {key: got for key, got in zip(keys, model.nearest(found, NEAREST))}
    measured = sorted((v, label) for (key, label), n in alike.items() for v in [model.vote(*votes[key], own=label)] if v is not None for _ in range(n))
    pools: list[list[float]] = []
    for part in np.array_split(np.array(measured), min(BINS, max(1, len(measured) // 15))) if measured else []:
        pools.append([part[:, 0].sum(), part[:, 1].sum(), len(part)])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    if pools:
        model.votes = np.array([v / m for v, _, m in pools])
        model.shares = np.array([(y + rate) / (m + 1) for _, y, m in pools])
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    known = known.where(hash_share("id", bounded_share(known.count(), max_rows), SEED))

    @F.arrow_udf("string")
    def told(texts: pa.Array) -> pa.Array:
        return pa.array([" ".join(f"{t} {n}" for t, n in sorted(terms(x).items())) for x in texts.to_pylist()], pa.string())

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")  # about max_rows ids
    rows = rows.select(F.col("id").cast("long").alias("id"), "y", told("text").alias("told")).groupBy("id", "y").agg(F.min("told").alias("told"))
    got = sorted((r.id, r.y, r.told.split(" ") if r.told else []) for r in rows.collect())  # one row an id
    if len({y for _, y, _ in got}) < 2:
        return build(Vocabulary({}), np.empty(0), [])
    vocabulary = Vocabulary({t: i for i, t in enumerate(sorted({t for *_, x in got for t in x[::2]}))})
    size = len(vocabulary.places)

    def frequencies(batches):
        df, n = np.zeros(size, np.int64), 0
        for batch in batches:
            texts = Counter(batch.column("text").to_pylist())
            n += batch.num_rows
            for (at, _), copies in zip(vocabulary.found(list(texts)), texts.values()):
                df[at] += copies
        at = np.flatnonzero(df)
        yield pa.record_batch({"term": np.append(at, -1), "n": np.append(df[at], n)})

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # one row a term
    df = np.bincount(counted.term[counted.term >= 0], counted.n[counted.term >= 0], size)
    idf = (np.log((1 + int(counted.n[counted.term < 0].sum())) / (1 + df)) + 1e-9) * vocabulary.weights()
    vectors = [(i, y, tuple(sorted((vocabulary.places[t], int(n)) for t, n in zip(x[::2], x[1::2])))) for i, y, x in got]
    del got  # not held while the model is built, which is when the driver needs most
    return build(vocabulary, idf, vectors)


def score_column(text: Column | str, model: Model) -> Column:
    """struct<score, evidence> of a text column; evidence is the nearest examples' ids and cosines."""
    @F.arrow_udf("struct<score:double,evidence:array<struct<id:long,cosine:double>>>")
    def of(texts: pa.Array) -> pa.Array:
        found = model.scores(texts.to_pylist())
        evidence = pa.array([[dict(id=i, cosine=c) for i, c in e] for _, e in found], pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64())])))
        return pa.StructArray.from_arrays([pa.array([s for s, _ in found], pa.float64()), evidence], names=["score", "evidence"])

    return of(text)


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labels that may train: those of an id whose crc32 modulo 5 isn't 0."""
    return labels.where(bucket(id_col, 5) != 0)


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted, evidence) of each row of docs."""
    found = docs.select(F.col(id_col), score_column(F.col(text_col), model).alias("found"))
    return found.select(
        F.col(id_col),
        F.coalesce(bucket(id_col, 5) == 0, F.lit(False)).alias("held_out"),
        F.col("found.score").alias("score"),
        (F.col("found.score") >= THRESHOLD).cast("int").alias("predicted"),
        F.col("found.evidence").alias("evidence"),
    )
