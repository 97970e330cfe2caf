"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, filters of WIDTH bytes run over overlapping chunks that together cover the whole text,
each filter's activation is max-pooled over its chunk, and the mean of the pooled vectors over all chunks,
with how short the text is, gives one probability through a logistic layer. As an embedding followed by a filter is a table of 256 rows
for each of the filter's places, scoring adds WIDTH table rows at each byte.

Training reads every byte of at most about `max_rows` labelled rows, a parameter (a hash of the id chooses them; of an id that
has several texts one). Scoring reads every byte of every text.

Defined results: null and empty texts are scored as a text of one gap; without any labelled row every score
is 0.5; with labels of one class only, scores lean to that class; labels other than 0 and 1 and null labels
don't train; repeated rows train once; ties don't arise; an empty table gives an empty result; only the named columns are
read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_share, bucket, hash_share, utf8

WIDTH = 5
EMBEDDED = 6
FILTERS = 16
GAPS = 3
CHUNK = 1024
STEP = 1008
EPOCHS = 10
#: A small sample is gone over more often.
LEAST_STEPS = 500
BATCH = 32
RATE = 0.004
MAX_ROWS = 3000
THRESHOLD = 0.7
SEED = 7
#: Chunks that scoring takes at once, for bounded memory.
PIECE = 256


def chunks(text: bytes) -> np.ndarray:
    """Overlapping chunks that cover the whole text; a text shorter than a chunk is one chunk with gaps added."""
    a = np.frombuffer(text or b" ", np.uint8)
    if len(a) <= CHUNK:
        return np.concatenate((a, np.full(max(0, WIDTH - len(a)), 32, np.uint8)))[None, :]
    starts = np.arange(0, len(a) - CHUNK + STEP, STEP)
    starts[-1] = len(a) - CHUNK
    return np.lib.stride_tricks.sliding_window_view(a, CHUNK)[starts]


def gaps(length: int) -> np.ndarray:
    """How much a text of so many bytes leaves empty of a chunk, of a paragraph and of a line."""
    return np.array([max(0.0, 1 - length / CHUNK), *(np.exp(-length / n) if length < CHUNK else 0.0 for n in (256, 64))])


@dataclass
class Model:
    tables: np.ndarray  # WIDTH x 256 x FILTERS, whole numbers that can't overflow when WIDTH of them are added
    unit: float  # what 1 stands for in the tables
    bias: np.ndarray
    weights: np.ndarray
    offset: float

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        n = rows.shape[1] - WIDTH + 1
        best = np.empty((len(rows), len(self.bias)), np.float32)
        place = np.empty((n, len(self.bias)), np.int16)
        for i, row in enumerate(rows.astype(np.intp)):
            total = self.tables[0].take(row[:n], axis=0)
            for j in range(1, WIDTH):
                total += np.take(self.tables[j], row[j : j + n], axis=0, out=place, mode="clip")
            best[i] = total.max(axis=0)
        return np.maximum(best * self.unit + self.bias, 0)

    def score(self, text: bytes | None) -> float:
        rows = chunks(text or b"")
        total = np.zeros(len(self.bias))
        for at in range(0, len(rows), PIECE):
            total += self.pooled(rows[at : at + PIECE]).sum(axis=0)
        z = float(total @ self.weights[:-GAPS]) / len(rows) + float(gaps(rows.shape[1]) @ self.weights[-GAPS:]) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(samples: list[bytes], labels: np.ndarray) -> Model:
    """Adam on the logistic loss, of whole texts."""
    rng = np.random.default_rng(SEED)
    par = {
        "embed": rng.normal(0, 0.5, (256, EMBEDDED)),
        "filters": rng.normal(0, 1 / np.sqrt(WIDTH * EMBEDDED), (WIDTH * EMBEDDED, FILTERS)),
        "bias": np.zeros(FILTERS),
        "weights": rng.normal(0, 0.1, FILTERS + GAPS),
        "offset": np.zeros(1),
    }
    par = {k: v.astype(np.float32) for k, v in par.items()}
    if not len(labels):
        return Model(np.zeros((WIDTH, 256, FILTERS), np.int16), 1.0, par["bias"], np.zeros(FILTERS + GAPS), 0.0)
    rate = np.clip(labels.mean(), 0.02, 0.98)
    par["offset"][0] = np.log(rate / (1 - rate))
    first, second, step = {k: np.zeros_like(v) for k, v in par.items()}, {k: np.zeros_like(v) for k, v in par.items()}, 0
    for _ in range(max(EPOCHS, LEAST_STEPS * BATCH // len(samples))):
        order = rng.permutation(len(samples))
        for at in range(0, len(order), BATCH):
            take = order[at : at + BATCH]
            parts = [chunks(samples[i]) for i in take]
            a = np.concatenate([np.pad(c, ((0, 0), (0, CHUNK - c.shape[1])), constant_values=32) for c in parts])
            owner = np.repeat(np.arange(len(parts)), [len(c) for c in parts])
            share = (1 / np.array([len(c) for c in parts], np.float32))[owner][:, None]
            n = CHUNK - WIDTH + 1
            tables = np.einsum("be,wef->wbf", par["embed"], par["filters"].reshape(WIDTH, EMBEDDED, FILTERS))
            where, top = np.empty((len(a), FILTERS), np.intp), np.empty((len(a), FILTERS), np.float32)  # chunk x filter
            for low in range(0, len(a), PIECE // 4):
                some = a[low : low + PIECE // 4]
                total = tables[0][some[:, :n]]
                for j in range(1, WIDTH):
                    total += tables[j][some[:, j : j + n]]
                where[low : low + PIECE // 4] = total.argmax(axis=1)
                top[low : low + PIECE // 4] = total.max(axis=1) + par["bias"]
            pool = np.maximum(top, 0)
            mean = np.zeros((len(take), FILTERS), np.float32)
            np.add.at(mean, owner, pool * share)
            mean = np.hstack((mean, np.array([gaps(c.shape[1]) for c in parts], np.float32)))
            z = mean @ par["weights"] + par["offset"]
            wrong = (1 / (1 + np.exp(-z)) - labels[take]).astype(np.float32) / len(take)
            back = (wrong[owner][:, None] * share) * par["weights"][:-GAPS] * (top > 0)  # chunk x filter
            grad = {"weights": mean.T @ wrong + 1e-4 * par["weights"], "offset": wrong.sum(keepdims=True), "bias": back.sum(axis=0), "embed": np.zeros_like(par["embed"]), "filters": np.zeros((WIDTH, EMBEDDED, FILTERS), np.float32)}
            filters = par["filters"].reshape(WIDTH, EMBEDDED, FILTERS)
            for j in range(WIDTH):
                seen = np.take_along_axis(a, where + j, 1)  # the byte under place j of each filter at its best position
                grad["filters"][j] = np.einsum("cfe,cf->ef", par["embed"][seen], back)
                np.add.at(grad["embed"], seen.ravel(), (back[:, :, None] * filters[j].T[None]).reshape(-1, EMBEDDED))
            grad["filters"] = grad["filters"].reshape(WIDTH * EMBEDDED, FILTERS)
            step += 1
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                par[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    tables = np.einsum("be,wef->wbf", par["embed"], par["filters"].reshape(WIDTH, EMBEDDED, FILTERS)).astype(np.float32)
    unit = float(np.abs(tables).max()) / (32000 // WIDTH)
    return Model(np.round(tables / unit).astype(np.int16), unit, par["bias"], par["weights"].astype(np.float64), float(par["offset"][0]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Learn from the rows of docs that have a label. About max_rows texts come to the driver."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    known = known.where(hash_share("id", bounded_share(known.count(), max_rows), SEED))
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")  # about max_rows ids
    rows = sorted(joined.groupBy("id", "y").agg(F.min("text").alias("text")).toLocalIterator(), key=lambda r: r.id)
    return fit([(r.text or "").encode() for r in rows], np.array([r.y for r in rows], np.float64))


def score_column(text: Column | str, model: Model) -> Column:
    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t) for t in utf8(texts)], pa.float64())

    return of(text)


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labels that may train: those of an id whose crc32 modulo 4 isn't 2."""
    return labels.where(bucket(id_col, 4) != 2)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of each row of docs."""
    return docs.select(F.col(id_col), score_column(F.col(text_col), model).alias("score")).select(
        F.col(id_col),
        F.coalesce(bucket(id_col, 4) == 2, F.lit(False)).alias("held_out"),
        F.col("score"),
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
