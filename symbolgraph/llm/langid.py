"""Language identification by multilingual mixture inference.

Every language has smoothed likelihoods of byte trigrams, counted over all labelled training rows. A
document's trigrams are taken as drawn from a mixture of languages and a flat background (text of no known
language); expectation-maximisation estimates the proportions. Languages join the document's set in the
order of their estimated proportions for as long as the penalised likelihood grows (half a log of the
sample size for each language more, times `CORRELATION`, as overlapping trigrams repeat each other).

Defined results: a null text or one without a letter is `und` with score 0, as is every text when nothing
could be learned; rows with null text or language don't train; equal proportions go to the first language
in code-point order; repeated rows count repeatedly in training; an empty table gives an empty result; only
the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket, utf8

UNKNOWN = "und"
CODES = 64**3
SMOOTHING = 0.05
BACKGROUND = 1 / 40**3
CORRELATION = 3.0
ROUNDS = 25
MAX_LANGUAGES = 200
#: Bytes a step of counting takes at once.
PIECE = 1 << 20

# a-z are classes 1 to 26, other ASCII is a gap, the rest share classes 27 to 63.
_CLASS = np.array([0 if b < 128 and not chr(b).isalpha() else ord(chr(b).lower()) - 96 if b < 128 else 27 + b % 37 for b in range(256)], np.uint8)


def trigrams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a text's trigrams, and how often each occurs. Gaps of any length count as one."""
    codes, counts = np.empty(0, np.int32), np.empty(0, np.int64)
    for at in range(0, len(text), PIECE):
        a = _CLASS[np.frombuffer(text, np.uint8)[at : at + PIECE + 2]].astype(np.int32)
        keep = np.ones(len(a), bool)
        keep[1:] = (a[1:] != 0) | (a[:-1] != 0)
        a = a[keep]
        if len(a) < 3:
            a = np.concatenate(([0], a, [0])).astype(np.int32)
        found, n = np.unique((a[:-2] << 12) | (a[1:-1] << 6) | a[2:], return_counts=True)
        if not len(codes):
            codes, counts = found, n
        else:
            codes, at_code = np.unique(np.concatenate((codes, found)), return_inverse=True)
            counts = np.bincount(at_code, np.concatenate((counts, n))).astype(np.int64)
    return codes, counts


def has_letter(text: bytes) -> bool:
    return any(97 <= b | 32 <= 122 for b in text[:64]) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


@dataclass
class Model:
    languages: list[str]
    likelihood: np.ndarray  # one row a language, then the background

    def proportions(self, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
        """EM over the given rows of likelihoods: the proportions, and the log-likelihood."""
        n = counts.sum()
        share = np.full(len(rows), 1 / len(rows))
        for _ in range(ROUNDS):
            new = share * (rows @ (counts / (share @ rows))) / n
            done = np.abs(new - share).max() < 1e-3
            share = new
            if done:
                break
        return share, float(counts @ np.log(share @ rows))

    def identify(self, text: bytes | None) -> tuple[str, float, dict[str, float]]:
        """The language, its share of the text, and the shares of all languages in the document's set."""
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, {}
        codes, counts = trigrams(text)
        counts = counts.astype(np.float64)
        rows = self.likelihood[:, codes]
        last = len(self.languages)
        share, most = self.proportions(rows, counts)
        order = np.argsort(-share[:last], kind="stable")
        penalty = CORRELATION * 0.5 * np.log(counts.sum() + 1)
        size, (best, score) = 1, self.proportions(rows[[order[0], last]], counts)
        while size < last and most - penalty * size > score - penalty * (size - 1):  # no larger set can be likelier than all languages
            wider, likelier = self.proportions(rows[[*order[: size + 1], last]], counts)
            if likelier - penalty <= score:
                break
            size, best, score = size + 1, wider, likelier
        shares = {self.languages[k]: float(best[i]) for i, k in enumerate(order[:size])}
        top = min(shares, key=lambda x: (-shares[x], x))
        return top, min(1.0, max(0.0, shares[top])), shares


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_languages: int = MAX_LANGUAGES) -> Model:
    """Likelihoods from all rows of docs. What comes to the driver is bounded by max_languages x CODES counts; a table of more
    languages is refused."""
    labelled = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text"))):
                codes, n = trigrams(text)
                sums.setdefault(lang, np.zeros(CODES, np.int64))[codes] += n
        for lang, n in sums.items():
            codes = np.flatnonzero(n)
            yield pa.record_batch({"lang": [lang] * len(codes), "code": codes.astype(np.int32), "n": n[codes]})

    found = labelled.select("lang").distinct().limit(max_languages + 1).count()
    if found > max_languages:
        raise ValueError(f"more than {max_languages} languages; a model holds {CODES} counts of each")
    counted = labelled.mapInArrow(count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    got = counted.toPandas()
    languages = sorted(got.lang.unique())
    n = np.zeros((len(languages) + 1, CODES))
    n[pd.Categorical(got.lang, categories=languages).codes, got.code.to_numpy()] = got.n.to_numpy()
    likelihood = (n + SMOOTHING) / (n.sum(axis=1, keepdims=True) + SMOOTHING * CODES)
    likelihood[-1] = BACKGROUND
    return Model(languages, likelihood)


def identify_column(text: Column | str, model: Model) -> Column:
    """struct<lang, score, shares> of a text column."""

    @F.arrow_udf("struct<lang:string,score:double,shares:map<string,double>>")
    def of(texts: pa.Array) -> pa.Array:
        found = [model.identify(t) for t in utf8(texts)]
        return pa.StructArray.from_arrays(
            [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([list(x[2].items()) for x in found], pa.map_(pa.string(), pa.float64()))],
            names=["lang", "score", "shares"],
        )

    return of(text)


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that may train: those of an id whose crc32 modulo 3 isn't 1."""
    return docs.where(bucket(id_col, 3) != 1)


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, shares) of each row of docs. Without a model, it learns from the training rows."""
    model = model or train(training_rows(docs, id_col), text_col, lang_col)
    found = docs.select(F.col(id_col), identify_column(F.col(text_col), model).alias("found"))
    return found.select(
        F.col(id_col),
        F.coalesce(bucket(id_col, 3) == 1, F.lit(False)).alias("held_out"),
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
        F.col("found.shares").alias("shares"),
    )
