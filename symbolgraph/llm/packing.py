"""Packing documents into sequences of a fixed number of tokens.

A document is its tokens and an end token; only a document longer than a sequence is cut, into whole sequences and a
first piece with the rest. Packing looks at lengths alone, of which there are no more than a sequence has tokens, so
the plan is made from how many pieces there are of each length: from the longest down, a piece's gap is looked up among
the sums of one, two and three lengths, and a combination that fills it exactly is consumed as often as all its lengths
are there. What is left is filled best-fit, the longest piece that fits first, with exact complements sought again for
every gap on the way. Spark then deals the pieces of each length, numbered within it, to the plan's places.

A null text is empty, and an empty text is the end token alone. Rows that repeat are packed each; ids may be null. An
empty table gives an empty result. Very long texts are tokenized in stretches. Which of equally long pieces goes where
depends on how Spark dealt the rows; the number of sequences doesn't.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, cut

SIZE, END = 1024, 2
#: Pieces of text whose tokens a task remembers, the longest of them, and characters taken at once.
REMEMBERED, SHORT, STRETCH = 1_000_000, 48, 1 << 20

#: A space after what isn't white space by any library's reading begins a token, whatever stands before or after it.
BREAK = re.compile(r"(?<=[^\s᠎​﻿]) ")


#: Characters that all libraries class alike; `<` begins the special tokens.
PLAIN = re.compile(r"[\n -;=-~\u00c0-\u024f]*")


class Encoder:
    """Token ids of texts, as bytes of little-endian 32-bit numbers.

    The tokenizer reads a text as words with the space before them, so no token spans a break, and each stretch between
    breaks has the tokens that it has alone: what was tokenized once is looked up. Where `ranks` names (the same
    vocabulary as ranks, its pattern), stretches of plain characters are tokenized by those, which gives the same ids in
    a quarter of the time; all others are the tokenizer's.
    """

    def __init__(self, path: str, ranks: tuple[str, str] | None = None):
        from tokenizers import Tokenizer

        self.tokenizer, self.plain = Tokenizer.from_file(path), None
        self.known: dict[str, bytes] = {}
        if ranks:
            import tiktoken

            with open(ranks[0], "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.plain = tiktoken.Encoding("plain", pat_str=ranks[1], mergeable_ranks=table, special_tokens={})

    def _ids(self, text: str) -> bytes:
        if self.plain and PLAIN.fullmatch(text):
            return np.array(self.plain.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _missing(self, piece: str) -> bytes:
        found = self._ids(" " + piece)
        if len(piece) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            gap = BREAK.search(text, at + STRETCH)
            end = gap.start() if gap else len(text)  # the space opens the next stretch
            stretch, at = text[at:end], end
            if self.plain and PLAIN.fullmatch(stretch):
                out.append(self._ids(stretch))
                continue
            first, *pieces = BREAK.split(stretch)
            known = self.known
            out.append(self._ids(first))
            out += [known.get(p) or self._missing(p) for p in pieces]
        return b"".join(out)


def lengths(tokens: int, size: int) -> list[int]:
    """The lengths of a document's pieces: the rest first, then whole sequences."""
    rest = tokens % size
    return ([rest] if rest else []) + [size] * (tokens // size)


def tokenized(docs: DataFrame, path: str, ranks: tuple[str, str] | None, id_col: str, text_col: str, size: int, end: int, keep_ids: bool) -> DataFrame:
    """A row for each piece: its place in its document, the CRC of its ids, and its number among the pieces of its
    length that the same task has made (block, local)."""
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = T.StructType([given.schema["id"]] + [T.StructField(n, T.LongType()) for n in ("piece", "start", "length", "ids_crc32", "block", "local")] + [T.StructField("ids", T.BinaryType())] * keep_ids)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ending = Encoder(path, ranks), np.array([end], "<u4").tobytes()
        block, seen = TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in batches:
            rows, at, ids = [], [], []
            for k, text in enumerate(batch["text"]):
                tokens, start = encoder.encode(text.as_py()) + ending, 0
                for piece, n in enumerate(lengths(len(tokens) // 4, size)):
                    part = tokens[4 * start : 4 * (start + n)]
                    rows.append((piece, start, n, zlib.crc32(part), block, seen[n]))
                    at.append(k)
                    if keep_ids:
                        ids.append(part)
                    seen[n] += 1
                    start += n
            columns = np.array(rows, np.int64).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(at, pa.int64())), *map(pa.array, columns), *([pa.array(ids, pa.binary())] if keep_ids else [])], kind.names)

    return given.mapInArrow(pieces, kind)


class Complements:
    """Which lengths still there add up to a sum: one, two or three of them, none longer than the longest there is.

    Lengths only become fewer, so what has once failed for a sum fails for good, and each sum's search goes on where it
    stopped.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        self.second = [s - 1 for s in range(len(left))]
        self.third = [s - 2 for s in range(len(left))]

    def _two(self, total: int, most: int) -> tuple[int, int] | None:
        for b in range(min(most, total - 1), (total + 1) // 2 - 1, -1):
            if self.left[b] and self.left[total - b] and (2 * b != total or self.left[b] > 1):
                return b, total - b
        return None

    def find(self, total: int) -> tuple[int, ...] | None:
        if self.left[total]:
            return (total,)
        pair = self._two(total, self.second[total])
        self.second[total] = pair[0] if pair else 0
        if pair:
            return pair
        there = np.flatnonzero(self.left[: max(self.third[total], 0) + 1])
        for a in there[there >= (total + 2) // 3][::-1].tolist():
            self.left[a] -= 1
            pair = self._two(total - a, a)
            self.left[a] += 1
            if pair:
                self.third[total] = a
                return (a, *pair)
        self.third[total] = 0
        return None


def _consume(left: np.ndarray, pattern: list[int]) -> int:
    """Take the pattern as often as its lengths are there."""
    need = np.bincount(pattern, minlength=len(left))
    times = int((left[need > 0] // need[need > 0]).min())
    left -= need * times
    return times


def plan(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences), for so many pieces of each length."""
    left = np.zeros(size + 1, np.int64)
    for n, many in counts.items():
        left[n] = many
    out: list[tuple[list[int], int]] = []
    if left[size]:
        out.append(([size], int(left[size])))
        left[size] = 0
    index = Complements(left)
    for exact in (True, False):
        for longest in range(size - 1, 0, -1):
            while left[longest]:
                pattern, gap = [longest], size - longest
                left[longest] -= 1
                while gap:
                    found = index.find(gap)
                    if found is None and not exact:
                        fits = np.flatnonzero(left[: gap + 1])
                        found = (int(fits[-1]),) if len(fits) else None
                    if found is None:
                        break
                    for n in found:
                        left[n] -= 1
                    pattern += found
                    gap -= sum(found)
                left += np.bincount(pattern, minlength=size + 1)
                if exact and gap:
                    break
                out.append((pattern, _consume(left, pattern)))
    return out


def places(patterns: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, first offset, sequences): the pieces of a length from that rank on fill
    the pattern's first place of that length in all its sequences, then the next place, and so on."""
    rows, sequence, rank = [], 0, {}
    for pattern, times in patterns:
        offset = 0
        for n in sorted(set(pattern), reverse=True):
            k = pattern.count(n)
            rows.append((n, rank.get(n, 0), sequence, offset, times))
            rank[n] = rank.get(n, 0) + k * times
            offset += n * k
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def dealt(table: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by their length and rank in it."""
    starts = np.searchsorted(table[:, 0], length, "left"), np.searchsorted(table[:, 0], length, "right")
    low, high = starts
    while (high - low > 1).any():  # the last row of the length whose first rank isn't beyond
        middle = np.maximum((low + high) // 2, low)
        below = table[middle, 1] <= rank
        low, high = np.where(below, middle, low), np.where(below, np.maximum(high, low), middle)
        high = np.maximum(high, low + 1)
    row = table[low]
    nth = rank - row[:, 1]
    return row[:, 2] + nth % row[:, 4], row[:, 3] + nth // row[:, 4] * length


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, keep_ids: bool = False, ranks: tuple[str, str] | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece, and its ids if they are to be kept.
    path is a file of a byte-level tokenizer; ranks, if given, the same vocabulary for Encoder."""
    tables = Tables(docs.sparkSession)
    try:
        pieces = tables.put("pieces", tokenized(docs, path, ranks, id_col, text_col, size, end, keep_ids))
        counts = tables.put("counts", pieces.groupBy("block", "length").agg(F.count("*").alias("n")))
        made = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length at most
        table = places(plan(made, size))
        before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        base = counts.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
        ranked = pieces.join(base, ["block", "length"]).select(*(c for c in pieces.columns if c not in ("block", "local")), (F.col("base") + F.col("local")).alias("rank"))
        kind = T.StructType([f for f in ranked.schema.fields if f.name != "rank"] + [T.StructField(n, T.LongType()) for n in ("sequence_id", "offset")])

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    found = dealt(table, batch["length"].to_numpy(), batch["rank"].to_numpy())
                    yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names if c != "rank"), *map(pa.array, found)], kind.names)

        return cut(ranked.mapInArrow(placed, kind)).withColumnRenamed("id", id_col)
    finally:
        tables.clear()


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, starts) of what pack() made with its ids kept: the tokens of each sequence, and where in it
    each piece begins. A sequence has no more pieces than tokens."""
    kind = "sequence_id long, ids array<int>, starts array<long>"

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted((p["offset"], p["ids"]) for p in r) for r in batch["pieces"].to_pylist()]
            ids = [np.frombuffer(b"".join(x for _, x in r), "<i4") for r in rows]
            yield pa.RecordBatch.from_arrays([batch["sequence_id"], pa.array(ids, pa.list_(pa.int32())), pa.array([[o for o, _ in r] for r in rows], pa.list_(pa.int64()))], ["sequence_id", "ids", "starts"])

    grouped = packed.groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "ids")).alias("pieces"))
    return grouped.mapInArrow(joined, kind)
