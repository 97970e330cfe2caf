"""Codes for vectors: each of a vector's parts is named by the nearest entry of its position's codebook.

Codebooks come from Lloyd rounds that skip by Yinyang bounds. The entries of a codebook are clustered into groups once;
for each part of each vector one lower bound a group is kept, on its distance to the group's entries but the assigned
one. When entries move, a group's bound falls by the largest move in the group, and a group is scanned only if its
bound no longer lies above the distance to the assigned entry. Components are integers, and so are bounds: lower bounds
are rounded down and moves up, a group is passed over only if the square of its bound is strictly larger than the exact
squared distance, and whatever is scanned is compared by exact squared distance and then by index. So the result is
that of plain Lloyd rounds, ties included.

Rows without a vector, or with null or non-finite components, are dropped. A vector's length must be that of most
vectors (of equal counts the larger) and a multiple of the parts; others can't be coded and are dropped too. The first
codebooks are the vectors of the smallest ids (of one id's rows the smaller vector first; null ids never); with fewer
vectors there are fewer entries. Rows that repeat are coded each. An empty table gives an empty result. If components lie
beyond +-2^29 / sqrt(part length) once scaled, Python's integers take over in the parts that hold them, so that finite
components of any size are exact; only an error that no long holds raises.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, cut

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries to a group, as the method's authors advise.
GROUP = 10
#: Rows whose distances are held at once.
BLOCK = 8192
#: Bits of the pieces in which sums of large components leave a task.
PIECE = 32
#: A label with one row in so many at least is joined apart from the others: there are so many such labels at most.
HOT_LABELS = 200


def isqrt(squares: np.ndarray) -> np.ndarray:
    """The integer square roots, rounded down."""
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    root -= root * root > squares
    return root + ((root + 1) * (root + 1) <= squares)


def roots(squares: np.ndarray) -> np.ndarray:
    """isqrt() of squares of any size, of those beyond 2^62 a smaller value."""
    return isqrt(np.minimum(squares, 1 << 62).astype(np.int64))


def bound(width: int) -> float:
    """Distances of parts of so many components, all nearer to 0 than this, are exact in 64 bits."""
    return 2**29 / width**0.5


def narrow(x: np.ndarray) -> np.ndarray:
    """x in 64 bits if its distances are exact in them, else as it is."""
    return x.astype(np.int64) if not x.size or np.abs(x).max() < bound(x.shape[-1]) else x


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows x to all entries."""
    if x.dtype == object or entries.dtype == object:
        return _any_distances(x, entries)
    out = np.zeros((len(x), len(entries)), np.int64)
    for j in range(x.shape[1]):
        away = x[:, j, None] - entries[None, :, j]
        out += away * away
    return out


def _any_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """distances() of integers of any size; small rows and small entries meet in 64 bits."""
    out = np.empty((len(x), len(entries)), object)
    large = [(np.abs(v) >= bound(x.shape[1])).any(axis=1) for v in (x, entries)]
    for far in (False, True):
        for off in (False, True):
            rows, these = np.flatnonzero(large[0] == far), np.flatnonzero(large[1] == off)
            kind = object if far or off else np.int64
            a, b = x[rows].astype(kind), entries[these].astype(kind)
            part = np.zeros((len(a), len(b)), kind)
            for j in range(x.shape[1]):
                away = a[:, j, None] - b[None, :, j]
                part += away * away
            out[np.ix_(rows, these)] = part
    return out


def grouped(entries: np.ndarray, size: int = GROUP) -> np.ndarray:
    """The group of each entry: a few Lloyd rounds over the entries from far-apart ones."""
    if entries.dtype == object:  # which groups they are hangs on their proportions alone
        entries = (entries // max(1, int(np.abs(entries).max()) >> 24)).astype(np.int64)
    seeds = [0]
    while len(seeds) < -(-len(entries) // size):
        seeds.append(int(distances(entries, entries[seeds]).min(1).argmax()))
    centres = entries[seeds].astype(np.float64)
    for _ in range(5):
        group = ((entries[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        for g in np.unique(group):
            centres[g] = entries[group == g].mean(0)
    return np.unique(group, return_inverse=True)[1]


class Position:
    """The codebook of one part position, its groups, and how far groups have moved since the last round."""

    def __init__(self, entries: np.ndarray, group: np.ndarray, before: np.ndarray | None = None):
        self.entries, self.group = entries, group
        self.members = [np.flatnonzero(group == g) for g in range(group.max() + 1)]
        moved = np.zeros(len(entries), np.int64)
        if before is not None:
            square = ((entries - before) ** 2).sum(1)
            root = isqrt(square) if square.dtype != object else np.array([math.isqrt(v) for v in square], object)
            moved = root + (root * root < square)
        self.moved = np.array([moved[m].max() for m in self.members])

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry, squared distance, bounds of groups), all entries scanned."""
        d = distances(x, self.entries)
        code = d.argmin(1)
        least = d[np.arange(len(x)), code]
        d[np.arange(len(x)), code] = np.iinfo(np.int64).max
        bounds = np.stack([d[:, m].min(1) for m in self.members], 1)
        return code, least, np.minimum(roots(bounds), np.iinfo(np.int32).max)

    def reassign(self, x: np.ndarray, code: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same from the last round's codes and bounds; also how many distances were computed."""
        away = x - self.entries[code]
        own = (away * away).sum(1)
        bounds = np.maximum(bounds - self.moved, 0).astype(np.int64)
        before, code, least, work = code, code.copy(), own.copy(), len(x)
        fails = bounds * bounds <= own[:, None]
        for g, members in enumerate(self.members):
            rows = np.flatnonzero(fails[:, g])
            if not len(rows):
                continue
            d = distances(x[rows], self.entries[members])
            work += d.size
            at = d.argmin(1)
            near, index = d[np.arange(len(rows)), at], members[at]
            better = (near < least[rows]) | ((near == least[rows]) & (index < code[rows]))
            # the bound leaves out the entry assigned so far, which is put back below if the row leaves it
            d[members[None, :] == before[rows, None]] = np.iinfo(np.int64).max
            bounds[rows, g] = roots(d.min(1))
            least[rows[better]], code[rows[better]] = near[better], index[better]
        left = np.flatnonzero(code != before)
        if len(left):
            g = self.group[before[left]]
            bounds[left, g] = np.minimum(bounds[left, g], roots(own[left]))
        for g, members in enumerate(self.members):
            rows = left[self.group[code[left]] == g]
            d = distances(x[rows], self.entries[members])
            work += d.size
            d[members[None, :] == code[rows, None]] = np.iinfo(np.int64).max
            bounds[rows, g] = roots(d.min(1))
        return code, least, np.minimum(bounds, np.iinfo(np.int32).max), work


def usable(vector: Column) -> Column:
    """A vector without null or non-finite components; never null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def integers(column: pa.Array, dims: int, parts: int, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors, (rows, parts, length of a part), in 64 bits if they suffice for distances."""
    return scaled(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), parts, dims // parts), scale)


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.floor(x * scale)
    if not out.size or np.abs(out).max() < bound(x.shape[-1]):
        return out.astype(np.int64)
    # a double from 2^53 on is an integer itself
    whole = [int(v) * scale if abs(v) >= 2**53 else math.floor(v * scale) for v in x.ravel().tolist()]
    return np.array(whole, object).reshape(x.shape)


def _matrix(column: pa.Array, dtype: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), *shape)


def _rows(matrix: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(matrix.reshape(len(matrix), -1))
    return pa.array([row.tobytes() for row in data], pa.binary())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


class Layout:
    """How the state holds integers: as they are in 4 bytes or, if some are large, as the doubles that they come from."""

    def __init__(self, dims: int, parts: int, scale: int, large: bool):
        self.dims, self.parts, self.scale, self.large = dims, parts, scale, large

    def begun(self, vectors: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The integers of vectors, and what the state holds of them."""
        x = integers(vectors, self.dims, self.parts, self.scale)
        return x, _rows(vectors.flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(vectors), -1) if self.large else x.astype("<i4"))

    def read(self, held: pa.Array) -> np.ndarray:
        shape = self.parts, self.dims // self.parts
        return scaled(_matrix(held, "<f8", *shape), self.scale) if self.large else _matrix(held, "<i4", *shape).astype(np.int64)


def train(vectors: DataFrame, layout: Layout, entries: int, rounds: int, tables: Tables) -> tuple[list[np.ndarray], Callable, DataFrame]:
    """(codebooks, a function that gives codes by them from the state, rows with the state of the last round).

    vectors has id, label, vector. The state of a row is its integers, codes and bounds; a round reads it, writes the
    next, and sums the parts of each entry.
    """
    first = vectors.where(F.col("id").isNotNull()).orderBy("id", "vector").limit(entries).select("vector").collect()
    seed = integers(pa.array([r[0] for r in first], pa.list_(pa.float64())), layout.dims, layout.parts, layout.scale)
    books = [narrow(np.ascontiguousarray(seed[:, p])) for p in range(layout.parts)]
    groups = [grouped(b) for b in books]
    kind = T.StructType([vectors.schema["id"], vectors.schema["label"]] + [T.StructField(n, T.BinaryType()) for n in ("x", "code", "bounds")])

    def begin(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
        positions = [Position(b, g) for b, g in zip(books, groups)]
        for batch in _blocks(batches):
            x, held = layout.begun(batch["vector"])
            yield _state(batch["id"], batch["label"], held, [p.assign(narrow(x[:, k])) for k, p in enumerate(positions)])

    state = tables.put("state", vectors.mapInArrow(begin, kind))
    for k in range(rounds):
        before, books = books, moved(state, books, layout)
        again = partial(_again, [Position(b, g, a) for b, g, a in zip(books, groups, before)], layout)
        if k < rounds - 1:
            state = tables.put("state", state.mapInArrow(_stepper(again), kind))
    return books, again, state


def _state(ids: pa.Array, labels: pa.Array, held: pa.Array, found: list) -> pa.RecordBatch:
    codes, bounds = np.stack([f[0] for f in found], 1).astype(np.uint8), np.concatenate([f[2] for f in found], 1).astype("<i4")
    return pa.RecordBatch.from_arrays([ids, labels, held, _rows(codes), _rows(bounds)], ["id", "label", "x", "code", "bounds"])


def _again(positions: list[Position], layout: Layout, batch: pa.RecordBatch) -> list:
    x = layout.read(batch["x"])
    codes = _matrix(batch["code"], "u1", layout.parts).astype(np.int64)
    ends = np.cumsum([0] + [len(p.members) for p in positions])
    bounds = _matrix(batch["bounds"], "<i4", int(ends[-1])).astype(np.int64)
    return [p.reassign(narrow(x[:, k]), codes[:, k], bounds[:, ends[k] : ends[k + 1]]) for k, p in enumerate(positions)]


def _stepper(again: Callable) -> Callable:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            yield _state(batch["id"], batch["label"], batch["x"], again(batch))

    return step


def _coder(again: Callable) -> Callable:
    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            found = again(batch)
            codes, error = np.stack([f[0] for f in found], 1).astype(np.uint8), sum(f[1].astype(object) for f in found).tolist()
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    return final


def moved(state: DataFrame, books: list[np.ndarray], layout: Layout) -> list[np.ndarray]:
    """Each entry replaced by the componentwise floor of its parts' mean. Tasks sum what they read; the driver gets a row
    for each component of a codebook, or a few if components are large."""
    entries, length, parts = len(books[0]), layout.dims // layout.parts, layout.parts

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, length), object if layout.large else np.int64), np.zeros((parts, entries), np.int64)
        for batch in _blocks(batches):
            x, codes = layout.read(batch["x"]), _matrix(batch["code"], "u1", parts)
            for p in range(parts):
                np.add.at(total[p], codes[:, p], x[:, p])
                count[p] += np.bincount(codes[:, p], minlength=entries)
        at, n, piece, rest = np.indices(total.shape).reshape(3, -1), np.repeat(count.ravel(), length), 0, total.ravel()
        while rest.dtype == object and np.abs(rest).max() >> PIECE:
            yield _sums(at, piece, rest & ((1 << PIECE) - 1), n)
            rest, piece = rest >> PIECE, piece + 1
        yield _sums(at, piece, rest, n)

    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("total", "n")]
    found = state.select("x", "code").mapInArrow(sums, "part long, entry long, position long, piece long, total long, n long")
    whole: dict[tuple[int, int, int], int] = {}
    n: dict[tuple[int, int, int], int] = {}
    for r in found.groupBy("part", "entry", "position", "piece").agg(*exact).where("n > 0").collect():
        at = r.part, r.entry, r.position
        whole[at] = whole.get(at, 0) + (int(r.total) << PIECE * r.piece)
        n[at] = max(n.get(at, 0), int(r.n))  # every task sends the first piece
    books = [b.astype(object) for b in books]
    for at, total in whole.items():
        books[at[0]][at[1:]] = total // n[at]
    return [narrow(b) for b in books]


def _sums(at: np.ndarray, piece: int, total: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    columns = [*map(pa.array, at), pa.array([piece] * len(n)), pa.array(total.tolist(), pa.int64()), pa.array(n)]
    return pa.RecordBatch.from_arrays(columns, ["part", "entry", "position", "piece", "total", "n"])


def fingerprint(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the sum of error over rows of the same label, null being one. Labels of many rows are few
    by their definition and are broadcast; the others are joined by an equi-join."""
    key = [F.col("label").isNull().alias("none"), F.col("label").alias("of")]
    totals = cut(coded.groupBy(*key).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"), F.count("*").alias("n")))
    rows = totals.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(totals.where(F.col("n") * HOT_LABELS >= rows))
    same = F.col("label").eqNullSafe(F.col("of"))
    many = coded.join(hot, same).drop("none", "of", "n")
    few = coded.join(hot, same, "left_anti").join(totals.where(F.col("n") * HOT_LABELS < rows), same).drop("none", "of", "n")
    return many.unionByName(few)


def encode(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every vector that can be coded; see the module."""
    if not 0 < entries <= 256 or rounds < 1:
        raise ValueError("1 to 256 entries, whose index fits a byte, and a round at least")
    given = embeddings.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    peak = F.max(F.array_max(F.transform("vector", F.abs))).alias("peak")
    lengths = given.groupBy(F.size("vector").alias("n")).agg(F.count("id").alias("count"), peak).where((F.col("n") > 0) & (F.col("n") % parts == 0) & (F.col("count") > 0))
    most = lengths.orderBy(F.desc("count"), F.desc("n")).first()
    if most is None:
        coded, sha = given.limit(0).select("id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), ""
    else:
        tables = Tables(embeddings.sparkSession)
        try:
            layout = Layout(most.n, parts, scale, not most.peak * scale + 1 < bound(most.n // parts))
            books, again, state = train(given.where(F.size("vector") == most.n), layout, entries, rounds, tables)
            kind = T.StructType([given.schema["id"], given.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
            coded, sha = with_label_errors(cut(state.mapInArrow(_coder(again), kind))), fingerprint(books)
        finally:
            tables.clear()
    return coded.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
