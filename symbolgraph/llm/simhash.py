"""SimHash near-duplicate detection by pigeonhole blocks.

A 64-bit fingerprint has 4 blocks of 16 bits. Two fingerprints that differ in 2 bits or fewer agree in at
least 2 blocks, so each is filed under its 6 pairs of blocks; fingerprints filed under one key are joined
and their Hamming distance is verified. Only distinct fingerprints take part: exact copies cost nothing.

A key under which more than `hot` fingerprints are filed is not joined with itself. Its fingerprints are
filed again, exactly, under every value within 1 bit of them (65 each): two fingerprints within 2 bits have
such a value in common, no value has more than 65 of them, and all of those lie within 2 bits of each other.

Defined results: a null text counts as a text without words; a text without words has fingerprint zero and
links like any other; rows with equal doc_id keep one row each, judged by their own texts; a null doc_id is never a component's id
unless the component has no other; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, connected_components, cut, tasks, utf8

SEED = 42
MAX_BITS = 2
#: A key of more distinct fingerprints than this is searched through the values within one bit instead; both ways are exact.
HOT = 64
#: Keys of more fingerprints than HEAVY are broadcast, so that no task gets all of one, if they are MOST_HEAVY at most.
HEAVY, MOST_HEAVY = 10_000, 100_000
#: Likewise fingerprints of more rows than this.
COPIES = 1000
_PAIRS = [(i, j) for i in range(4) for j in range(i)]


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The fingerprint of one text, unsigned."""
    words = (text or b"").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return digest(joined, SEED)
    count = n - width + 1
    counts = np.zeros(64, np.int64)
    starts, ends = starts[:count].tolist(), ends[width - 1 :].tolist()
    for at in range(0, count, 65536):  # bounded memory for texts of any length
        h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[at : at + 65536], ends[at : at + 65536])), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > count, bitorder="little").tobytes(), "little")


def fingerprint_column(text: Column | str, width: int = 3) -> Column:
    """Fingerprints as signed longs."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        values = np.fromiter((fingerprint(t, width) for t in utf8(texts)), np.uint64, len(texts))
        return pa.array(values.view(np.int64))

    return of(text)


def links(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """All pairs (u, v), or pairs that connect the same fingerprints, of distinct fingerprints `fp` within 2 bits."""
    block = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF)
    keys = F.array(*(F.shiftleft(F.lit(n).cast("long"), 32).bitwiseOR(F.shiftleft(block(i), 16)).bitwiseOR(block(j)) for n, (i, j) in enumerate(_PAIRS)))
    filed = cut(nodes.select("fp", F.explode(keys).alias("k")))
    n = tasks(filed.count())
    filed = filed.coalesce(n)
    shared = cut(filed.groupBy("k").count().where("count > 1").coalesce(n))
    # Keys of very many fingerprints are few, as the fingerprints are distinct: they are met where the rows are.
    heavy = shared.where(F.col("count") > HEAVY)
    heavy = F.broadcast(heavy) if heavy.count() <= MOST_HEAVY else heavy
    filed = cut(filed.join(heavy, "k").unionByName(filed.join(heavy, "k", "left_anti").join(shared.where(F.col("count") <= HEAVY), "k")).coalesce(n))
    few = filed.where(F.col("count") <= hot)
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS
    pairs = few.select("k", F.col("fp").alias("u")).join(few.select("k", F.col("fp").alias("v")), "k").where("u < v").where(close).select("u", "v").coalesce(n)
    many = filed.where(F.col("count") > hot).select("fp").distinct().coalesce(n)
    around = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))))
    balls = many.select("fp", F.explode(around).alias("k")).groupBy("k").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).coalesce(n)
    stars = balls.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u <> v")
    return pairs.unionByName(stars).distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, hot: int) -> DataFrame:
    """(id, fp, component, root): of each row, its fingerprint, its component's smallest id, and its group's own key."""
    prints = cut(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), width).alias("fp")))
    n = tasks(prints.count())
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("rows")).coalesce(n))
    roots = cut(connected_components(links(nodes.select("fp"), hot)).select(F.col("node").alias("fp"), "root").coalesce(n))
    groups = roots.join(nodes, "fp").groupBy("root").agg(F.min("least").alias("group_least"))
    of = nodes.join(roots, "fp", "left").join(groups, "root", "left").select("fp", "rows", F.coalesce("group_least", "least").alias("component"), F.coalesce("root", "fp").alias("root"))
    of = cut(of.coalesce(n))
    # Fingerprints of many copies are few; their rows are met where they are, so that no task gets all copies of one text.
    many = of.where(F.col("rows") > COPIES).drop("rows")
    if many.isEmpty() or many.count() > MOST_HEAVY:
        return prints.join(of.drop("rows"), "fp").coalesce(n)
    rest = prints.join(F.broadcast(many.select("fp")), "fp", "left_anti").join(of.where(F.col("rows") <= COPIES).drop("rows"), "fp")
    return prints.join(F.broadcast(many), "fp").unionByName(rest.coalesce(n))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, hot: int = HOT) -> DataFrame:
    """(id, fingerprint, component_id): one row for each row of docs."""
    return _grouped(docs, id_col, text_col, width, hot).select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, hot: int = HOT) -> DataFrame:
    """docs with one row of each group: one of those of the smallest id. Rows without an id stay. Of rows that share an id each
    is judged in the group of its own text."""
    found = cut(_grouped(docs, id_col, text_col, width, hot).where("id is not null").groupBy("id", "fp").agg(F.count("*").alias("rows"), F.first("component").alias("component"), F.first("root").alias("root")))
    by_id = found.groupBy("id").agg(F.sum("rows").alias("rows"), F.min("component").alias("component"))
    repeated = cut(by_id.where("rows > 1").select("id"))
    losers = by_id.where("rows = 1 and id <> component").select("id")
    rows = boxed(docs, id=F.col(id_col), text=F.col(text_col))
    single = rows.join(losers.unionByName(repeated).hint("shuffle_hash"), "id", "left_anti").select("row")
    if repeated.isEmpty():
        return single.select("row.*")
    # A row of an id that several rows have is known by id and fingerprint.
    winners = found.join(repeated, "id").where("id = component").select("id", "fp", "root")
    again = rows.join(repeated, "id", "left_semi").withColumn("fp", fingerprint_column(F.col("text"), width)).join(winners, ["id", "fp"])
    again = again.groupBy("id", "root").agg(F.first("row").alias("row")).select("row")
    return single.unionByName(again).select("row.*")
