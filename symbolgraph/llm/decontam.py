"""Benchmark decontamination by the CGK random-walk embedding and bit-sampling LSH.

The CGK embedding of a string walks along it: at step j it emits the character it stands on and moves one
character on or stays, as a random bit for (j, character) says. Walks that meet at one step stay together, so a
few edits change few places of the embedding. A repetition of the LSH has its own walk and samples places of
it; a window of an item and one of a document, which begin at word starts and anywhere in long runs without space,
collide when all sampled places agree. An item and a place of a document where so many windows collide, over all
repetitions, as `TARGET` of its copies would show, are a candidate. That number, by the item's length, and the number
of repetitions are measured on the items: copies are made with as many edits as the similarity allows, at random and
evenly spread, and repetitions are added until the share `TARGET` of the copies of each length shows `HITS`
collisions. Candidates are verified by exact edit distance: the least distance of the item to any part of the text
around the candidate (Myers' bit-parallel recurrence).

Items go to the tasks in blocks of about `BLOCK_BYTES` of text, one after the other: the driver and a task hold one
block's index at a time, however many items there are, and each block is one pass over the rows. Texts and items are compared with A-Z folded and white
space made one space. An item with fewer than `SHORT` characters is searched for by exact pieces instead: of one piece
more than the edits allowed, one is there unchanged; where no edit is allowed, it must be there at word bounds.

Defined results: null and empty texts and items match nothing; items with equal text each match; repeated rows
are each judged; an empty table, or no items, gives no match; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, utf8

SIMILARITY = 0.8
SHORT = 40
BLOCK_BYTES = 2 << 20
#: The share of copies with the most edits allowed that is to be found, of each length; collisions that these show at
#: least, or else `MOST` repetitions are used; copies that are made of each length (from one to the next, 1.4 times).
TARGET, HITS, MOST, COPIES = 0.98, 3, 48, 200
#: Steps of a walk for each place that is sampled; from where in a run without space windows begin anywhere.
STEPS, RUN = 3, 16
#: Collisions that are held at once, unless one text has more. Below: bytes of text that are verified, and searched, at once.
HELD = 8_000_000
SEED = 11
PIECE, CACHED = 1 << 22, 1 << 17
_BITS = 20
GRAM = 3
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normal(text: bytes | None) -> bytes:
    return b" ".join((text or b"").lower().split())


class Walk:
    """One repetition: its random bits and sampled places."""

    def __init__(self, places: int, seed: int):
        rng = np.random.default_rng((SEED, seed))
        steps = STEPS * places
        self.bits = rng.integers(0, 2, (steps, 256)).astype(np.intp)
        self.places = {int(x) for x in rng.choice(steps, places, replace=False)}
        self.steps = max(self.places) + 1

    def go(self, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Walk from `at`; returns where the walks stand at their last place and the keys of what was sampled."""
        key = np.zeros(len(at), np.uint64)
        for j in range(self.steps):
            c = text.take(at)
            if j in self.places:
                key = (key + c.astype(np.uint64) + np.uint64(1)) * _MIX
            if j < self.steps - 1:
                at = at + self.bits[j].take(c)
        return at, key


def window_starts(text: np.ndarray) -> np.ndarray:
    """Where a character other than a space or the gap between texts follows one of these, or is far into a run of others."""
    gap = (text == 32) | (text == 0)
    place = np.arange(len(text))
    far = place - np.maximum.accumulate(np.where(gap, place, -1))
    return np.flatnonzero((far == 1) | (far > RUN))


def edited(text: str, edits: int, even: bool, rng: np.random.Generator) -> str:
    """text after so many substitutions, deletions and insertions, evenly spread or anywhere."""
    n = len(text)
    at = (np.arange(edits) * n // max(1, edits) + rng.integers(max(1, n // max(1, edits)))) % n if even else rng.choice(n, edits, replace=False)
    out = list(text)
    for i, kind, other in zip(at.tolist(), rng.integers(0, 3, edits).tolist(), rng.integers(0, n, edits).tolist()):
        out[i] = ("", text[other], text[other] + text[i])[kind]
    return "".join(out)


def _grams(text: bytes) -> np.ndarray:
    """Hashed byte trigrams."""
    a = np.frombuffer(text, np.uint8).astype(np.int64)
    return (a[:-2] * 2357 + a[1:-1] * 313 + a[2:] * 41) & 0xFFF if len(a) >= GRAM else np.empty(0, np.int64)


def _slot(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - _BITS)).astype(np.intp)


class Index:
    """The windows of a block of items, by the keys of each repetition."""

    def __init__(self, items: list[tuple[int, bytes]], similarity: float = SIMILARITY):
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.words = [t.decode("utf-8", "replace") for t in self.texts]
        self.size = np.array([len(t) for t in self.texts], np.intp)
        self.grain = np.maximum(1, np.ceil((1 - similarity) * self.size).astype(np.intp))
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.short = [k for k, t in enumerate(self.words) if 0 < len(t) < SHORT]
        self.walks, self.seen, self.keys, self.owners, self.offsets = [], [], [], [], []
        self.least = np.ones(len(items), np.intp)
        long = [k for k, t in enumerate(self.words) if len(t) >= SHORT]
        if not long:
            return
        joined = np.frombuffer(b"\0".join(self.texts[k] for k in long), np.uint8)
        starts = window_starts(joined)
        places = max(6, math.ceil(math.log(len(starts), 8) + 3.5))  # more windows, more places: chance collisions stay as rare
        joined = np.concatenate((joined, np.zeros(STEPS * places + 1, np.uint8)))
        ends = np.cumsum([len(self.texts[k]) + 1 for k in long]) - 1
        begins = ends - [len(self.texts[k]) for k in long]
        of = np.searchsorted(ends, starts)

        # Copies with the most edits allowed, of items of each length.
        rng = np.random.default_rng(SEED)
        kinds: dict[int, list[int]] = {}
        for k in long:
            kinds.setdefault(round(2 * math.log2(len(self.words[k]))), []).append(k)
        owners = [(kind, ks[int(x)]) for kind, ks in sorted(kinds.items()) for x in np.arange(COPIES) * len(ks) // COPIES]
        copies = [edited(self.words[k], math.floor((1 - similarity) * len(self.words[k]) + 1e-9), i % 2 == 0, rng).encode() for i, (_, k) in enumerate(owners)]
        before = np.array([k for _, k in owners])
        found = np.zeros((len(copies), 0), bool)
        for seed in range(MOST):
            walk = Walk(places, seed)
            at, key = walk.go(joined, starts)
            inside = at <= ends[of]  # a walk that leaves the item has seen what isn't the item's
            order = np.argsort(key[inside], kind="stable")
            slots = np.zeros(1 << _BITS, bool)
            slots[_slot(key[inside])] = True
            self.walks.append(walk)
            self.seen.append(slots)
            self.keys.append(key[inside][order])
            self.owners.append(np.array(long, np.intp)[of[inside][order]])
            self.offsets.append((starts - begins[of])[inside][order])
            if (seed + 1) % 4:
                continue
            counts = self.shown(copies, before)
            least = {kind: int(np.quantile([c for (x, _), c in zip(owners, counts) if x == kind], 1 - TARGET, method="lower")) for kind in kinds}
            if min(least.values()) >= HITS:
                break
        for kind, ks in kinds.items():
            self.least[ks] = max(1, least[kind])

    def shown(self, copies: list[bytes], of: np.ndarray) -> np.ndarray:
        """Of each copy of an item, the most windows that collide with the item at one place."""
        item, doc, _, count = self.cells(copies, False)
        out = np.zeros(len(copies), np.intp)
        own = item == of[doc]
        np.maximum.at(out, doc[own], count[own])
        return out

    def collisions(self, text: np.ndarray, starts: np.ndarray, walk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window of text, first and last of the item windows with its key) of a repetition."""
        _, key = self.walks[walk].go(text, starts)
        on = np.flatnonzero(self.seen[walk][_slot(key)])
        low, high = np.searchsorted(self.keys[walk], key[on], "left"), np.searchsorted(self.keys[walk], key[on], "right")
        some = high > low
        return on[some], low[some], high[some]

    def cells(self, texts: list[bytes], enough: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(item, text, where the item would begin in all texts joined, windows that collide), enough of them or any; places
        are cells of twice the item's grain that overlap by half."""
        joined = np.frombuffer(b"\0".join(texts) + bytes(1 + max((w.steps for w in self.walks), default=0)), np.uint8)
        starts = window_starts(np.concatenate((np.zeros(1, np.uint8), joined))) - 1
        ends = np.cumsum([len(t) + 1 for t in texts])
        none = np.empty(0, np.intp)
        found = [self.collisions(joined, starts, r) for r in range(len(self.walks))]
        total = sum(int((high - low).sum()) for _, low, high in found)
        if total > HELD and len(texts) > 1:  # in halves
            half = len(texts) // 2
            a, b = self.cells(texts[:half], enough), self.cells(texts[half:], enough)
            return np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1] + half)), np.concatenate((a[2], b[2] + ends[half - 1])), np.concatenate((a[3], b[3]))
        if not total:
            return none, none, none, none
        items, windows, begins = [], [], []
        for (on, low, high), owners, offsets in zip(found, self.owners, self.offsets):
            n = high - low
            hit = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            items.append(owners[hit])
            windows.append(np.repeat(on, n))
            begins.append(starts[windows[-1]] - offsets[hit])
        item, window, begin = np.concatenate(items), np.concatenate(windows), np.concatenate(begins)
        # Cell c of an item holds what begins less than a grain from c x grain - size; numbered over all items.
        across = np.maximum(0, (begin + self.size[item]) // self.grain[item])
        wide = int(across.max()) + 2
        cell = np.concatenate((item * wide + across, item * wide + across + 1))
        window = np.concatenate((window, window))
        if (len(self.ids) + 1) * wide * len(starts) < 1 << 62:
            both = cell * len(starts) + window
            both.sort()
            both = both[np.append(True, both[1:] != both[:-1])]
            cell, window = np.divmod(both, len(starts))
        else:
            order = np.lexsort((window, cell))
            cell, window = cell[order], window[order]
            new = np.append(True, (cell[1:] != cell[:-1]) | (window[1:] != window[:-1]))
            cell, window = cell[new], window[new]
        doc = np.searchsorted(ends, starts[window], "right")
        first = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (doc[1:] != doc[:-1])))
        count = np.diff(np.append(first, len(cell)))
        item, doc, across = cell[first] // wide, doc[first], cell[first] % wide
        if enough:
            keep = count >= self.least[item]
            item, doc, across, count = item[keep], doc[keep], across[keep], count[keep]
        return item, doc, across * self.grain[item] - self.size[item], count

    def may_hold(self, item: int, near: bytes, similarity: float) -> bool:
        """False only where near lacks more of the item's grams than edits within the similarity could destroy: one edit of
        a character of w bytes changes w + GRAM - 1 of them at most."""
        text, words = self.texts[item], self.words[item]
        if item not in self.grams:
            self.grams[item] = np.unique(_grams(text), return_counts=True)
        found, n = self.grams[item]
        wide = 1 if len(text) == len(words) else max(len(c.encode()) for c in set(words))
        edits = math.floor((1 - similarity) * len(words) + 1e-9)
        shared = int(np.minimum(np.bincount(_grams(near), minlength=1 << 12)[found], n).sum())
        return shared >= len(text) - GRAM + 1 - edits * (wide + GRAM - 1)

    def short_edits(self, item: int, text: bytes, similarity: float) -> int | None:
        """The least edits of a short item in text, if its similarity allows them. Of one piece more than these edits, one is
        in the text as it is; only what is around such pieces is verified, so that nothing is missed."""
        words = self.words[item]
        edits = math.floor((1 - similarity) * len(words) + 1e-9)
        if not edits:
            return 0 if b" " + self.texts[item] + b" " in b" " + text + b" " else None
        if self.texts[item] in text:
            return 0
        slack, best = edits * max(len(c.encode()) for c in words) + 4, None
        bounds = [len(words) * i // (edits + 1) for i in range(edits + 2)]
        near: list[list[int]] = []  # parts of the text to verify
        for a, b in zip(bounds[:-1], bounds[1:]):
            piece, ahead = words[a:b].encode(), len(words[:a].encode())
            at = text.find(piece)
            while at >= 0:
                near.append([max(0, at - ahead - slack), at - ahead + len(self.texts[item]) + slack])
                at = text.find(piece, at + 1)
        for low, high in sorted(near):
            found = least_edits(words, text[low:high].decode("utf-8", "ignore"))
            if found <= (edits if best is None else best - 1):
                best = found
        return best

    def find(self, texts: list[bytes], similarity: float) -> list[list[tuple[int, int, float]]]:
        """Of each text, (item id, edits, similarity) of the items that it holds."""
        out: list[dict[int, int]] = [{} for _ in texts]
        ends = np.cumsum([len(t) + 1 for t in texts])  # where the gap after a text ends
        found, part, size, of = [], [], 0, 0
        for k, text in enumerate(texts):  # parts that the processor's cache holds
            part.append(text)
            size += len(text) + 1
            if size >= CACHED or k == len(texts) - 1:
                item, doc, begin, _ = self.cells(part)
                shift = int(ends[of - 1]) if of else 0
                found.append((item, doc + of, begin + shift))
                part, size, of = [], 0, k + 1
        item, doc, begin = (np.concatenate(x) for x in zip(*found)) if found else [np.empty(0, np.intp)] * 3
        order = np.lexsort((begin, doc, item))
        pairs: list[list[int]] = []  # item, text, first and last begin of cells side by side
        for i, d, b in zip(item[order].tolist(), doc[order].tolist(), begin[order].tolist()):
            last = pairs[-1] if pairs else None
            if last and last[:2] == [i, d] and b - last[3] <= self.grain[i] and b - last[2] <= self.size[i]:
                last[3] = b
            else:
                pairs.append([i, d, b, b])
        todo: list[tuple[int, int, str]] = []
        for i, d, low, high in pairs:
            if out[d].get(i) == 0:
                continue
            n, first = int(self.size[i]), int(ends[d]) - len(texts[d]) - 1
            slack = int((1 - similarity) * n) + 2 + int(self.grain[i])
            near = texts[d][max(0, low - first - slack) : max(0, high - first + n + slack)]
            if self.texts[i] in near:
                out[d][i] = 0
            elif self.may_hold(i, near, similarity):
                todo.append((i, d, near.decode("utf-8", "ignore")))
        for (i, d, _), edits in zip(todo, least_edits_of([(self.words[i], near) for i, _, near in todo])):
            if edits <= min(math.floor((1 - similarity) * len(self.words[i]) + 1e-9), out[d].get(i, edits)):
                out[d][i] = edits
        for item in self.short:
            for d, text in enumerate(texts):
                edits = self.short_edits(item, text, similarity)
                if edits is not None:
                    out[d][item] = edits
        return [sorted((self.ids[k], e, 1 - e / len(self.words[k])) for k, e in found.items()) for found in out]


def least_edits(item: str, text: str) -> int:
    """The least edit distance of item to any part of text."""
    n = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best = n
    for c in text:
        eq = masks.get(c, 0)
        across = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(across | plus) & full, plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        down_or = across
        plus = down | ~(down_or | up) & full
        minus = up & down_or
        if score < best:
            best = score
    return best


def least_edits_of(pairs: list[tuple[str, str]]) -> list[int]:
    """`least_edits` of each pair, many at once: the same recurrence on words of 64 characters (Hyyrö's blocks)."""
    out = [0] * len(pairs)
    groups: dict[int, list[int]] = {}
    for k, (item, text) in enumerate(pairs):
        groups.setdefault(-(-len(item) // 64), []).append(k)
    one = np.uint64(1)
    for wide, members in groups.items():
        members.sort(key=lambda k: len(pairs[k][1]))
        for first in range(0, len(members), 512):
            some = members[first : first + 512]
            if len(some) < 16:
                for k in some:
                    out[k] = least_edits(*pairs[k])
                continue
            rows, sizes = np.arange(len(some)), np.array([len(pairs[k][0]) for k in some])
            codes = {c: i + 1 for i, c in enumerate(sorted({c for k in some for c in pairs[k][0]}))}
            masks = np.zeros((len(codes) + 1, wide, len(some)), np.uint64)  # code 0: what no item has, and what follows a text
            text = np.zeros((max(len(pairs[k][1]) for k in some), len(some)), np.intp)
            for row, k in enumerate(some):
                at = np.fromiter((codes[c] for c in pairs[k][0]), np.intp, sizes[row])
                place = np.arange(sizes[row])
                np.bitwise_or.at(masks, (at, place // 64, row), one << (place % 64).astype(np.uint64))
                text[: len(pairs[k][1]), row] = [codes.get(c, 0) for c in pairs[k][1]]
            top = ((sizes - 1) % 64).astype(np.uint64)
            plus, minus = [np.full(len(some), ~np.uint64(0)) for _ in range(wide)], [np.zeros(len(some), np.uint64) for _ in range(wide)]
            score, best, high = sizes.copy(), sizes.copy(), np.uint64(63)
            for now in text:
                up_in = down_in = np.uint64(0)
                for w in range(wide):
                    eq, p, m = masks[now, w, rows], plus[w], minus[w]
                    down_or = eq | m
                    eq = eq | down_in
                    across = (((eq & p) + p) ^ p) | eq
                    up, down = m | ~(across | p), p & across
                    if w == wide - 1:
                        score += ((up >> top) & one).astype(np.intp) - ((down >> top) & one).astype(np.intp)
                    up_out, down_out = up >> high, down >> high
                    up, down = (up << one) | up_in, (down << one) | down_in
                    plus[w], minus[w] = down | ~(down_or | up), up & down_or
                    up_in, down_in = up_out, down_out
                np.minimum(best, score, out=best)
            for k, edits in zip(some, best.tolist()):
                out[k] = edits
    return out


def blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int, similarity: float = SIMILARITY) -> Iterator[tuple[Index, bool]]:
    """The items' indexes, one for each block of about block_bytes, and whether there are more blocks than one."""
    items = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, math.ceil(total / block_bytes))
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k).collect()  # a block
        yield Index(sorted({(r.id, normal(r.text.encode())) for r in rows}), similarity), count > 1


def found_column(text: Column | str, index: Index, similarity: float = SIMILARITY) -> Column:
    """array<struct<item_id, edits, similarity>> of the items of one block that a text holds."""

    @F.arrow_udf("array<struct<item_id:long,edits:int,similarity:double>>")
    def of(texts: pa.Array) -> pa.Array:
        found, part, size = [], [], 0
        for t in utf8(texts):
            part.append(normal(t))
            size += len(part[-1])
            if size >= PIECE:
                found += index.find(part, similarity)
                part, size = [], 0
        if part:
            found += index.find(part, similarity)
        struct = pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("similarity", pa.float64())])
        return pa.array([[dict(item_id=i, edits=e, similarity=s) for i, e, s in x] for x in found], pa.list_(struct))

    return of(text)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item, edits, similarity): one row for each row of docs and item that it holds."""
    every = None
    for index, several in blocks(items, item_col, text_col, block_bytes, similarity):
        found = docs.select(F.col(id_col).alias("id"), F.explode(found_column(F.col(text_col), index, similarity)).alias("x"))
        found = found.select(F.col("id").alias(id_col), F.col("x.item_id").alias(item_col), F.col("x.edits").alias("edits"), F.col("x.similarity").alias("similarity"))
        found = stored(found) if several else found
        every = found if every is None else every.unionByName(found)
    return every


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that hold an item."""
    for index, several in blocks(items, item_col, text_col, block_bytes, similarity):
        docs = docs.where(F.size(found_column(F.col(text_col), index, similarity)) == 0)
        docs = stored(docs) if several else docs
    return docs
