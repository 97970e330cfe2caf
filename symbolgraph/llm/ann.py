"""Approximate nearest neighbours under cosine: an NN-descent graph, searched greedily.

Vectors that are equal are one node that remembers its smallest ids, so copies cost nothing. The graph begins
with the nearest neighbours inside the leaves of a few random-projection trees, then improves by NN-descent: the
nodes that are neighbours of a node, and those that it is a neighbour of, meet at that node, and pairs of which at
least one is new there are offered to each other. A node goes to a meeting as its vector rounded to one byte a
component; what comes back are ids and similarities that beat the worst neighbour known. Groups are bounded by
DEGREE, REVERSE and LEAF, whatever the data.

A query starts at its own node, keeps the best nodes it has seen and expands the best of them that it has not yet
expanded, many at a time, until none of its `beam` best is left. The graph is stored in buckets with the neighbours'
vectors beside their ids: a step sends the query to the nodes that it expands, and only what beats its beam comes
back. The best of a beam are scored in double precision on the original vectors. `budget` ties beam and degree to the
number of nodes: in as many dimensions as nodes allow, more nodes need a wider search for the same recall.

Split points of the trees are fitted on at most `SAMPLE` nodes, every node is filed; leaves that come out large
are split further along random directions, by their own mean and spread.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components
take no part, as query or candidate; a row never finds itself, though it finds its copies; equal scores go to the
smaller id; fewer candidates than asked for are all that is returned; rows with equal ids and vectors count once;
a null id takes no part; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, bounded_share, cut, hash_share, tasks

REVERSE = 24
TREES = 4
LEAF = 1024
SAMPLE = 16_384
ROUNDS = 10
#: Descent ends when a round changes less than this share of all edges.
SETTLED = 0.05
OFFERS = 8
WIDTH = 96
RESCORED = 64
SEED = 6
_NO_FLOOR = -2.0


def budget(count: int) -> tuple[int, int]:
    """Degree of the graph and beam of a search over so many nodes."""
    grown = max(1.0, count / 10_000) ** 0.25
    return round(32 * grown**0.5), round(160 * grown)


def nodes_of(vectors: DataFrame, id_col: str, vec_col: str, copies: int, tables: Tables) -> DataFrame:
    """(node, vec, unit, ids) of each distinct vector: its smallest id, itself, itself rounded to bytes, its smallest ids."""
    kind = dict(vectors.dtypes)[vec_col]
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind if kind in ("array<float>", "array<double>") else "array<double>").alias("vec")).where("id is not null and vec is not null")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(finite & F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("vec") == (sizes[0].n if sizes else 0)).distinct()
    # Of the copies of a vector each task sends its few smallest ids only.
    rank = F.row_number().over(Window.partitionBy("h", "vec").orderBy("id"))
    first = rows.withColumn("h", F.xxhash64("vec")).withColumn("rank", rank).where(F.col("rank") <= copies).groupBy("h", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))

    @F.arrow_udf("binary")
    def unit(vecs: pa.Array) -> pa.Array:
        x = vecs.flatten().to_numpy(zero_copy_only=False).reshape(len(vecs), -1).astype(np.float64) if len(vecs) else np.empty((0, 1))
        x = np.round(x / np.abs(x).max(axis=1, keepdims=True) * 127).astype(np.int8)
        return pa.array([r.tobytes() for r in x], pa.binary())

    first = first.coalesce(tasks(sizes[0]["count"] if sizes else 0))
    return tables.put("nodes", first.select(F.get("ids", F.lit(0)).alias("node"), "vec", unit("vec").alias("unit"), "ids"))


def _matrix(units: pa.Array) -> np.ndarray:
    """The unit vectors of an Arrow column of rounded vectors, none null."""
    if isinstance(units, pa.ChunkedArray):
        units = units.combine_chunks()
    if not len(units):
        return np.empty((0, 1), np.float32)
    ends = np.frombuffer(units.buffers()[1], np.int32)[units.offset : units.offset + len(units) + 1]
    x = np.frombuffer(units.buffers()[2], np.int8)[ends[0] : ends[-1]].reshape(len(units), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _groups(batch: pa.RecordBatch):
    """The fields of each group of a column g of arrays of structs, as arrays; units as a matrix."""
    g = batch.column("g")
    flat = g.flatten()
    fields = {flat.type.field(i).name: flat.field(i) for i in range(flat.type.num_fields)}
    fields = {k: _matrix(v) if k == "unit" else v.to_numpy(zero_copy_only=False) for k, v in fields.items()}
    ends = np.concatenate(([0], np.cumsum(g.value_lengths().fill_null(0).to_numpy())))
    for low, high in zip(ends[:-1], ends[1:]):
        yield {k: v[low:high] for k, v in fields.items()}


class Tree:
    """A random-projection tree fitted on a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, least: int, seed: int):
        rng = np.random.default_rng((SEED, seed))
        self.planes, self.cuts, self.children = [], [], []
        self.root = self._grow(sample, least, rng)

    def _grow(self, x: np.ndarray, least: int, rng) -> int:
        if len(x) <= least:
            return -1
        a, b = x[rng.choice(len(x), 2, replace=False)]
        side = x @ (a - b)
        middle = float(np.median(side))
        right = side > middle
        if right.all() or not right.any():
            return -1
        k = len(self.planes)
        self.planes.append(a - b)
        self.cuts.append(middle)
        self.children.append([-1, -1])
        self.children[k] = [self._grow(x[~right], least, rng), self._grow(x[right], least, rng)]
        return k

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """A leaf number for each row."""
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)), 1)]
        while todo:
            k, rows, name = todo.pop()
            if k < 0:
                out[rows] = name
                continue
            right = x[rows] @ self.planes[k] > self.cuts[k]
            todo += [(self.children[k][0], rows[~right], 2 * name), (self.children[k][1], rows[right], 2 * name + 1)]
        return out


def _ranked(offers: DataFrame, degree: int) -> DataFrame:
    """(u, offered): of offers (u, v, s) the best `degree` of each u, best first. Each task sends no more than these, so
    that a node to which many are offered is no burden."""
    rank = F.dense_rank().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))
    once = offers.withColumn("rank", rank).where(F.col("rank") <= degree)
    return once.groupBy("u").agg(F.sort_array(F.collect_set(F.struct("s", "v")), asc=False).alias("offered"))


def _merged(kept: Column, offered: Column, degree: int) -> Column:
    """The best `degree` of neighbours kept (s, v, fresh), and of those offered that aren't among them."""
    known = F.transform(kept, lambda x: x["v"])
    old = F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["v"].alias("v"), F.lit(0).alias("fresh")))
    new = F.transform(F.filter(offered, lambda x: ~F.array_contains(known, x["v"])), lambda x: F.struct(x["s"].alias("s"), x["v"].alias("v"), F.lit(1).alias("fresh")))
    return F.slice(F.sort_array(F.concat(old, new), asc=False), 1, degree)


def _rounded(s: np.ndarray) -> np.ndarray:
    """Similarities in steps that hide in which order their terms were added."""
    return (np.round(s * 65536) / 65536).astype(np.float32)


def first_graph(nodes: DataFrame, count: int, degree: int, tables: Tables) -> DataFrame:
    """(u, unit, near): each node's neighbours (s, v, fresh), best first."""
    sample = nodes.where(hash_share("node", bounded_share(count, SAMPLE), SEED)).select("node", "unit").collect()  # about SAMPLE at most
    x = _matrix(pa.array([bytes(r.unit) for r in sorted(sample, key=lambda r: r.node)], pa.binary()))
    least = max(8, round(LEAF * min(1.0, len(x) / max(count, 1))))
    trees = [Tree(x, least, t) for t in range(TREES)]
    across = np.random.default_rng((SEED, TREES)).normal(size=x.shape[1])

    @F.arrow_udf("array<struct<leaf:long,at:double>>")
    def leaves(units: pa.Array) -> pa.Array:
        v = _matrix(units) if len(units) else np.empty((0, x.shape[1]), np.float32)
        at = (v @ across).tolist()
        of = np.stack([t.leaves(v) * TREES + i for i, t in enumerate(trees)], axis=1).tolist()
        return pa.array([[dict(leaf=leaf, at=a) for leaf in row] for row, a in zip(of, at)], pa.list_(pa.struct([("leaf", pa.int64()), ("at", pa.float64())])))

    filed = tables.put("filed", nodes.select("node", "unit", F.explode(leaves("unit")).alias("f")).select("node", "unit", "f.leaf", "f.at"))
    # A leaf that came out large is cut into parts of about LEAF along one more direction: at equal shares of a normal
    # distribution (its logistic likeness) of the leaf's mean and spread; a part that is still too large is dealt.
    sizes = filed.groupBy("leaf").agg(F.ceil(F.count("*") / (1.5 * LEAF)).alias("parts"), F.avg("at").alias("mean"), F.greatest(F.coalesce(F.stddev("at"), F.lit(0.0)), F.lit(1e-9)).alias("spread"))
    below = 1 / (1 + F.exp(-1.702 * (F.col("at") - F.col("mean")) / F.col("spread")))
    parted = filed.join(sizes, "leaf").select("node", "unit", "leaf", F.floor(below * F.col("parts")).alias("part"))
    dealt = parted.groupBy("leaf", "part").agg(F.ceil(F.count("*") / (3 * LEAF)).alias("deals"))
    groups = parted.join(dealt, ["leaf", "part"]).groupBy("leaf", "part", F.pmod(F.xxhash64("node"), "deals").alias("deal")).agg(F.collect_list(F.struct("node", "unit")).alias("g"))

    def pairs(batches):
        for batch in batches:
            for g in _groups(batch):
                ids, m = g["node"], g["unit"]
                k = min(degree, len(ids) - 1)
                for low in range(0, len(ids) if k > 0 else 0, 512):  # bounded memory
                    sims = m[low : low + 512] @ m.T
                    sims[np.arange(len(sims)), np.arange(low, low + len(sims))] = -9
                    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                    yield pa.record_batch({"u": np.repeat(ids[low : low + 512], k), "v": ids[top].ravel(), "s": _rounded(np.take_along_axis(sims, top, 1).ravel())})

    offers = groups.select("g").mapInArrow(pairs, "u long, v long, s float")
    own = nodes.select(F.col("node").alias("u"), "unit").join(_ranked(offers, degree), "u", "left")
    near = _merged(F.array().cast("array<struct<s:float,v:bigint,fresh:int>>"), F.coalesce("offered", F.array().cast("array<struct<s:float,v:bigint>>")), degree)
    return tables.put("graph", own.select("u", "unit", near.alias("near")).coalesce(tasks(count)))


def _meetings(graph: DataFrame, degree: int) -> DataFrame:
    """(at, ahead, back): the neighbours of each node, and the best `REVERSE` of those that it is a neighbour of, as structs
    (x, fresh, floor, unit)."""
    floor = F.when(F.size("near") >= degree, F.element_at("near", -1)["s"]).otherwise(F.lit(_NO_FLOOR)).cast("float")
    told = lambda: F.collect_list(F.struct("x", "fresh", "floor", "unit"))
    edges = graph.select(F.col("u").alias("x"), "unit", floor.alias("floor"), F.explode("near").alias("e"))
    rank = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("s"), "x"))
    back = edges.select(F.col("e.v").alias("at"), "x", F.col("e.fresh").alias("fresh"), F.col("e.s").alias("s"), "floor", "unit").withColumn("rank", rank).where(F.col("rank") <= REVERSE).groupBy("at").agg(told().alias("back"))
    asked = graph.select(F.col("u").alias("at"), F.explode("near").alias("e")).select("at", F.col("e.v").alias("x"), F.col("e.fresh").alias("fresh"))
    ahead = asked.join(graph.select(F.col("u").alias("x"), floor.alias("floor"), "unit"), "x").groupBy("at").agg(told().alias("ahead"))
    return ahead.join(back, "at", "left")


def descend(graph: DataFrame, degree: int, tables: Tables) -> tuple[DataFrame, float]:
    """One round of NN-descent: the better graph, and the share of its edges that are new."""
    both = F.concat("ahead", F.coalesce("back", F.array().cast("array<struct<x:bigint,fresh:int,floor:float,unit:binary>>")))
    count = graph.count()
    meet = _meetings(graph, degree).select(both.alias("g")).where(F.exists("g", lambda r: r["fresh"] == 1)).coalesce(tasks(count * degree))

    def offers(batches):
        for batch in batches:
            us, vs, ss = [], [], []
            for g in _groups(batch):
                order = np.lexsort((-g["fresh"], g["x"]))  # who comes both ways comes once
                once = order[np.append(True, np.diff(g["x"][order]) > 0)]
                ids, m, fresh, floor = g["x"][once], g["unit"][once], g["fresh"][once] == 1, g["floor"][once]
                k = min(OFFERS, len(ids) - 1)
                if k <= 0:
                    continue
                sims = m @ m.T
                np.fill_diagonal(sims, -9)
                sims[~(fresh[:, None] | fresh[None, :])] = -9
                top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                got = _rounded(np.take_along_axis(sims, top, 1))
                better = (got > floor[:, None]) & (got > _NO_FLOOR)
                us.append(np.repeat(ids, better.sum(axis=1)))
                vs.append(ids[top[better]])
                ss.append(got[better])
            if us:
                yield pa.record_batch({"u": np.concatenate(us), "v": np.concatenate(vs), "s": np.concatenate(ss)})

    found = _ranked(meet.mapInArrow(offers, "u long, v long, s float"), degree)
    after = graph.join(found, "u", "left").select("u", "unit", _merged(F.col("near"), F.coalesce("offered", F.array().cast("array<struct<s:float,v:bigint>>")), degree).alias("near"))
    after = tables.put("graph", after.coalesce(tasks(count)))
    n = after.agg(F.sum(F.aggregate("near", F.lit(0), lambda n, x: n + x["fresh"])), F.sum(F.size("near"))).first()
    return after, (n[0] or 0) / max(1, n[1] or 1)


def build_graph(nodes: DataFrame, degree: int, tables: Tables, rounds: int = ROUNDS) -> DataFrame:
    """(u, unit, near): the neighbours of each node, best first."""
    graph = first_graph(nodes, nodes.count(), degree, tables)
    for _ in range(rounds):
        graph, changed = descend(graph, degree, tables)
        if changed < SETTLED:
            break
    return graph


def search(graph: DataFrame, asking: DataFrame, degree: int, beam: int, tables: Tables) -> DataFrame:
    """(query_id, beam): the best nodes that a greedy search from each node of asking (query_id) finds."""
    slim = lambda c: F.transform(c, lambda r: F.struct(r["x"].alias("x"), r["unit"].alias("unit")))
    links = _meetings(graph, degree).select(F.col("at").alias("u"), F.concat(slim("ahead"), F.coalesce(slim("back"), F.array().cast("array<struct<x:bigint,unit:binary>>"))).alias("g"))
    links = tables.put("links", links, by="u")
    schema = "query_id long, q binary, beam array<long>, sims array<float>, done array<boolean>, ask array<long>"
    arrow = pa.schema([("query_id", pa.int64()), ("q", pa.binary()), ("beam", pa.list_(pa.int64())), ("sims", pa.list_(pa.float32())), ("done", pa.list_(pa.bool_())), ("ask", pa.list_(pa.int64()))])

    def look(batches):
        """What the nodes that a query expands are linked to, where it beats the query's beam."""
        for batch in batches:
            queries, found, sims = [], [], []
            own, floors, ids = _matrix(batch.column("q")), batch.column("floor").to_numpy(), batch.column("query_id").to_numpy()
            for i, g in enumerate(_groups(batch)):
                s = g["unit"] @ own[i]
                better = s > floors[i]
                queries.append(np.full(better.sum(), ids[i]))
                found.append(g["x"][better])
                sims.append(s[better])
            if queries:
                yield pa.record_batch({"query_id": np.concatenate(queries).astype(np.int64), "x": np.concatenate(found).astype(np.int64), "s": np.concatenate(sims).astype(np.float32)})

    def step(batches):
        """Take up what was found, and choose which nodes to expand next."""
        for batch in batches:
            beams, sims, done, asks = [], [], [], []
            got, ids = batch.column("g"), batch.column("query_id")
            for i in range(batch.num_rows):
                x, s, old = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("beam", "sims", "done"))
                if got[i].is_valid and len(got[i].values):
                    new = got[i].values
                    x, s, old = np.append(x, new.field("x")), np.append(s, new.field("s")), np.append(old.astype(bool), np.zeros(len(new), bool))
                    order = np.lexsort((-s, ~old, x))  # who is known stays as it is, of the others the best counts
                    once = order[np.append(True, np.diff(x[order]) > 0)]
                    best = once[np.lexsort((x[once], -s[once]))[:beam]]
                    x, s, old = x[best], s[best], old[best]
                ask = np.flatnonzero(~old.astype(bool))[:WIDTH]
                now = old.astype(bool)
                now[ask] = True
                beams.append(x)
                sims.append(s)
                done.append(now)
                asks.append(x[ask])
            if beams:
                yield pa.RecordBatch.from_arrays([ids, batch.column("q"), *(pa.array(v, k.type) for v, k in zip((beams, sims, done, asks), list(arrow)[2:]))], schema=arrow)

    none = lambda kind: F.array().cast(kind)
    state = graph.join(asking.select(F.col("query_id").alias("u")), "u", "left_semi").select(F.col("u").alias("query_id"), F.col("unit").alias("q"), F.array("u").alias("beam"), F.array(F.lit(1.0).cast("float")).alias("sims"), F.array(F.lit(True)).alias("done"), F.array("u").alias("ask"))
    wide = tasks(graph.count() * degree)
    few = tasks(state.count() * beam)
    while True:
        state = tables.put("beams", state.coalesce(few))
        if state.where(F.size("ask") > 0).isEmpty():
            return state.select("query_id", "beam")
        floor = F.when(F.size("beam") >= beam, F.element_at("sims", -1)).otherwise(F.lit(_NO_FLOOR).cast("float"))
        asked = state.select("query_id", "q", floor.alias("floor"), F.explode("ask").alias("u"))
        found = links.join(asked.hint("shuffle_hash"), "u").select("query_id", "q", "floor", "g").coalesce(wide).mapInArrow(look, "query_id long, x long, s float")
        found = found.groupBy("query_id").agg(F.collect_set(F.struct("x", "s")).alias("g"))  # at most WIDTH x (degree + REVERSE)
        state = state.join(found, "query_id", "left").select("query_id", "q", "beam", "sims", "done", "g").mapInArrow(step, schema)


def cosine(a: Column, b: Column) -> Column:
    """In double precision, of arrays of doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, every: int, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row whose id is divisible by `every`, the k nearest other rows."""
    tables = Tables(vectors.sparkSession)
    nodes = nodes_of(vectors, id_col, vec_col, k + 1, tables)
    degree, beam = budget(nodes.count())
    graph = build_graph(nodes, degree, tables)
    # A node may stand for several queries: they share one search.
    kind = dict(nodes.dtypes)["vec"]
    asking = vectors.where(F.col(id_col) % every == 0).select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).cast(kind).alias("vec"))
    of = tables.put("queries", asking.join(nodes.select("node", "vec"), "vec").select("query_id", "node").distinct().coalesce(tasks(nodes.count())))
    beams = search(graph, of.select(F.col("node").alias("query_id")).distinct(), degree, beam, tables)
    near = beams.select("query_id", F.explode(F.slice("beam", 1, max(RESCORED, 4 * (k + 1)))).alias("node"))
    exact = F.col("vec").cast("array<double>")
    q = nodes.select(F.col("node").alias("query_id"), exact.alias("q"))
    scored = near.join(nodes.select("node", exact.alias("vec"), "ids"), "node").join(q, "query_id").select("query_id", "ids", cosine(F.col("q"), F.col("vec")).alias("score"))
    found = scored.groupBy(F.col("query_id").alias("node")).agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    rows = of.join(found, "node").select("query_id", F.explode("found").alias("f")).select("query_id", F.col("f.score").alias("score"), F.explode("f.ids").alias("id")).where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    best = cut(rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score").coalesce(tasks(of.count() * k)))
    tables.clear()
    return best
