import math
import random

import numpy as np

from symbolgraph.llm import codes


def brute(rows, parts, entries, rounds, scale=256):
    kept = sorted(((i, v, la) for i, v, la in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0], r[1]))
    x = [[[math.floor(scale * c) for c in v[p * len(v) // parts : (p + 1) * len(v) // parts]] for p in range(parts)] for _, v, _ in kept]
    books = [[x[k][p] for k in range(min(entries, len(x)))] for p in range(parts)]

    def nearest():
        away = [[[sum((a - b) ** 2 for a, b in zip(v[p], e)) for e in books[p]] for p in range(parts)] for v in x]
        return [[(min(range(len(d)), key=lambda j: (d[j], j)), min(d)) for d in row] for row in away]

    for _ in range(rounds):
        found = nearest()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [x[k][p] for k in range(len(x)) if found[k][p][0] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    out, total = [], {}
    for (i, _, label), row in zip(kept, nearest()):
        error = sum(d for _, d in row)
        total[label] = total.get(label, 0) + error
        out.append((i, "".join(f"{j:02x}" for j, _ in row), error, label))
    return sorted((i, c, e, total[label]) for i, c, e, label in out), codes.fingerprint([np.array(b) for b in books])


def made(n, dims, seed, grid):
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(rng.choice([-1, 0, 1]), 0.4) * grid) / grid for _ in range(dims)], rng.choice([None, 0, 1, 2])) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [None] + [0.5] * (dims - 1), 1), (n + 2, [float("nan")] * dims, 1), (n + 3, [float("inf")] * dims, 1)]
    return rows + rows[:5] + [(n + 4 + k, rows[0][1], 7) for k in range(30)]


def test_equals_plain_rounds(spark):
    for n, dims, parts, entries, rounds, grid in ((400, 8, 4, 32, 2, 64), (300, 8, 2, 64, 4, 2), (10, 4, 4, 64, 2, 8)):
        rows = made(n, dims, n, grid)
        table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, code int").repartition(3)
        found = codes.encode(table, parts=parts, entries=entries, rounds=rounds).collect()
        expected, sha = brute(rows, parts, entries, rounds)
        assert sorted(tuple(r)[:4] for r in found) == expected
        assert {r.codebooks_sha256 for r in found} == {sha}


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(4000, 4)) * 200).astype(np.int64) + rng.choice([-2000, 0, 2000], (4000, 1))
    entries = x[:60].copy()
    group = codes.grouped(entries)
    code, _, bounds = codes.Position(entries, group).assign(x)
    spared = []
    for _ in range(4):
        after = np.array([x[code == j].sum(0) // max((code == j).sum(), 1) if (code == j).any() else entries[j] for j in range(60)])
        code, least, bounds, work = codes.Position(after, group, entries).reassign(x, code, bounds)
        d = codes.distances(x, after)
        assert (code == d.argmin(1)).all() and (least == d.min(1)).all()
        d[np.arange(len(x)), code] = 1 << 60
        for g in range(group.max() + 1):
            assert (bounds[:, g] ** 2 <= d[:, group == g].min(1)).all()
        spared.append(1 - work / d.size)
        entries = after
    assert spared[-1] > 0.3


def test_integer_roots():
    squares = np.array([0, 1, 2, 3, 4, 99, 100, (1 << 31) ** 2 - 1, (1 << 31) ** 2, (1 << 62) - 1])
    assert codes.isqrt(squares).tolist() == [math.isqrt(int(s)) for s in squares]


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert codes.encode(spark.createDataFrame([], schema)).count() == 0
    assert codes.encode(spark.createDataFrame([(1, None, 1), (2, [], 1), (3, [1.0], 1)], schema)).count() == 0
    lone = codes.encode(spark.createDataFrame([(1, [0.5] * 16, None), (None, [0.25] * 16, None), (2, [1.0] * 15, 1)], schema)).collect()
    assert sorted((r.vec_id or 0, r.code, r.error, r.label_error) for r in lone) == [(i, "00" * 16, 16 * 32**2, 2 * 16 * 32**2) for i in (0, 1)]


def test_rare_null_labels_and_large_components(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-999, 999)) / 256 for _ in range(8)], None if i in (7, 300) else i % 3) for i in range(450)]
    for i in (3, 90, 200, 201):
        rows[i][1][i % 8] = (-1) ** i * 4e6
    huge = [(i, [2.0**70, -(2.0**1000), 0.5, 7e300, *v[4:]], label) for i, v, label in rows]
    for given in (rows, huge):
        found = codes.encode(spark.createDataFrame(given, "vec_id long, embedding array<double>, label int").repartition(3), parts=4, entries=16).collect()
        expected, sha = brute(given, 4, 16, 2)
        assert sorted(tuple(r)[:4] for r in found) == expected
        assert {r.codebooks_sha256 for r in found} == {sha}
