import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from symbolgraph.llm import divergence, divergence_sql


def brute(rows, least=3, top=200):
    docs, n = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in ((t or "", la or "", s or "") for t, la, s in rows):
        words = re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        docs[lang].update(set(words))
        n[lang, source].update(words)
    out = []
    for lang in {g[0] for g in n}:
        kept = [t for t, k in docs[lang].items() if k >= least]
        groups = {s: {t: c[t] for t in kept} for (la, s), c in n.items() if la == lang}

        def shares(counts):
            whole = sum(counts.values()) + len(kept)
            return {t: 1 + 1_000_000_000 * (c + 1) // whole for t, c in counts.items()}

        q = shares({t: sum(g[t] for g in groups.values()) for t in kept})
        for s, counts in groups.items():
            p = shares(counts)
            far = [(h, sum((p[t] - r[t]) ** 2 // r[t] for t in kept)) for h, r in ((h, shares(c)) for h, c in groups.items()) if h != s]
            over = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept if counts[t] and p[t] > q[t]]
            for part, items, most in (("pair", far, len(far)), ("term", over, top)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["alpha", "Beta", "GAMMA", "straße", "ÄÖ", "äö", "你好", "x", "a1b", "\U0001f600", "don't", "é-é"] + [f"w{chr(97 + i)}" for i in range(20)]
    made = [(" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None, "ü"])) for _ in range(150)]
    return made + [(None, "en", "a"), ("", "xx", "only"), ("lonely words", "yy", "one"), ("other", "yy", "two")] + [("same same text", "en", "hot")] * 40


def test_equals_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "PAIRS", 16)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, n long, value long").repartition(5)
    found = divergence.audit(docs)
    assert found.columns == divergence.RESULT
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)
    assert sorted(tuple(r) for r in divergence.audit(docs, least=1, top=3).collect()) == brute(rows, 1, 3)


def test_sql_equals_brute_force(rows):
    con = duckdb.connect()
    con.execute("create table documents (text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    names = [c[0] for c in con.execute(divergence_sql.oracle()).description]
    at = [names.index(c) for c in divergence.RESULT]
    assert sorted(tuple(r[i] for i in at) for r in con.execute(divergence_sql.oracle()).fetchall()) == brute(rows)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_stretches_lose_no_term(monkeypatch):
    monkeypatch.setattr(divergence, "STRETCH", 7)
    text = "one twothreefourfive six  seven-eight é".encode()
    assert b"".join(divergence.stretches(text)) == text
    assert [t for s in divergence.stretches(text) for t in divergence.TERM.findall(s)] == divergence.TERM.findall(text)


def test_share_is_exact():
    rng = random.Random(1)
    n = [rng.randint(1, 10**15) for _ in range(200)]
    whole = [rng.randint(k, 9 * 10**15) for k in n]
    assert divergence.share(np.array(n), np.array(whole)).tolist() == [1 + 10**9 * a // b for a, b in zip(n, whole)]


def test_unsorted_rows_are_gathered_in_bounded_steps(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "SUMMED", 7)
    monkeypatch.setattr(divergence, "RUN_ROWS", 2)
    rng, total = np.random.default_rng(3), {}
    batches = []
    for _ in range(12):
        rows = [(("x", "y")[rng.integers(2)], "abcdef"[rng.integers(6)], ("s", "t", "")[rng.integers(3)], int(rng.integers(1, 3)), int(rng.integers(3, 9))) for _ in range(5)]
        for lang, term, source, docs, n in rows:
            d, o = total.get((lang, term, source), (0, 0))
            total[lang, term, source] = d + docs, o + n
        batches.append(pa.RecordBatch.from_arrays([*map(pa.array, zip(*rows))], divergence.COUNTED_NAMES))
    of = lambda lang, term, k: sum(v[k] for key, v in total.items() if key[:2] == (lang, term))
    want = {(*key, n, of(*key[:2], 1)) for key, (_, n) in total.items() if of(*key[:2], 0) >= 6}
    got = [tuple(r.values()) for b in divergence.gather(6)(iter(batches)) for r in b.to_pylist()]
    assert {r[:5] for r in got} == want and len(got) == len(want)
    assert sorted(r[:2] for r in got if r[5]) == sorted({r[:2] for r in want})
    assert all(b[5] or a[:2] == b[:2] for a, b in zip(got, got[1:]))
