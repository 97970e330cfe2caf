import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from symbolgraph.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ODD = ["", " ", "  ", "\n", "a", "Word", "'s", "don't", "é", "ß", "你", "好", " ", "᠎", "​", "　", "\x85", "\x1c", "!!", "12", "<|endoftext|>", "<|end", "\U0001f600", "́", "ก"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("ranks", [None, RANKS])
def test_encoder_gives_the_tokenizers_ids(tokenizer, ranks):
    encoder, rng = packing.Encoder(PATH, ranks), random.Random(5)
    for _ in range(2000):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 12)))
        assert encoder.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_encoder_takes_long_texts_in_stretches(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 10)
    text = "One two,  three\n four five 你好 six seven. " * 20
    for ranks in (None, RANKS):
        assert packing.Encoder(PATH, ranks).encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 500), min_size=1), st.sampled_from([60, 61, 97]))
def test_plan_places_every_piece_without_gaps(counts, size):
    patterns = packing.plan(counts, size)
    used: dict[int, int] = {}
    for pattern, times in patterns:
        assert sum(pattern) <= size and times > 0
        for n in pattern:
            used[n] = used.get(n, 0) + times
    assert used == counts
    length = np.concatenate([np.full(k, n) for n, k in counts.items()])
    rank = np.concatenate([np.arange(k) for k in counts.values()])
    sequence, offset = packing.dealt(packing.places(patterns), length, rank)
    order = np.lexsort((offset, sequence))
    sequence, offset, length = sequence[order], offset[order], length[order]
    first = np.r_[True, sequence[1:] != sequence[:-1]]
    assert (offset[first] == 0).all() and (offset[~first] == (offset + length)[:-1][~first[1:]]).all()
    assert first.sum() == sum(times for _, times in patterns)


@pytest.mark.parametrize("size, pieces, most", [(10, {6: 3, 4: 3}, 3), (10, {7: 2, 2: 2, 1: 2}, 2), (12, {5: 2, 4: 2, 2: 2, 1: 2}, 2), (1024, {20: 10_007}, 197)])
def test_exact_complements_are_found(size, pieces, most):
    assert sum(times for _, times in packing.plan(pieces, size)) == most


def test_close_to_the_least_number_of_sequences():
    rng = np.random.default_rng(3)
    for low, high in ((1, 1024), (3, 60), (50, 500)):
        n, k = np.unique(rng.integers(low, high, 20_000), return_counts=True)
        made = sum(times for _, times in packing.plan(dict(zip(n.tolist(), k.tolist())), 1024))
        assert made <= 1.02 * -(-int((n * k).sum()) // 1024)


def test_pack_cuts_numbers_and_places(spark, tokenizer):
    rng = random.Random(8)
    texts = [None, "", "one", "one", " ".join(rng.choice(["alpha", "beta", "gamma,", "你好"]) for _ in range(3000))] + ["word " * rng.randint(1, 400) for _ in range(60)]
    rows = [(i if i != 3 else 2, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, block long").repartition(3)
    packed = packing.pack(docs, PATH, size=128, keep_ids=True)
    found = packed.collect()
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    whole: dict = {}
    for i, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        start = 0
        for piece, n in enumerate(packing.lengths(len(ids), 128)):
            part = np.array(ids[start : start + n], "<u4").tobytes()
            whole.setdefault((i, piece, start, n, zlib.crc32(part)), []).append(part)
            start += n
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(k for k, v in whole.items() for _ in v)
    filled: dict = {}
    for r in found:
        filled.setdefault(r.sequence_id, []).append((r.offset, bytes(r.ids)))
    for places in filled.values():
        at = 0
        for offset, ids in sorted(places):
            assert offset == at
            at += len(ids) // 4
        assert at <= 128
    joined = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert all(np.array(joined[s].ids, "<i4").tobytes() == b"".join(i for _, i in sorted(p)) for s, p in filled.items())
    assert packing.pack(docs.limit(0), PATH).count() == 0
