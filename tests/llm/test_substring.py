"""FM-index and substring dedup: counts, matching statistics and removed words against brute force."""

import hashlib
import random

import numpy as np
import pytest

from sparkcurate.llm import fmindex as X
from sparkcurate.llm import substring as S


def test_rank():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 500):
        bits = rng.random(n) < 0.4
        at = np.arange(n + 1)
        assert (X.Bits(bits).rank(at) == np.concatenate([[0], np.cumsum(bits)])).all()
        symbols = rng.integers(0, 9, n)
        tree = X.Wavelet(symbols, 8)
        for s in range(9):
            low, high = tree.ranks(np.full(n + 1, s), at, np.full(n + 1, n))
            assert (low == np.concatenate([[0], np.cumsum(symbols == s)])).all() and (high == (symbols == s).sum()).all()


@pytest.mark.parametrize("depth", [2, 3, 4, 7, 8, 9])
def test_backward_search(depth):
    rng = np.random.default_rng(depth)
    text = np.append(rng.integers(0, 4, 299), 0)
    index = X.FMIndex(text, depth)
    for _ in range(200):
        pattern = rng.integers(1, 4, rng.integers(1, depth + 1))
        low, high = np.array([0]), np.array([index.n])
        for word in pattern[::-1]:
            low, high = index.step(low, high, np.array([word]))
        places = {i for i in range(len(text) - len(pattern) + 1) if (text[i : i + len(pattern)] == pattern).all()}
        assert {*index.suffixes[low[0] : max(high[0], low[0])].tolist()} == places


def test_smallest_starts():
    rng = random.Random(1)
    stretches = [b" ".join(rng.choice([b"a", b"b"]) for _ in range(rng.randint(6, 40))) for _ in range(30)]
    docs = np.array([rng.randrange(100) for _ in stretches])
    first = {}
    for s, d in zip(stretches, docs):
        w = s.split()
        for i in range(len(w) - 5):
            first[tuple(w[i : i + 6])] = min(first.get(tuple(w[i : i + 6]), d), d)
    for s, got in zip(stretches, S.smallest_starts(stretches, docs, 6)):
        w = s.split()
        assert got.tolist() == [first[tuple(w[i : i + 6])] for i in range(len(w) - 5)]


def plain(rows):
    first = {}
    for d, text in rows:
        w = (text or "").encode().split()
        for i in range(len(w) - 49 if d is not None else 0):
            first[tuple(w[i : i + 50])] = min(first.get(tuple(w[i : i + 50]), d), d)
    out = []
    for d, text in rows:
        w = (text or "").encode().split()
        gone = {i + k for i in range(len(w) - 49 if d is not None else 0) if first[tuple(w[i : i + 50])] < d for k in range(50)}
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot, crowded", [(5000, 25_000), (1, 10_000), (0, 2)])
def test_removed_words(spark, edges, none, monkeypatch, hot, crowded):
    monkeypatch.setattr(S, "HOT_RUNS", hot)
    monkeypatch.setattr(S, "CROWDED_RUNS", crowded)
    rng = random.Random(2)
    word = lambda: str(rng.randrange(10**5))
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 70, 200)]
    rows = [(d, " ".join([word() for _ in range(rng.randrange(60))] + rng.choice(shared) + [word() for _ in range(rng.randrange(60))])) for d in range(60)]
    docs = spark.createDataFrame(rows + [(d, t) for d, t, *_ in edges.collect()], "doc_id long, text string")
    got = S.remove_repeats(docs).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == plain([tuple(r) for r in docs.collect()])
    if hot == 5000:
        assert S.remove_repeats(edges).count() == edges.count() and S.remove_repeats(none).count() == 0
