"""BagMinHash: agreement estimates weighted Jaccard; classes equal those of all pairs."""

import random
from collections import Counter

import numpy as np

from sparkcurate.llm import bagminhash as B


def jaccard(a, b):
    a, b = Counter(a), Counter(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_signatures_are_unbiased_for_counts_too():
    rng, gaps = random.Random(1), []
    for _ in range(300):
        a = [rng.randrange(10**6) for _ in range(rng.choice([1, 5, 60]))]
        a += [rng.choice(a)] * rng.randrange(60)
        b = [x for x in a if rng.random() < 0.9] or a
        s = B.signatures([B.mix(np.array(x, np.uint64)) for x in (a, b)])
        gaps.append((s[0] == s[1]).mean() - jaccard(a, b))
    assert abs(np.mean(gaps)) < 0.01 and np.std(gaps) < 0.08


def test_elements_turn_multisets_into_sets():
    a, b = "x y z w v " * 4, "x y z w v " * 3
    s, t = set(B.elements(a).tolist()), set(B.elements(b).tolist())
    grams = lambda text: [tuple(text.split()[i : i + 5]) for i in range(len(text.split()) - 4)]
    assert len(s & t) / len(s | t) == jaccard(grams(a), grams(b))


def brute(texts):
    bags = [Counter(tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)) if (w := (t or "").encode().split()) else None for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(bags):
        for j, b in enumerate(bags[:i]):
            if a and b:
                common = sum((a & b).values())
                if common >= 0.8 * (sum(a.values()) + sum(b.values()) - common) - 1e-9:
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def test_classes_equal_all_pairs(spark):
    """Families around the limit: many are only linked through others, hubs and blocks both work."""
    rng = random.Random(3)
    texts = []
    for _ in range(8):
        base = [str(rng.randrange(10**6)) for _ in range(90)]
        for k in range(30):
            copy = list(base)
            for _ in range(k % 6):
                copy[rng.randrange(len(copy))] = str(rng.randrange(10**6))
            texts.append(" ".join(copy))
    texts += [None, "", "a", "a", "a b", "a b a b a b a b a b"] + texts[:5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: (r.class_id, r.class_size) for r in B.near_duplicates(docs).collect()}
    want, size = brute(texts), Counter(brute(texts))
    assert [got[i][0] for i in range(len(texts))] == want
    assert all(got[i][1] == size[want[i]] for i in got)


def test_rows_are_looked_up_without_moving_their_texts(spark):
    numbers = [0, 1, 7, 8, 32767, 32768, 32769, 65536, 2**33, 2**33 + 32768, 5 * 2**33 + 70000]
    rows = spark.createDataFrame([(n, f"text {n}") for n in numbers], "row long, text string")
    for wanted in (numbers, numbers[::2], numbers[1::2] * 2, [3], []):
        got = B.among(rows, spark.createDataFrame([(n,) for n in wanted], "node long"))
        assert sorted(map(tuple, got.collect())) == [(n, f"text {n}") for n in numbers if n in wanted]
    plan = B.among(rows, rows.select("row"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_edges(edges, none):
    kept = B.keep_one(edges)
    assert kept.columns == edges.columns and kept.schema == edges.schema
    ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect())
    assert ids == [-1, 0, 1, 2, 3, 4, 5, 6, 8, 9, 10, 12]
    assert B.keep_one(none).count() == 0 and B.near_duplicates(none).count() == 0
