"""Collision counting: recall and scores against all inner products, its guarantee, odd vectors."""

import math

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcurate.llm import neighbours as N
from sparkcurate.llm.queries import op12_collision_neighbours

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
    *[T.StructField(c, T.LongType()) for c in ("id", "q", "block", "rank")],
])


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in vectors], SCHEMA).repartition(3)


def plain(vectors, query, k=20):
    """All inner products, summed from left to right."""
    ids = [i for i, _ in vectors]
    q = next(v for i, v in vectors if i == query)
    scores = N.inner(np.array([v for _, v in vectors]), np.array(q))
    found = sorted((-s, math.inf if i is None else i, i) for s, i in zip(scores, ids) if i != query)
    return [(i, -s) for s, _, i in found[:k]]


def test_reach_is_the_binomial_tail():
    from statistics import NormalDist

    p = 2 * NormalDist().cdf(N.reach(64, 40, 0.9)) - 1
    hits = (np.random.default_rng(0).random((200_000, 64)) < p).sum(axis=1)
    assert abs((hits >= 40).mean() - 0.9) < 0.005


def test_recall_and_scores_on_the_given_vectors(spark):
    folder = "/root/testdata/sf0.01"
    vectors = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    rows = op12_collision_neighbours(spark, folder).collect()
    queries = {i for i, _ in vectors if i % 20 == 0}
    assert {r.query_id for r in rows} == queries and len(rows) == 20 * len(queries)
    hit = 0
    for q in queries:
        got = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        want = plain(vectors, q)
        hit += len({i for _, i, _ in got} & {i for i, _ in want})
        scores = dict(plain(vectors, q, len(vectors)))
        assert [r for r, *_ in got] == list(range(1, 21))
        assert [(i, s) for _, i, s in got] == sorted(((i, scores[i]) for _, i, _ in got), key=lambda x: (-x[1], x[0]))
    assert hit >= 0.95 * 20 * len(queries)


def test_clusters_norms_and_blocks_keep_recall(spark):
    """A third of the rows around one point, norms over six decades; several blocks and batches."""
    draw = np.random.default_rng(5)
    x = draw.standard_normal((3000, 16))
    x[::3] = x[0] + 0.01 * draw.standard_normal((1000, 16))
    x *= 10.0 ** draw.uniform(-3, 3, (3000, 1))
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    rows = N.search(table(spark, vectors), F.col("vec_id") % 100 == 0, k=10, block_rows=700, batch_rows=7).collect()
    hit = sum(len({r.vec_id for r in rows if r.query_id == q} & {i for i, _ in plain(vectors, q, 10)}) for q in range(0, 3000, 100))
    assert len(rows) == 300 and hit >= 0.95 * 300


def test_an_index_verifies_few_and_finds_copies():
    draw = np.random.default_rng(6)
    x = draw.standard_normal((20_000, 24))
    x[1:40] = x[0] + 0.02 * draw.standard_normal((39, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = N.Index(list(range(20_000)), x)
    found = index.search(0, x[0], 20)
    assert {i for i, _ in found} <= set(range(1, 40)) and len(found) == 20
    assert index.verified < 200  # those nearby, not all


def by_steps(index, query, q, k):
    """One octave searched with all counts taken anew at every step."""
    (part,), size, n, best, width = index.octaves, float(N.norms(q[None])[0]), len(index.ids), -math.inf, N.FIRST
    spots = part.places(np.arange(n))
    place = ((q / size) @ index.lines[:-1] + N.SPAN * np.arange(len(spots)))[:, None]
    scores, own = part.x @ q, np.array([i == query for i in index.ids])
    while True:
        counts = ((spots >= place - width) & (spots < place + width)).sum(axis=0)
        found = np.flatnonzero((counts >= index.enough) & ~own)
        if len(found) >= k:
            best = np.sort(scores[found])[-k]
        needed = index.reach * math.sqrt(max(0.0, 2 - 2 * best / (size * part.top))) if best > -math.inf else math.inf
        if counts.min() == len(spots) or width >= needed:
            return sorted(((index.ids[i], N.inner(part.x[[i]], q)[0]) for i in found), key=lambda r: (-r[1], r[0]))[:k]
        width = min(N.GROWN * width, needed) if needed < math.inf else width * min(2.0, max(N.GROWN, index.enough / max(1, np.sort(counts)[-k])))


def test_a_search_counts_few_times_and_ends_as_by_steps(monkeypatch):
    draw = np.random.default_rng(8)
    for n, dims, k in ((4_000, 48, 20), (700, 8, 5), (30, 4, 20)):
        x = draw.standard_normal((n, dims))
        x[n // 2 : n // 2 + 5] = x[0]
        x /= np.linalg.norm(x, axis=1)[:, None]
        index, queries = N.Index([i // 2 for i in range(n)], x), list(range(0, n, max(1, n // 40)))
        want = [by_steps(index, index.ids[i], x[i], k) for i in queries]
        placed, plain_search = [], np.searchsorted
        monkeypatch.setattr(N.np, "searchsorted", lambda *a: placed.append(1) or plain_search(*a))
        assert [index.search(index.ids[i], x[i], k) for i in queries] == want
        assert len(placed) <= 7 * len(queries)  # windows placed and counted; nine and more when every step was counted
        monkeypatch.undo()
        assert index.search_all([index.ids[i] for i in queries], x[queries], k) == want


def test_ranks_are_counted_as_walks_count_them():
    draw = np.random.default_rng(9)
    for n in (1, 100, 255, 256, 1_000):
        x = draw.standard_normal((n, 5))
        part = N.Octave(np.arange(n), x, N.norms(x), draw.standard_normal((6, 300 if n == 100 else 7)))
        windows = np.sort(draw.integers(0, n + 1, (3, 2, len(part.starts))), axis=1)
        windows[0, 0, :3], windows[0, 1, :3] = 0, n
        windows += part.starts
        for counts, (low, high) in zip(part.count_ranks(windows), windows.tolist()):
            assert (counts == part.count(list(zip(low, high)))).all()


def test_odd_vectors_and_ties(spark):
    v = [1.0, 0.0, 2.0]
    vectors = [(0, v), (0, [9.0, 9.0, 9.0]), (1, v), (1, v), (7, [3.0, 1.0, 1.0]), (2, v), (None, v), (20, [-1.0, 0.5, 0.0]),
               (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 1.0]), (8, [math.nan, 1.0, 1.0]), (9, [math.inf, 1.0, 1.0]),
               (40, [1.0, 1.0]), (60, None), (80, [0.0, 0.0, 0.0])]
    rows = N.search(table(spark, vectors), F.col("vec_id") % 20 == 0).collect()
    got = {q: [(r.vec_id, r.score) for r in sorted(rows, key=lambda r: r.rank) if r.query_id == q] for q in {r.query_id for r in rows}}
    # The smallest vector of the repeated query 0 is v; neither of its rows is a candidate.
    assert got == {
        0: [(1, 5.0), (1, 5.0), (2, 5.0), (7, 5.0), (None, 5.0), (20, -1.0)],
        20: [(0, -1.0), (1, -1.0), (1, -1.0), (2, -1.0), (None, -1.0), (7, -2.5), (0, -4.5)],
    }
    empty = N.search(table(spark, []), F.col("vec_id") % 20 == 0)
    assert empty.columns == ["query_id", "rank", "vec_id", "score"] and empty.count() == 0
    assert N.search(table(spark, [(1, v)]), F.col("vec_id") % 20 == 0).count() == 0
    assert N.search(table(spark, [(0, v)]), F.col("vec_id") % 20 == 0).count() == 0
