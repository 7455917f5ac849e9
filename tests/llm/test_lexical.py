"""Ranked search: against plain scores of all documents, masks of many terms, batches, odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import types as T

from llm_rows import prose
from sparkcurate.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=50):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, total = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, words in wanted.items():
        scored = []
        for doc, c, n in counted:
            m = 100 - 50 + (50 * n * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in words if c[t]
            )
            if score > 0:
                scored.append((-score, math.inf if doc is None else doc, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def ranked(docs, items, k=50):
    df = L.rank(docs, items, k)
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("doc_id", T.LongType())])


def test_terms_are_those_of_the_pattern():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("aB9 _-é 日\x7f\x1f\x85 Z[`{@/:") for _ in range(rng.randrange(60)))
        assert [t.decode() for t in L.terms_of(text)] == terms(text)


def test_odd_rows_match_plain_scores(spark, edges, none):
    rows = [(1, prose(2, 80)), (1, "extra words"), (2, None), (3, ""), (4, "... "), (None, "light grass"), (5, "A B c 1"), (6, prose(2, 80)),
            (7, prose(1, 400)), (8, "日本 É nowhere")]
    items = spark.createDataFrame([(i, t, 0) for i, t in rows], ITEMS)
    docs = [(r.doc_id, r.text) for r in edges.collect()]
    assert ranked(edges, items) == plain(docs, rows)
    assert ranked(edges, items, 2) == plain(docs, rows, 2)
    assert ranked(none, items) == [] and ranked(edges, items.limit(0)) == []


def test_blocks_and_batches_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    monkeypatch.setattr(L, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(L, "STEP", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert ranked(docs.repartition(4), items) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_masks_finish_early_and_lose_nothing():
    rng = np.random.default_rng(7)
    n_docs, n_terms = 5000, 150
    held = rng.random((n_docs, n_terms)) < rng.uniform(0.001, 0.5, n_terms)
    owner, term = np.nonzero(held)
    counts = rng.integers(1, 9, len(owner))
    n = np.bincount(owner, counts, n_docs).astype(np.int64) + 1
    total = int(n.sum())
    batch = L.Batch(n, owner, term, counts, n_docs, total)
    weights = np.array([L.weight(n_docs, int(x)) for x in held.sum(axis=0)])
    m = 50 + 50 * n * n_docs // total
    scores = np.zeros(n_docs, np.int64)
    np.add.at(scores, owner, weights[term] * (10**9 * counts // (1000 * counts + 20 * m[owner])))
    docs, found, done = batch.best(np.arange(n_terms), weights, 20, 0)
    limit = np.sort(scores)[-20]
    assert set(docs) == set(np.flatnonzero(scores >= limit)) and (found == scores[docs]).all()
    few = np.argsort(-weights)[:12]
    docs, found, done = batch.best(np.sort(few), weights[np.sort(few)], 20, 0)
    assert done < n_docs / 2
    # The bitmaps say which documents hold which terms.
    bits = np.unpackbits(batch.bitmaps, axis=1, count=n_docs)
    assert (bits.T == held[:, batch.numbers]).all()


def test_length_part_leaves_64_bits():
    n = np.array([10**9, 5])
    assert L.length_part(n, 10**12, 10**13).tolist() == [50 + 50 * 10**9 * 10**12 // 10**13, 50 + 25]
