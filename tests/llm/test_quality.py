"""Quality votes: the measures against a plain count, the estimation on planted votes, edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sparkcurate.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    windows = list(zip(words, words[1:], words[2:]))
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_measures_match_a_plain_count():
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice(["a", "b", "é", " ", "\n", "\x1f", "#", "|", "ab ", "\u00a0", "\t"]) for _ in range(rng.randrange(90)))
        assert Q.measure_text(text)[:5] == plain(text)
    assert Q.measure_text(None)[:5] == plain(None)


def test_estimation_finds_planted_rules():
    rng = np.random.default_rng(2)
    good = rng.random(20_000) < 0.7
    right = np.linspace(0.7, 0.95, len(Q.RULES))
    says = np.where(rng.random((20_000, len(right))) < right, np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None])
    says = np.where(rng.random(says.shape) < 0.3, 0, says)
    counts = pd.DataFrame(says, columns=list(Q.RULES)).value_counts().reset_index()
    share, p = Q.estimate(counts)
    assert abs(share - 0.7) < 0.02
    assert np.abs(p[1, :, 2] / (1 - p[1, :, 1]) - right).max() < 0.03
    picked = np.stack([says == v for v in (-1, 0, 1)], 2).astype(float)
    assert ((Q.posterior(picked, share, p) > 0.5) == good).mean() > 0.97
    again = Q.estimate(counts.sample(frac=1, random_state=3))
    assert again[0] == share and (again[1] == p).all()


def test_labels_and_edges(spark, edges, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = Q.judge(docs).join(labels, "doc_id").filter(~Q.base_failed(F.col("_measures")))
    wrong = judged.filter((F.col("quality") == 1) != F.col("_kept")).count()
    assert wrong <= 0.02 * judged.count()
    kept = Q.keep_good(edges)
    assert kept.columns == edges.columns
    ids = [r.doc_id for r in kept.collect()]
    assert not {0, 1, 2, 3, 5, 9, 10} & set(ids) and ids.count(6) in (0, 2)
    assert Q.keep_good(none).count() == 0
