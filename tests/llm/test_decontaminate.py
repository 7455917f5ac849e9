"""Decontamination: recall against dynamic programming over whole texts, exact distances, edge cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from llm_rows import prose
from sparkcurate.llm import decontaminate as D


def table(spark, sf="sf0.001", name="benchmark"):
    return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")


def distance(a, b):
    """Least edits between a and any stretch of b, cell by cell."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_best_match_is_exact():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        got, start = D.best_match(np.array(a), np.array(b))
        assert got == distance(a, b)
        assert min(distance(a, b[start:end]) for end in range(start, len(b) + 1)) == got


def test_recall_on_edited_items(spark):
    items = [tuple(r) for r in table(spark).collect()]
    index = D.Index(items)
    rng = random.Random(2)
    texts, want = [], []
    for i in range(200):
        item, text = rng.choice(items)
        words = text.split()
        for _ in range(rng.randint(0, D.allowed(len(D.words_of(text))))):
            place = rng.randrange(len(words))
            words[place : place + rng.randrange(2)] = rng.choice([[], ["new"], [rng.choice(words).upper()]])
        texts.append(" ".join(prose(i, 40).split() + words + prose(-i - 1, 40).split()))
    found = near = 0
    for text, hits in zip(texts, index.search(texts)):
        words, got = D.words_of(text), {h[0]: h[1] for h in hits}
        for item, ids in index.items:
            k = D.allowed(len(ids))
            if np.isin(ids, [index.number.get(w, 0) for w in words]).sum() >= len(ids) - k:
                d = distance(list(ids), [index.number.get(w, 0) for w in words])
                near += d <= k
                found += d <= k and item in got
                assert item not in got or (d <= k and got[item] >= d)
    assert near >= 150 and found >= 0.97 * near


def test_edges(spark, edges, none):
    items = spark.createDataFrame(
        [(1, "A river, of light and stone!"), (1, None), (2, ""), (3, "one"), (4, prose(2, 60)), (4, prose(2, 60))], "item_id long, text string"
    ).withColumn("hits", F.lit(1))
    pairs = {(r.doc_id, r.item_id, r.distance) for r in D.contaminated(edges, items).collect()}
    assert pairs == {(3, 3, 0), (6, 4, 0), (7, 4, 0), (11, 4, 0)}
    clean = D.clean(edges, items)
    assert clean.columns == edges.columns and {r.doc_id for r in clean.collect()} == {None, 0, 1, 2, 4, 5, 8, 9, 10, 12}
    assert D.contaminated(none, items).count() == 0 and D.clean(edges, items.limit(0)).count() == edges.count()


def test_items_with_deletions_at_the_ends_of_texts(spark):
    items = [tuple(r) for r in table(spark).collect()]
    index = D.Index(items)
    rng = random.Random(3)
    texts = []
    for i in range(300):
        words = D.words_of(rng.choice(items)[1])
        most = D.allowed(len(words))
        if i % 3:  # lost anywhere, or at one end
            first = rng.choice([0, len(words) - most])
            gone = set(range(first, first + most)) if i % 3 == 1 else set(rng.sample(range(len(words)), rng.randint(1, most)))
            words = [w for j, w in enumerate(words) if j not in gone]
        else:
            del words[rng.randrange(len(words))]
        words = " ".join(w.decode() for w in words)
        texts += [words, words + " " + prose(i, 40), prose(i, 40) + " " + words, "zq " + words + " zq"]
    near = found = 0
    for text, hits in zip(texts, index.search(texts)):
        ids = [index.number.get(w, 0) for w in D.words_of(text)]
        got = {h[0]: h[1] for h in hits}
        for item, want in index.items:
            k = D.allowed(len(want))
            if np.isin(want, ids).sum() >= len(want) - k and (d := distance(list(want), ids)) <= k:
                near += 1
                found += got.get(item) == d
        assert all(0 <= h[3] < len(ids) for h in hits)
    assert near >= 1_000 and found >= 0.97 * near


def test_fillers_do_not_join_texts():
    words = [f"w{i}" for i in range(40)]
    text = " ".join(words)
    index = D.Index([(1, text)])
    halves = [" ".join(words[:20]), " ".join(words[20:]), "", None, " ".join(words[:31]), " ".join(words[:32]), " ".join(words[8:])]
    assert [[h[1:] for h in hits] for hits in index.search(halves)] == [[], [], [], [], [], [(8, 40, 0)], [(8, 40, 0)]]
    assert D.Index([]).search(["one", None]) == [[], []] and index.search([]) == []


def test_lengths_that_miss_the_target_do_without_lsh(spark, monkeypatch):
    items = [tuple(r) for r in table(spark).collect()]
    monkeypatch.setattr(D, "MOST_SAMPLES", 1)
    index = D.Index(items, target=1.0)
    assert min(index.recall.values()) == 1.0 and index.pieces
    rng = random.Random(4)
    texts, want = [], []
    for i in range(200):
        item, text = rng.choice(items)
        words = D.words_of(text)
        for _ in range(D.allowed(len(words))):
            place = rng.randrange(len(words))
            words[place : place + rng.randrange(2)] = rng.choice([[], [b"new"], [rng.choice(words)]])
        words = " ".join(w.decode() for w in words)
        texts.append(rng.choice([words, prose(i, 40) + " " + words + " " + prose(-i - 1, 40)]))
        want.append(item)
    ids = dict(index.items)
    for text, item, hits in zip(texts, want, index.search(texts)):
        d = distance(list(ids[item]), [index.number.get(w, 0) for w in D.words_of(text)])
        assert {h[0]: h[1] for h in hits}.get(item) == (d if d <= D.allowed(len(ids[item])) else None)


def test_every_item_of_a_length_is_tried(monkeypatch):
    tried, embed = [], D.embed
    monkeypatch.setattr(D, "embed", lambda words, starts, n: tried.append((words, starts)) or embed(words, starts, n))
    monkeypatch.setattr(D, "TRIAL_WORDS", 1_000)
    index = D.Index([(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(150)])
    assert len({int(words[s]) for words, starts in tried[1:-1:2] for s in starts}) == 150 and len(index.tables) == 1
