"""License rules: base places against a plain scan, detections against Python's own regular expressions."""

import random
import re
import time

from pyspark.sql import functions as F

from sparkcurate.llm import licenses as L

WORD = re.compile(L.WORD)


def plain(text, rules):
    words = WORD.findall((text or "").translate(str.maketrans(L.UPPER, L.LOWER)))
    places = [(i, label) for i in range(len(words)) for phrase, label in L.PHRASES if tuple(words[i : i + len(phrase)]) == phrase]
    spaced = "".join(f" {w} " for w in words)
    found = [
        (m.start(), -m.end(), s.priority, k, s.label, s.weight)
        for k, s in enumerate(rules) if s.keyword in words for m in re.finditer(s.pattern, spaced)
    ]
    left = [
        d for d in found
        if not any(o != d and o < d and o[1] <= d[1] and o[2] <= d[2] for o in found)
    ]
    return len(words), places, {d[4] for d in left}, max((d[5] for d in left), default=0.0), len(left)


def test_scan_equals_a_plain_one(spark, edges, none):
    rules = L.signatures()
    assert len(rules) > 200
    rng = random.Random(1)
    bits = ["MIT", "License", "Apache", "GNU", "Lesser", "General", "Public", "License,", "version", "2.0", "3", "under", "the", "licensed",
            "Creative Commons", "BSD", "3-clause", "\n", "é", "All rights reserved", "foo", "v", "Mozilla", "CC0", "1.0", "public domain", "in"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(120)]
    texts += [None, "", "This work is licensed under the GNU Lesser General Public License, version 3.", "MIT " * 3000 + "license",
              "Released into the Public Domain.", "available under the terms of the Mozilla Public License, v. 2.0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    seen = set()
    for r in L.scan(docs).collect():
        n, places, labels, score, left = plain(texts[r.doc_id], rules)
        got = r.license
        assert (got.n_words, [tuple(p) for p in got.places]) == (n, places)
        assert (set(got.found.labels), got.found.score, got.found.n) == (labels, score, left), texts[r.doc_id]
        seen |= labels
    assert {"mit", "apache", "gpl", "lgpl", "bsd", "mpl", "cc0", "proprietary", "public-domain"} <= seen
    assert L.scan(edges).count() == edges.count() and L.scan(none).count() == 0


def test_inner_names_are_suppressed(spark):
    docs = spark.createDataFrame([("GNU Lesser General Public License version 3",)], "text string")
    assert L.scan(docs).select(F.col("license.found.labels")).first()[0] == ["lgpl"]


def test_fixed_parts_are_in_every_match():
    rng = random.Random(2)
    rules = L.signatures()
    vocabulary = sorted({w for s in rules for w in re.findall(r"[a-z0-9]+", s.pattern)})
    matched = 0
    for s in rules:
        assert L.must_hold(s.pattern)
        words = re.findall(r"[a-z0-9]+", s.pattern)
        for _ in range(20):  # words of the pattern in order, some left out, some strange
            some = [w if rng.random() < 0.97 else rng.choice(vocabulary) for w in words if rng.random() < 0.8]
            text = "".join(f" {w} " for w in some)
            if re.search(s.pattern, text):
                matched += 1
                assert all(part in text for part in L.must_hold(s.pattern))
    assert matched > 300
    assert L.must_hold(" mit (?: (?:license|licence) )(?: x )?") == [" licen", " mit "]


def test_many_hits_in_one_text(spark):
    """Time follows the number of hits: no expression runs once a hit."""
    times = []
    for n in (1000, 8000):
        docs = spark.createDataFrame([("mit license " * n,)], "text string")
        began = time.perf_counter()
        found = L.scan(docs).select(F.size("license.places").alias("n"), F.col("license.found.n").alias("left")).first()
        times.append(time.perf_counter() - began)
        assert found.n == n and found.left >= n
    assert times[1] < 5 + 8 * times[0]
